"""Main text: labelled samples, the articles of the page table, markup of all kinds."""

import html
import re

import pytest

from ingestkit.llm import html_blocks as H

TREE = H.learned()


def test_samples_are_learned():
    for page in H.SAMPLES:
        assert H.main_text(TREE, page) == " ".join(b.text for b in H.blocks(page) if b.keep)


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p></p>", ""), ("   ", ""),
    ('<body><div class="sidebar"><p>side</p></div><div id="content"><h1>T</h1><p>Hello&nbsp;&amp; <b>wor</b>ld</p><div class="comments"><article class="comment"><p>nice</p></article></div></div>', "T Hello & world"),
    ("<article><header><h1>Title</h1></header><p>a</p><footer>f</footer><aside>x</aside></article>", "Title a"),
    ('<article><p title="a > b">x</p><!-- <p>c</p> --><script>var x="<p>no</p>"</script><style>p{}</style><p>y', "x y"),
    ('<div class="page-with-sidebar"><div class="main-content"><p>ok</p></div></div>', "ok"),
    ('<article><p>x</p><div class="related"><p>Related</p></div><ul class="share"><li>Tweet</li></ul><table><tr><td>1</td><td>2</td></tr></table><form><input><button>Go</button></form></article>', "x 1 2"),
    ('<article class="post comments-open"><p>kept</p></article>', "kept"),
    ("<article><p>a<br>b\n\n c</p><p>&lt;tag&gt; &#233; &bogus; &amp;lt;</p></article>", "a b c <tag> é &bogus; &lt;"),
    ("<ARTICLE><P>caps</P></ARTICLE><FOOTER>no</FOOTER>", "caps"),
    ("</div></p><article><div><p>stray</div>rest</article>after <i>all</i>", "stray rest"),
    ("<article><p>a < b and c</p><p>5 <6</p></article>", "a < b and c 5 <6"),
    ('<article><p>one</p><div class="cookie-banner">We use cookies</div><div class="adBox">Buy</div><p>two</p></article>', "one two"),
    ("<head><title>no</title></head><main><p>yes</p></main>", "yes"),
    # weak words on an article or above it
    ('<div id="top"><nav>Menu</nav><article><p>kept text</p></article></div>', "kept text"),
    ('<body><main class="search"><h1>Found</h1><p>kept</p></main></body>', "Found kept"),
    ('<div class="post tag-social"><p>kept</p></div><footer>f</footer>', "kept"),
    ('<div class="social-story"><article><p>kept</p></article><p>Follow us</p></div>', "kept"),
    ('<div class="legal"><main><p>the law of the sea</p></main><p>Imprint</p></div>', "the law of the sea"),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></article>", "Let x=2 hold."),
    ('<div class="shop"><div class="banner"><article class="story"><p>deep</p></article></div></div>', "deep"),
    ('<article><p>a</p><div class="post-meta"><p>By Ann, 3 May</p></div><div class="share"><p>Share this</p></div><p>b</p></article>', "a b"),
    ('<aside><article><p>teaser</p></article></aside><article><p>a</p></article>', "a"),
    ('<div class="comments top"><article><p>a reader</p></article></div><main><p>a</p></main>', "a"),
    ('<article class="comment"><p>a reader</p></article><article><p>a</p></article>', "a"),
])
def test_pages(page, want):
    assert H.main_text(TREE, page) == want


def test_long_unclosed_pages_end():
    assert H.main_text(TREE, "<article>" + "<p>x" * 50_000).count("x") == 50_000
    assert H.main_text(TREE, "<article>" + "<b" * 20_000) is not None
    assert H.main_text(TREE, "<article><p>a</p>" + "<script>" * 3_000).startswith("a")


def test_articles_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages.selectExpr("*", "'z' AS text", "1 AS n_chars")).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<br>|</?p>|</?h1>", " ", article).replace("<b>", "")).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_rows_that_are_null_or_repeated(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<main><p>a</p></main>"), (2, "u", "<main><p>a</p></main>"), (2, "u", "<main><p>a</p></main>")],
                                  "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in H.extract(pages).collect()) == [("1", "", 0), ("2", "a", 1), ("2", "a", 1), ("None", "a", 1)]
    assert H.extract(pages.limit(0)).count() == 0
