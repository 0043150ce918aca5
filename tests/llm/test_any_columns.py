"""Extra columns of any name, and workers that have no copy of the package."""

import os
import subprocess
import sys
import textwrap

import corpus_pipeline as P
from ingestkit.llm import cross_tokens, decontaminate, language, ngram_join, simhash, spelling

NAMES = ["_", "_winner", "_set", "_key", "_rest", "_text", "_KEY_", "none", "doc", "key", "component", "_id"]


def test_clashing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = {name: stage(spark, docs, sf_dir) for name, stage in P.STAGES[:3]}
    for k, c in enumerate(NAMES):
        docs = docs.selectExpr("*", f"{k} AS `{c}`")
    for name, stage in P.STAGES[:3]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and got.select(*NAMES).distinct().first() == tuple(range(len(NAMES)))
        assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in plain[name].select("doc_id").collect())


def test_only_a_text(spark):
    texts = spark.createDataFrame([("one two three four five",), ("the and of",), (None,)], "text string")
    keyed = ngram_join.with_keys(texts)
    assert keyed.columns == ["text", "_key"] and keyed.where("text IS NULL").first()["_key"] is None
    items = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    assert [r.n_hit for r in decontaminate.decontaminate(texts, items).orderBy(*["n_words"]).collect()] == [0, 0, 3]


def test_workers_without_the_package(tmp_path):
    """The package is on the driver's path only: helpers travel with the plan."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        from ingestkit.session import local_session
        from ingestkit.llm import cross_tokens, decontaminate, html_blocks, language, ngram_join, simhash, spelling, token_scan, toxicity
        spark = local_session(2)
        docs = spark.createDataFrame([(k, f"the quick brown fox number {{k % 3}} jumps over a lazy dog", "en") for k in range(12)], "doc_id long, text string, lang string")
        labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
        items = spark.createDataFrame([("i", "quick brown fox")], "item_id string, text string")
        pages = spark.createDataFrame([(1, "u", "<article><p>Text of a page.</p></article>")], "page_id long, url string, html string")
        probe = docs.mapInPandas(lambda b: (__import__("pandas").DataFrame({{"n": [__import__("importlib").util.find_spec("ingestkit") is None]}}) for _ in b), "n boolean")
        assert all(r[0] for r in probe.collect()), "the workers see the package"
        made = [ngram_join.join(docs), simhash.join(docs), spelling.variants(docs), cross_tokens.align_digest(docs), decontaminate.decontaminate(docs, items),
                language.identify(docs), html_blocks.extract(pages), token_scan.token_counts(docs), toxicity.score(docs, labels)]
        print([m.count() for m in made], len(made[6].first().text))
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split("\n")[-2].startswith("[12, 12, ")
