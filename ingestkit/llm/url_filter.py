"""URL filters: trust and distrust spread over the graph of hosts.

Rules of host and path decide the URLs they fit, the longest first. Where none fits, the host decides: pages a rule
allows are the trusted seeds of their hosts, pages a rule blocks the blocked seeds. Trust is a personalised PageRank
from the trusted seeds along links between hosts; distrust is the same from the blocked seeds along the reversed links,
so it reaches the hosts that link to blocked ones. Both start from the numbers of seed pages. A host whose distrust is
more than ``threshold`` times its trust is blocked, any other is allowed.

Links are the absolute addresses in the pages' anchors, counted per pair of hosts before anything is joined, so a hot
host is one row per neighbour. Each walk repeats joins of hosts with host links in Spark, writes every round, and ends
when scores move less than ``tolerance`` in all and no further host was reached, or after ``rounds`` rounds if given. Mass of a host without links returns to the
seeds.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed, as nothing is known of
it; null html has no links; repeated pages and links count as often as they occur; an empty table gives no rows;
scores that tie allow; extra columns are left alone.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestkit.llm.common import fields, written

#: (host, path, verdict): a rule fits the host and its subdomains where the path starts alike.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def _host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def addressed(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``ruled`` (the rule's verdict) to pages with a ``url``."""
    url = F.when(F.col("url").contains("://"), F.col("url")).otherwise(F.lit("://"))  # else host and path are empty
    placed = pages.withColumn("host", _host(url)).withColumn("path", _path(url))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, kind in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the last that fits is the longest
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return placed.withColumn("rule", name).withColumn("ruled", verdict)


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links from pages of one host to another host."""
    found = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return (found.select(F.col("host").alias("src"), _host(whole).alias("dst"))
            .where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n")))


def rank(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, seed`` (every host once) and ``src, dst, n`` → ``host, score``: a personalised PageRank.

    Scores sum to the sum of the seeds.
    """
    every = seeds.agg(F.coalesce(F.sum("seed"), F.lit(0.0))).first()[0]
    now = seeds.select("host", "seed", F.col("seed").cast("double").alias("score"))
    if not every or links.isEmpty():
        return now.select("host", "score")
    shares = written(links.join(links.groupBy("src").agg(F.sum("n").alias("total")), "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "host-shares")
    now = written(now, "host-rank")
    sources = written(shares.select(F.col("src").alias("host")).distinct(), "host-sources")
    reached = 0
    for _ in count() if rounds is None else range(rounds):  # a round leaves at most ``damping`` of what moved before
        moved = (now.join(shares, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host"))
                 .agg(F.sum(F.col("score") * F.col("share")).alias("got")))
        kept = now.join(sources, "host").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        back = 1 - damping * kept / every  # restarts, and what hosts without links hold
        nxt = now.join(moved, "host", "left").select("host", "seed", F.col("score").alias("old"), (
            damping * F.coalesce("got", F.lit(0.0)) + back * F.col("seed")).alias("score"))
        nxt = written(nxt, "host-rank")
        change, scored = nxt.agg(F.coalesce(F.sum(F.abs(F.col("score") - F.col("old"))), F.lit(0.0)), F.count_if(F.col("score") > 0)).first()
        now = nxt.drop("old")
        if change <= tolerance * every and scored == reached:
            break
        reached = scored
    return now.select("host", "score")


def host_scores(pages: DataFrame, **walk) -> DataFrame:
    """``host, trust, distrust`` of every host that has pages or is linked to. ``pages``: what ``addressed`` returns."""
    seeds = pages.where("host != ''").groupBy("host").agg(
        F.sum(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("good"), F.sum(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("bad"))
    links = written(host_links(pages), "host-links")
    linked = links.select(F.col("dst").alias("host"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))
    hosts = written(seeds.unionByName(linked).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "hosts")
    trust = rank(hosts.select("host", F.col("good").alias("seed")), links, **walk)
    turned = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = rank(hosts.select("host", F.col("bad").alias("seed")), turned, **walk)
    return trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host")


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **walk) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages``."""
    placed = addressed(fields(pages, page_id=id_col, url=url_col, html=html_col), rules)
    scores = written(host_scores(placed, **walk).withColumnRenamed("host", "_host"), "host-scores")
    joined = placed.drop("html", "url").join(scores, F.col("host") == F.col("_host"), "left")
    by_host = F.when(F.coalesce("distrust", F.lit(0.0)) > threshold * F.coalesce("trust", F.lit(0.0)), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust")


def judge_digest(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
