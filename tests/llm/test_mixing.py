"""Mixing: targets, draws and the splitting tree against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ingestkit.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, shard int, draws int"


def plain_targets(words, cap=3):
    order = sorted((s for s in words if s is not None)) + ([None] if None in words else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(words.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(cap * words[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > cap * words[s]}
        if not over:
            return {s: cap * words[s] if s in capped else level * weight[s] for s in order}
        capped |= over


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i * 7 % 40)), ["a", "b", "c", None, "d"][min(i % 9, 4)], "x", 1, 2) for i in range(400)]
    rows += [(900, None, "a", "x", 1, 2), (901, "", "b", "x", 1, 2), (902, " \t\n", None, "x", 1, 2), (None, "one two", "b", "x", 1, 2),
             (903, "same words", "c", "x", 1, 2), (903, "same words", "c", "x", 1, 2), (904, "tiny", "e", "x", 1, 2), (905, "wide space", "e", "x", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA)


def test_digest_against_plain_python(docs):
    got = mixing.mixing_digest(docs).collect()
    rows = docs.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = defaultdict(int)
    for r in rows:
        words[r.source] += size(r.text)
    goal = plain_targets(words)
    want = []
    for source in words:
        own = [r for r in rows if r.source == source]
        times = math.floor(goal[source] / words[source] + 1e-12)
        rest, run = goal[source] - times * words[source], 0
        key = lambda r: hashlib.md5(f"mix|{'' if r.doc_id is None else r.doc_id}|{hashlib.md5(r.text.encode()).hexdigest() if r.text is not None else ''}".encode()).hexdigest()
        tied = defaultdict(list)
        for r in own:
            tied[key(r)].append(r)
        for _, group in sorted(tied.items()):
            n = sum(size(r.text) for r in group)
            more = rest > 1e-9 and run + n / 2 <= rest
            run += n
            want += [(r.doc_id, size(r.text), words[source], round(goal[source], 6), size(r.text) * (times + more)) for r in group]
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == order(want)
    taken, largest = Counter(), Counter()
    for doc, r in ((w, w) for w in want):
        taken[r[2], r[3]] += r[4]
        largest[r[2], r[3]] = max(largest[r[2], r[3]], r[1])
    assert all(abs(n - target) <= largest[words_, target] for (words_, target), n in taken.items())
    assert all(r.taken <= 3 * r.size for r in got)


def test_draws_do_not_depend_on_the_layout(docs):
    rows = lambda d: sorted(str((r.doc, r.draws)) for r in mixing.mix(d, shards=4).select("doc", "draws").collect())
    assert rows(docs) == rows(docs.repartition(7))


def test_tree_is_exact(spark):
    counts = {1: 300, 2: 100, 3: 57, 4: 1, 5: 0}
    quotas = mixing.quota_tree(spark.createDataFrame(list(counts.items()), "ordinal long, blocks long"), 6).collect()
    by_source, by_shard = Counter(), Counter()
    for r in quotas:
        assert r.quota >= 0
        by_source[r.ordinal] += r.quota
        by_shard[r.shard] += r.quota
    assert all(by_source[k] == n for k, n in counts.items())
    assert len(by_shard) == 6 and max(by_shard.values()) - min(by_shard.values()) <= 2


def test_hypergeometric_follows_its_distribution(spark):
    total, good, draws = 60, 23, 17
    n = 4000
    number = lambda x: F.lit(x).cast("long")
    got = Counter(r[0] for r in spark.range(n).select(mixing.hypergeometric(number(total), number(good), number(draws), (F.col("id") + 0.5) / n)).collect())
    for k in range(draws + 1):
        p = math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws)
        assert abs(got[k] - n * p) <= 2
    edges = [(10, 0, 4, 0), (10, 10, 4, 4), (10, 3, 10, 3), (10, 3, 0, 0), (1, 1, 1, 1)]
    for t, g, d, want in edges:
        assert spark.range(1).select(mixing.hypergeometric(number(t), number(g), number(d), F.lit(0.7))).first()[0] == want


def test_rows_of_the_mix(docs):
    mixed = mixing.mixed_rows(docs, shards=4)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    want = Counter()
    for r in mixing.mix(docs, shards=4).select("doc.doc_id", F.size("draws").alias("n")).collect():
        want[r.doc_id] += r.n
    assert +times == +want


def test_empty_and_wordless_tables(spark):
    assert mixing.mixing_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    silent = mixing.mixing_digest(spark.createDataFrame([(1, None, None, "", 0, 0), (2, "", "a", "", 0, 0)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in silent] == [(0, 0.0, 0)] * 2


def test_no_python_in_the_plan(docs):
    plan = mixing.mixing_digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shards_follow_the_text(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some words of text {k}", "a" if k % 3 else "b") for k in range(300)], "doc_id long, text string, source string")
    plain = mixing.mixed_rows(docs)
    monkeypatch.setattr(mixing, "SHARD_BYTES", 200)
    many = mixing.mixed_rows(docs)
    n = lambda df: int(re.search(r"hashpartitioning\(_d#\d+\.shard, (\d+)\)", df._jdf.queryExecution().executedPlan().toString()).group(1))
    assert n(plain) == mixing.SHARDS and n(many) >= 25
    assert sorted(map(str, plain.collect())) == sorted(map(str, many.collect()))
