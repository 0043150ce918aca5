"""Nearest neighbours: recall against brute force, exact scores, ties, vectors that take no part."""

from collections import defaultdict

import numpy as np
import pytest

from ingestkit.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, k=20, every=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for q in range(len(rows)):
        if ids[q] % every == 0:
            s = x @ x[q]
            others = [j for j in range(len(rows)) if j != q]
            out[ids[q]] = [(ids[j], s[j]) for j in sorted(others, key=lambda j: (-round(s[j], 12), ids[j]))[:k]]
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got, want = answers(A.search(table)), brute([(r.vec_id, r.embedding) for r in table.orderBy("vec_id").collect()])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.93
    scores = {(q, i): s for q, found in want.items() for i, s in found}
    assert all(abs(s - scores[q, i]) < 1e-9 for q, found in got.items() for i, s in found if (q, i) in scores)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16)) * 4
    rows = [(k, (centres[k % 6] + rng.normal(size=16)).tolist()) for k in range(900)]
    rows += [(k, rows[0][1]) for k in range(1000, 1400)]  # one very common vector
    return rows


def test_copies_ties_and_blocks(spark, clustered):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in clustered], SCHEMA)
    got, want = answers(A.search(df, rows=50)), brute(clustered)
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    alike = [q for q in want if q == 0 or q >= 1000]
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in alike if want[q][0][1] - want[q][19][1] < 1e-9)


def test_adaptive_scan_keeps_the_best():
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(3000, 64)), rng.normal(size=(5, 64))
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    found = [len(set(p) & set(np.argsort(-(x @ v))[:20])) / 20 for p, v in zip(A.scan(q, x, rotation, 20), q)]
    assert np.mean(found) >= 0.95


def test_vectors_that_take_no_part(spark):
    good = [(k, [float(k + 1), 1.0, 0.5]) for k in range(5)]
    odd = [(20, None), (40, []), (60, [0.0, 0.0, 0.0]), (80, [1.0, None, 0.0]), (100, [float("nan"), 1.0, 1.0]), (120, [float("inf"), 1.0, 1.0]), (140, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in good + odd + good[:1]], SCHEMA)
    assert [i for i, _ in answers(A.search(df))[0]] == [4, 3, 2, 1]
    assert A.search(df.limit(0)).count() == 0
    assert A.search(df.where("vec_id = 0")).count() == 0
