"""SimHash components against all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from ingestkit.llm import simhash as H

DOCS = "doc_id long, text string, fp long, members int, component string, _ int"


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(fps, budget=3):
    """The component of every fingerprint and the number of others within the budget."""
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k
    linked = [0] * len(fps)
    for x in range(len(fps)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= budget:
                linked[x] += 1
                linked[y] += 1
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return [find(k) for k in range(len(fps))], linked


def wanted(rows, budget=3):
    fps = [plain_fingerprint(t) for _, t in rows]
    part, linked = labels(fps, budget)
    least = {}
    for (i, _), p in zip(rows, part):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    return sorted(str((i, f"{f:016x}", least.get(p), n)) for (i, _), f, p, n in zip(rows, fps, part, linked))


def documents():
    random.seed(4)
    vocabulary = [f"w{k}É" for k in range(400)]
    rows, i = [], 0
    for _ in range(12):
        base = random.choices(vocabulary, k=random.randint(60, 400))
        for _ in range(random.randint(1, 8)):
            own = list(base)
            for _ in range(random.randint(0, 3)):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            rows.append((i, "\t ".join(own).upper() if i % 3 else "  ".join(own)))
            i += 7
    rows += [(i + 1, None), (i + 2, ""), (i + 3, " \n "), (i + 4, "one"), (i + 5, "ONE"), (i + 6, "one two"), (None, "no id at all"), (None, rows[0][1]),
             (3, rows[5][1]), (3, rows[5][1]), (i + 7, "nbsp stays one word")]
    return rows


@pytest.mark.parametrize("leaf", [2, 7, None])
def test_components(spark, leaf):
    rows = documents()
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], DOCS).repartition(3)
    got = H.join(docs, leaf=leaf).collect()
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id, r.n_links)) for r in got) == wanted(rows)
    assert H.join_digest(docs).columns == ["doc_id", "fingerprint", "component_id"]


def test_fingerprints_are_spark_hashes(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "Ünlike ASCII"), (3, "x")], "doc_id long, text string")
    plain = docs.selectExpr("doc_id", "xxhash64(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS fp")
    assert sorted(map(tuple, H.fingerprints(docs).collect())) == sorted(map(tuple, plain.collect()))


def walked(fps, depth_pairs, budget):
    """Walk pairs of prefixes by hand, as tasks do, and join their forests."""
    part, linked = {}, {}
    edges = []
    for depth, p, q in depth_pairs:
        left = np.array(sorted(f for f in fps if f >> (64 - depth) == p), np.uint64)
        right = np.array(sorted(f for f in fps if f >> (64 - depth) == q), np.uint64) if p != q else left[:0]
        both = np.concatenate((left, right))
        if not len(left) or (p != q and not len(right)):
            continue
        found = H.Joined(both, np.ones(len(both), np.int64))
        H.walk(both, len(left), depth, budget, found)
        found.settle()
        edges += [(int(both[k]), int(both[r])) for k, r in enumerate(found.root) if k != r]
        for f, n in zip(both.tolist(), found.linked.tolist()):
            linked[f] = linked.get(f, 0) + n
    part = {f: f for f in fps}

    def find(f):
        while part[f] != f:
            f = part[f]
        return f
    for x, y in edges:
        a, b = sorted((find(x), find(y)))
        part[b] = a
    return [find(f) for f in fps], [linked.get(f, 0) for f in fps]


@pytest.mark.parametrize("budget, frontier, direct", [(3, 1 << 14, 64), (3, 3, 1), (0, 5, 4), (6, 2, 9)])
def test_walk(monkeypatch, budget, frontier, direct):
    monkeypatch.setattr(H, "FRONTIER", frontier)
    monkeypatch.setattr(H, "DIRECT", direct)
    monkeypatch.setattr(H, "HELD", 4)
    rng = random.Random(budget)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(12)})
    part, linked = labels(fps, budget)
    want = [fps[p] for p in part], linked
    assert walked(fps, [(0, 0, 0)], budget) == want
    split = [(2, p, q) for p in range(4) for q in range(p, 4) if (p ^ q).bit_count() <= budget]
    assert walked(fps, split, budget) == want


def test_empty_and_alone(spark):
    assert H.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = H.join(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).first()
    assert (one.component_id, one.n_links) == (5, 0)
    null = H.join(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).first()
    assert null.component_id is None and null.class_fingerprint == null.fingerprint
