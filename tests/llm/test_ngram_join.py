"""The grouped prefix join against all pairs."""

import random

import numpy as np
import pytest

from ingestkit.llm import ngram_join as J
from ingestkit.llm.components import components
from ingestkit.llm.shingles import shingles

SCHEMA = "doc_id long, text string, key string, component_id int"


def grams(text, n=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def plain(rows, percent=85):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda n=900: f"w{rng.randrange(n)}"
    passage = [word() for _ in range(30)]
    out = []
    for family in range(6):
        base = [word() for _ in range(rng.choice([40, 120, 200]))]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(9)):
                text[rng.randrange(len(text))] = word()
            out.append(text)
    for _ in range(80):
        text = [word() for _ in range(rng.randrange(3, 90))]
        at = rng.randrange(len(text))
        out.append(text[:at] + passage + text[at:])
    rng.shuffle(out)
    rows = [(k, " ".join(t)) for k, t in enumerate(out)]
    rows += [(1000, None), (1001, ""), (1002, "\t\n"), (1003, "One two"), (1004, "one  TWO"), (1005, "one two three"), (1006, "É a b c"), (1007, "é a b c"),
             (3, rows[3][1]), (None, rows[5][1]), (None, "only without an id here"), (1008, "x " * 5000), (1009, "x " * 300), (1010, "two\x0bone")]
    return rows


def test_components(spark, rows):
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join_digest(docs).collect()), key=str)
    assert got == plain(rows)


def test_any_order_is_exact(spark, rows):
    some = rows[::2]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(docs, bits=2).collect()), key=str)
    assert got == plain(some)


def test_empty(spark):
    assert J.join_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prefix_bound_is_never_too_low():
    rng = np.random.default_rng(1)
    sketch, shift = rng.integers(0, 5, 16), np.uint64(60)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
        x, y = (np.unique(rng.choice(pool, int(rng.integers(3, 50)))) for _ in range(2))
        order = lambda s: s[np.lexsort((s, sketch[(s >> shift).astype(np.int64)]))]
        px, py = order(x)[:max(1, len(x) // 4)], order(y)[:max(1, len(y) // 4)]
        assert J.most_shared(px, len(x), py, len(y), sketch, shift) >= len(np.intersect1d(x, y))


def test_shingles_like_plain_ones():
    texts = [b"", b"  ", b"a", b"a b c", b"a b c d", b"A  b\tc d\x0be", "é   x y z".encode()]
    for t in texts:
        assert len(shingles(t, 4)) == len(grams(t.decode()))
    assert (shingles(b"A b c d", 4) == shingles(b"a\nB c  d ", 4)).all()
    assert len(np.intersect1d(shingles(b"a b c d e", 4), shingles(b"x b c d e", 4))) == 1


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(20)] + [(100, 100 + k) for k in range(1, 15)] + [(7, 7), (300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, **{100 + k: 100 for k in range(15)}, 299: 299, 300: 299}
