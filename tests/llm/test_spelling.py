"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from ingestkit.llm import spelling as S

DOCS = "doc_id long, text string, word string, n int, form string, number int, _ int"


def wanted(rows, damage=97):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) - len(x) == 1 and any(y[:k] + y[k + 1:] == x for k in range(len(y)))


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], DOCS).repartition(3)
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in S.variants(docs, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("damage", [97, 3])
def test_against_all_pairs(spark, damage):
    random.seed(damage)
    words = ["".join(random.choices("abé", k=random.randint(4, 7))) for _ in range(300)] + ["aaaaa", "aaaaaa", "ZZZZZ", "zzzzzÀ", "zzzzzà"]
    texts = [" ".join(random.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=random.randint(0, 120))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(None, texts[3]), (None, texts[3]), (4, texts[4]), (500, None), (501, ""), (502, "1234 !? 漢字")]
    assert run(spark, rows, damage=damage) == wanted(rows, damage)


def test_long_words(spark, monkeypatch):
    """Words around and far beyond the bound meet across it, and travel without the square of their length."""
    random.seed(9)
    base = "".join(random.choices("abcdé", k=S.LONG + 1))
    near = [base, base[:-1], base[1:], "q" + base[1:], base[:30] + "z" + base[30:], base + "e", base[:-2], "a" * 64, "a" * 65, "a" * 63, "a" * 66]
    far = "".join(random.choices("abcd", k=20_000))
    rows = [(k, " ".join(near + [base] * 7)) for k in range(3)] + [(k, f"{far} {far[:9_000]}x{far[9_001:]} {far}e {far}") for k in range(3, 7)]
    assert run(spark, rows) == wanted(rows)


def test_hashed_keys_tell_rotations_apart():
    for word, other in (("abcab" * 20, "abcaa" + "abcab" * 19), ("a" * 90, "a" * 89)):
        whole, skipped = S._hashed_keys(word)
        spelled, held = S.keys(word, long=200)
        assert [len(set(x)) for x in (whole, skipped)] == [len(set(x)) for x in (spelled, held)]
        a, b = S._hashed_keys(other), S.keys(other, long=200)
        for mine, plain in ((whole, spelled), (skipped, held)):
            for theirs, theirs_plain in zip(a, b):
                assert [[x == y for y in theirs] for x in mine] == [[x == y for y in theirs_plain] for x in plain]


def test_chains_and_empty(spark):
    steps = ["abcde" + "f" * k for k in range(7)]
    rows = [(k, " ".join(" ".join([w] * 3 ** (7 - n)) for n, w in enumerate(steps))) for k in (1, 2, 3)]
    got = run(spark, rows)
    assert got == wanted(rows) and {r[2] for r in got} == {"abcde"}
    assert run(spark, [(1, "a few short words")]) == set()
    assert S.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        S.variants(spark.createDataFrame([], "doc_id long, text string"), ratio=1)
