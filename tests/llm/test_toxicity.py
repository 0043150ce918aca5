"""Ordinal toxicity: likelihood, order of thresholds, held-out accuracy, edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ingestkit.llm import toxicity as T


def test_shared_weights_recover_an_ordinal_model():
    rng = np.random.default_rng(2)
    words = ["calm", "rude", "vile"]
    texts, grades = [], []
    for _ in range(900):
        c = Counter({w: int(n) for w, n in zip(words, rng.integers(0, 4, 3)) if n})
        x = 3 * np.log1p(c["rude"]) + 6 * np.log1p(c["vile"])
        grades.append(int((x + rng.logistic() > np.array([4.0, 8.0, 11.0])).sum()))
        texts.append(c)
    model = T.train(texts, np.array(grades), ["calm$", "rude$", "vile$"], rounds=1500)
    calm, rude, vile = (model.weights[model.names[w + "$"]] for w in words)
    assert abs(calm) < 0.6 and 2.2 < rude < 3.8 and 5 < vile < 7.5
    assert (np.diff(model.thresholds) > 0).all() and np.abs(model.thresholds - [4, 8, 11]).max() < 1.5
    assert all((np.diff(model.exceed(t, {})) <= 0).all() for t in texts)


def test_held_out_documents(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in T.score(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    toxic, clean = ([got[r.doc_id].toxic for r in held if r.toxic == k] for k in (1, 0))
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.severity <= 2 and r.toxic == (r.p_toxic >= 0.5) for r in got.values())


@pytest.fixture(scope="module")
def small(spark):
    schema = "doc_id long, text string, grade int, toxic string"
    name = lambda k: "".join("abcdefghij"[int(d)] for d in str(k))
    rows = [(k, f"one{name(k)} {name(k)} {'awful' if k % 2 else 'pleasant'} c{name(k)}", 9, "x") for k in range(200)]
    rows += [(900, None, 9, "x"), (901, "", 9, "x"), (902, "AWFUL awful awful awfully", 9, "x"), (None, "so awful", 9, "x"), (903, "awful", 9, "x"), (903, "awful", 9, "x"),
             (904, "filler " * 50_000 + "awful", 9, "x")]
    labels = [(k, 1, k % 2) for k in range(200)] + [(5000, 1, 1), (None, 1, 1), (901, 1, None)]
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_edge_cases(small):
    docs, labels = small
    got = T.score(docs, labels).collect()
    assert len(got) == 207
    by = {r.doc_id: r for r in got}
    assert not by[900].toxic and not by[901].toxic and by[900].severity == by[901].severity
    assert by[902].toxic and by[None].toxic and by[903].toxic and by[904].toxic and not by[2].toxic
    assert by[902].severity >= by[903].severity
    assert T.score(docs.limit(0), labels).count() == 0


def test_one_grade_or_none(small):
    docs, labels = small
    for some in (labels.where("toxic = 1"), labels.where("toxic = 0"), labels.limit(0)):
        assert {r.severity < 1e-9 for r in T.score(docs, some).collect()} == {True}


def plain_fit(texts, grades, names, rounds, decay=1e-5):
    """The same climb with slopes by differences of the likelihood, one text and one parameter at a time."""
    import math

    def marks(word):
        return {word + "$"} | {word[:n] for n in (4, 5, 6) if len(word) >= n}

    values = [{n: math.log1p(sum(c for w, c in t.items() if n in marks(w))) for n in names} for t in texts]
    top = max(grades)

    def likelihood(p):
        w, first, gaps = p[:len(names)], p[len(names)], p[len(names) + 1:]
        cuts = [first]
        for g in gaps:
            cuts.append(cuts[-1] + math.exp(g))
        total = 0.0
        for v, grade in zip(values, grades):
            x = sum(a * v[n] for a, n in zip(w, names))
            below = [0.0] + [1 / (1 + math.exp(x - t)) for t in cuts] + [1.0]
            total += math.log(below[grade + 1] - below[grade])
        return total / len(texts) - decay / 2 * sum(a * a for a in w)

    p, seen = [0.0] * (len(names) + top), [1e-8] * (len(names) + top)
    for _ in range(rounds):
        slopes = []
        for k in range(len(p)):
            up, down = list(p), list(p)
            up[k] += 1e-5
            down[k] -= 1e-5
            slopes.append((likelihood(up) - likelihood(down)) / 2e-5)
        for k, s in enumerate(slopes):
            seen[k] += s * s
            p[k] += 0.3 * s / math.sqrt(seen[k])
    cuts = [p[len(names)]]
    for g in p[len(names) + 1:]:
        cuts.append(cuts[-1] + math.exp(g))
    return p[:len(names)], cuts


def test_fit_and_score_by_hand(spark):
    rng = np.random.default_rng(8)
    words, names = ["calm", "rudely", "vile", "word"], ["calm$", "rudel", "vile$"]
    texts = [Counter({w: int(n) for w, n in zip(words, rng.integers(0, 4, 4)) if n}) for _ in range(50)]
    grades = [int((2 * np.log1p(t["rudely"]) + 4 * np.log1p(t["vile"]) + rng.logistic() > np.array([2.0, 5.0])).sum()) for t in texts]
    model = T.train(texts, np.array(grades), names, rounds=25)
    weights, cuts = plain_fit(texts, grades, names, 25)
    assert np.allclose(model.weights, weights, atol=1e-4) and np.allclose(model.thresholds, cuts, atol=1e-4)

    common = ["river", "town", "market", "field", "house", "stone", "light"]
    rows = []
    for k in range(120):
        own = list(rng.choice(common, 12)) + (list(rng.choice(["grub", "grubby", "grubbing"], 4)) if k % 3 == 0 else [])
        rows.append((k, " ".join(own[j] for j in rng.permutation(len(own)))))
    rows += [(500, None), (501, ""), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    made = T.fitted(T.training_rows(docs, labels))
    want = []
    for i, text in rows:
        x = 0.0
        for name, slot in made.names.items():
            n = sum(1 for w in re.findall("[^\\W\\d_]+", (text or "").lower()) if name == w + "$" or (len(name) in (4, 5, 6) and w.startswith(name)))
            x += made.weights[slot] * math.log1p(n)
        over = [1 / (1 + math.exp(t - x)) for t in made.thresholds]
        want.append((i, sum(p >= 0.5 for p in over), round(sum(over), 9), over[0] >= 0.5))
    got = [(r.doc_id, r.grade, round(r.severity, 9), r.toxic) for r in T.score(docs, labels).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r[3] for r in got} == {True, False}
