"""Language ID: exact inference, accuracy on held-out documents, switched texts, edge cases."""

import zlib
from collections import Counter

import numpy as np
import pytest

from ingestkit.llm import language as L

SCHEMA = "doc_id long, text string, lang string, score int, lang_pred string"


@pytest.mark.parametrize("lengths", [[5], [300, 1, 129, 128, 2], [1, 700]])
def test_forward_backward_is_exact(lengths):
    rng = np.random.default_rng(0)
    scores, move = rng.normal(size=(sum(lengths), 3)) * 3, rng.normal(size=(3, 3))
    got, moved = L.forward_backward(scores, np.array(lengths), move)
    at, want, pairs = 0, [], np.zeros((3, 3))
    for n in lengths:
        x, at = scores[at:at + n], at + n
        f, b = [x[0]], [np.zeros(3)]
        for t in range(1, n):
            f.append(np.logaddexp.reduce(f[-1][:, None] + move, axis=0) + x[t])
        for t in range(n - 1, 0, -1):
            b.append(np.logaddexp.reduce(move + x[t] + b[-1], axis=1))
        b, z = b[::-1], np.logaddexp.reduce(f[-1])
        want += [np.exp(p + q - z) for p, q in zip(f, b)]
        for t in range(1, n):
            pairs += np.exp(f[t - 1][:, None] + move + x[t] + b[t] - z)
    assert np.abs(got - np.array(want)).max() < 1e-8 and np.abs(moved - pairs).max() < 1e-6


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return {r.doc_id: r for r in L.identify_digest(docs).collect()}, docs.collect()


def test_held_out_accuracy(judged):
    got, rows = judged
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == len(rows) and all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 'zz' ELSE lang END AS lang")
    key = lambda d: sorted(map(str, L.identify_digest(d).collect()))
    assert key(docs) == key(other.repartition(3))


def test_switched_texts_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").limit(500).collect()
    long = {lang: next(r.text for r in docs if r.lang == lang and 800 < len(r.text) < 4000 and r.text[0].isalpha() and "$$" not in r.text) for lang in ("en", "de")}
    en, de = L.words_of(long["en"])[:60], L.words_of(long["de"])[:60]
    rows = [(r.doc_id, r.text, r.lang, 1, "x") for r in docs] + [
        (9000, " ".join(en + de), None, 1, "x"), (9001, None, "en", 1, "x"), (9002, "", "en", 1, "x"), (9003, "12 34 !?", "fr", 1, "x"), (None, " ".join(de), "de", 1, "x"),
        (9004, " ".join(en), "en", 1, "x"), (9004, " ".join(en), "en", 1, "x"), (9005, "the " * 60_000, None, 1, "x"), (9006, "é" * 30_000, None, 1, "x")]
    got = L.identify(spark.createDataFrame(rows, SCHEMA)).where("doc.doc_id IS NULL OR doc.doc_id >= 9000").collect()
    by = {r.doc.doc_id: r for r in got}
    assert len(got) == 9 and by[None].lang_pred == "de" and by[9004].lang_pred == "en" and by[9005].lang_pred == "en"
    mixed = by[9000]
    assert mixed.languages["en"] >= 50 and mixed.languages["de"] >= 50 and mixed.score < 0.7
    assert mixed.spans[0].label == "en" and mixed.spans[-1].label == "de" and mixed.spans[-1].last == sum(mixed.languages.values()) - 1
    for k in (9001, 9002, 9003):
        assert (by[k].lang_pred, by[k].score, by[k].spans) == ("und", 0.0, [])


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None, 1, "x"), (2, None, "en", 1, "x")], SCHEMA)
    assert {r.lang_pred for r in L.identify_digest(docs).collect()} == {"und"}
    assert L.identify_digest(docs.limit(0)).count() == 0


def test_every_language_is_sampled(spark):
    rows = [(k, f"wort{k} und mehr", f"l{k % 9}", 1, "x") for k in range(400)]
    rows += [(k, "1 2 3 " + "lang " * 30, "long", 1, "x") for k in range(400, 410)] + [(k, "z" * 200, "l0", 1, "x") for k in range(410, 420)]
    got = L.training_rows(spark.createDataFrame(rows, SCHEMA), docs_per_language=6, max_chars=50, languages=5)
    assert Counter(lang for _, lang in got) == {lang: 3 for lang in [f"l{k}" for k in range(9)] + ["long"]}
    assert all(text == ("lang " * 30)[:50] for text, lang in got if lang == "long") and not any("zz" in text for text, _ in got)


def test_more_languages_than_the_sample_was_made_for(spark):
    rng = np.random.default_rng(5)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for _ in range(70)]
    rows = [(10 * k + n, " ".join(rng.choice(words[k], 40)), f"l{k:02}", 1, "x") for k in range(70) for n in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {lang for _, lang in L.training_rows(docs, docs_per_language=4)} == {f"l{k:02}" for k in range(70)}
    tagger = L.train(L.training_rows(docs, docs_per_language=4), rounds=15)
    right = [tagger.languages[int(p.mean(axis=0).argmax())] == r[2] for r, p in zip(rows, L.label(L.Emissions(tagger), [L.words_of(r[1]) for r in rows]))]
    assert len(tagger.languages) == 70 and np.mean(right) >= 0.95
