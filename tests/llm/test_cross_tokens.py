"""Cross-tokenizer alignment against plain loops over byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from ingestkit.llm import cross_tokens as X

DOCS = "doc_id long, text string, a string, pairs int, _ int, n_links int"
TEXTS = ["The naïve café sells crème brûlée.", None, "", " ", "two  spaces\tand\ttabs\n", "naïve " * 30, "漢字かな交じり文 🎉 emoji", "<|endoftext|> </s> <unk> <0x0A> ▁ plain",
         "\x00\x01 control", "x" * 3_000, "The naïve café sells crème brûlée.", "'s 't I'll 12345 ...", "long text " * 20_000]


@pytest.fixture(scope="module")
def plain():
    """Ids and byte ends of both tokenizers by their own libraries, one text at a time."""
    from sentencepiece import SentencePieceProcessor

    slow = Tokenizer.from_file(X.TOKENIZER_A)
    slow.encode_special_tokens = True
    model = SentencePieceProcessor(model_file=X.TOKENIZER_B)
    spelled = {k: v for v, k in slow.get_vocab().items()}
    alphabet = X.byte_alphabet()

    def tokens(text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        a = [(k, bytes(alphabet[c] for c in spelled[k])) for k in slow.encode(" " + text, add_special_tokens=False).ids]
        b = [(k, bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode()) for k in model.encode(text) for p in [model.id_to_piece(k)]]
        if any(b"".join(x for _, x in side) != whole for side in (a, b)):
            return [], []
        return tuple([(k, sum(len(x) for _, x in side[:n]) if n < 2 else 0, x) for n, (k, x) in enumerate(side)] for side in (a, b))

    def ranged(text):
        out = []
        for side in tokens(text):
            at, ranges = 0, []
            for k, _, x in side:
                ranges.append((k, at, at + len(x)))
                at += len(x)
            out.append(ranges)
        return out
    return ranged


def wanted(ranged, rows):
    """The digest by brute force: every pair of occurrences is looked at by its end."""
    docs = [(i, *ranged(t)) for i, t in rows]
    links = []
    for _, a, b in docs:
        ends = {e: k for k, _, e in b}
        links.append([(k, ends[e]) for k, _, e in a if e in ends])
    count = Counter(p for some in links for p in some)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (i, a, b), some in zip(docs, links):
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        text, low = [], 0
        for e in common:
            text.append("|".join(",".join(str(k) for k, s, f in side if s >= low and f <= e) for side in (a, b)))
            low = e
        digest = hashlib.sha256(";".join(text).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(common), len(some), sum(count[p] == top[p[1]] for p in some), sum(count[p] for p in some), digest))
    return out


def ordered(rows):
    return sorted(map(str, rows))


def test_digest(spark, plain, monkeypatch):
    monkeypatch.setattr(X, "PRODUCTS", 97)
    rows = [(k, t) for k, t in enumerate(TEXTS[:-1])] + [(None, "no id"), (3, "id again"), (3, "id again")]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS).repartition(3)
    got = X.align_digest(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(tuple(r) for r in got.collect()) == ordered(wanted(plain, rows))
    assert X.align_digest(docs.limit(0)).count() == 0 and X.align_digest(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()[7] == ""


def test_long_text(spark):
    docs = spark.createDataFrame([(1, TEXTS[-1]), (2, "x" * 200_000)], "doc_id long, text string")
    first, second = sorted(tuple(r) for r in X.align_digest(docs).collect())
    assert first[1] > 20_000 and first[3] == first[4] and second[1] > 0 and second[4] >= 1


def test_links_and_groups(spark, plain):
    rows = [(k, t) for k, t in enumerate(TEXTS[:-1])]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS).repartition(2)
    pairs = {}
    for r in X.shared(docs).collect():
        pairs.setdefault(r.doc_id, set()).add((r.a, r.b))
    for r in X.align(docs).collect():
        a, b = plain(TEXTS[r.doc_id])
        assert (r.a, r.b) == ([k for k, _, _ in a], [k for k, _, _ in b])
        over = [(x, y, min(e, f) - max(s, t)) for x, (_, s, e) in enumerate(a) for y, (_, t, f) in enumerate(b) if min(e, f) > max(s, t)]
        assert [tuple(o) for o in r.overlaps] == over
        assert [tuple(o) for o in r.ends] == [(x, y) for x, y, _ in over if a[x][2] == b[y][2]]
        closed = sorted({e for _, _, e in a} & {e for _, _, e in b})
        for side, group in ((a, r.a_group), (b, r.b_group)):
            assert group == [sum(c < e for c in closed) for _, _, e in side]
        assert pairs.get(r.doc_id, set()) == {(x, y) for x, g in enumerate(r.a_group) for y, h in enumerate(r.b_group) if g == h}


def test_pair_counts(spark, plain):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS[:-1])], "doc_id long, text string")
    want = Counter((x, y) for t in TEXTS[:-1] for a, b in [plain(t)] for x, _, e in a for y, _, f in b if e == f)
    assert {(r.a, r.b): r.n for r in X.pair_counts(docs).collect()} == want


@pytest.mark.parametrize("terms", [1, 5, 1_000])
def test_product(terms):
    rng = np.random.default_rng(terms)
    for _ in range(20):
        n, k, m = rng.integers(0, 9, 3)
        left, right = rng.integers(0, 2, (n, k)), rng.integers(0, 2, (k, m))

        def csr(x):
            return np.concatenate(([0], np.cumsum(x.sum(axis=1)))).astype(np.int64), np.nonzero(x)[1]
        out = np.zeros((n, m), np.int64)
        for rows, cols, values in X.product(csr(left), csr(right), max(1, m), terms):
            out[rows, cols] += values
        assert (out == left @ right).all()
        turned = X.transposed(csr(left), k)
        assert all((turned[1][turned[0][c]:turned[0][c + 1]] == np.flatnonzero(left[:, c])).all() for c in range(k))


def test_both_encoders_agree():
    """The ranks stand in for the merges: on words of the vocabulary in any order, marks, digits, white space, all planes."""
    raw = open(X.TOKENIZER_A, "rb").read()
    encode, entries = X.byte_level(raw)
    slow = Tokenizer.from_str(raw.decode())
    slow.encode_special_tokens = True
    random.seed(5)
    parts = [e.decode(errors="ignore") for e in entries] + list("0123456789.,;:-_=/\\'\" \n\t ")
    texts = ["".join(random.choices(parts, k=random.randint(1, 8))) for _ in range(4_000)]
    texts += [f" a{chr(c)}b {chr(c)}{chr(c)}1 {chr(c)} " for c in range(0, 0x20000, 37) if not 0xD800 <= c < 0xE000]
    assert [encode(t) for t in texts] == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
