"""Decontamination against a plain search for every window."""

import hashlib
import random
import re

import pytest

from ingestkit.llm import decontaminate as D

SCHEMA = "doc_id long, text string, words int, items string, _text int"


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [(m.group(), m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]


def plain(text, items):
    words = [w for w, _ in words_of(text)]
    hit, found = set(), set()
    for item, body in items:
        own = [w for w, _ in words_of(body)]
        n = min(13, len(own))
        windows = {tuple(own[k:k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k:k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["aa", "Bé", "c3", "dd", "É", "x"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([5, 13, 14, 30, 60, 1])]
    items += [(10, None), (11, ""), (12, "!!!"), (13, items[3][1]), (None, "Null, item")]
    rows = []
    for k in range(120):
        text = [word() for _ in range(rng.randrange(80))]
        if k % 3:
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() if rng.random() < 0.3 else w + rng.choice(["", ",", "\n", " x"]) for w in rng.choice(items[:6])[1].split()] if k % 2 else (items[4][1] + "; " + items[4][1]).split()
        rows.append((k, rng.choice([" ", "  ", "-", "\t"]).join(text), 0, "", 0))
    rows += [(500, None, 0, "", 0), (501, "", 0, "", 0), (502, "...", 0, "", 0), (None, items[4][1], 0, "", 0), (503, items[4][1] * 1, 0, "", 0),
             (503, items[4][1] * 1, 0, "", 0), (504, ("filler " * 30_000) + items[3][1], 0, "", 0)]
    return (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"),
            rows, [("" if i is None else i, t) for i, t in items])


def _as(rows):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str)


def test_digest(tables):
    docs, benchmark, rows, items = tables
    want = sorted(((r[0], *plain(r[1], items)) for r in rows), key=str)
    assert _as(D.decontaminate_digest(docs, benchmark).collect()) == want


def test_blocks_of_items_give_the_same(tables):
    docs, benchmark, _, _ = tables
    keys = ["n_words", "n_hit", "words", "chars", "items", "contaminated"]
    one, many = (sorted(map(str, D.decontaminate(docs, benchmark, block_bytes=b).select("doc.doc_id", *keys).collect())) for b in (1 << 20, 300))
    assert one == many


def test_offsets_lead_to_the_original(tables):
    docs, benchmark, _, _ = tables
    for r in D.decontaminate(docs, benchmark).where("n_hit > 0").limit(40).collect():
        spots = words_of(r.doc.text)
        for span, chars in zip(r.words, r.chars):
            assert (chars.begin, chars.end) == (spots[span.begin][1][0], spots[span.end - 1][1][1])


def test_empty_tables(spark, tables):
    docs, benchmark, rows, _ = tables
    assert D.decontaminate_digest(docs.limit(0), benchmark).count() == 0
    clean = D.decontaminate_digest(docs, benchmark.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r.contaminated or r.n_hit for r in clean)
