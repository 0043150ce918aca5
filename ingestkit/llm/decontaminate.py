"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, one scan of every text.

Normalising maps bytes to bytes (A-Z to a-z, other ASCII outside 0-9 and a-z to a space; bytes of other letters stay), so
every place in the normalised text is a byte offset of the original. Words are what remains between spaces; a pattern is
13 consecutive words of an item (all of them if it has fewer), with a space before and after. The text is scanned as
``" w1 w2 … "``; word numbers of a hit are found by counting spaces, and original offsets from the words' own.

The benchmark is small against the corpus, but its size is checked: items are dealt into blocks of at most
``BLOCK_BYTES`` of text, each block becomes one automaton that is broadcast, and with more than one block the corpus is
scanned once per block, hits being merged in the row. A usual benchmark is one block. Rows are never shuffled.

Cases: null or empty texts and texts without words have no words, no hits and are not contaminated; null or empty items
match nothing; items of equal text are all reported; repeated rows are judged one by one; an empty benchmark hits
nothing; extra columns are left alone; long texts are scanned whole.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestkit.llm.common import fields, lean, others, written

WINDOW, SHARE, BLOCK_BYTES = 13, 20, 8 << 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def patterns(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> dict[str, set[str]]:
    """Pattern → ids of the items that hold it."""
    out: dict[str, set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - window + 1)) if words else ():
            key = " " + b" ".join(words[k:k + window]).decode("latin-1") + " "
            out.setdefault(key, set()).add(item)
    return out


def automaton(items: list[tuple[str, bytes | None]], window: int = WINDOW):
    made = ahocorasick.Automaton()
    for key, ids in patterns(items, window).items():
        made.add_word(key, (key.count(" ") - 1, tuple(sorted(ids))))
    made.make_automaton()
    return made


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(made, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit words as merged spans ``[from, to)``, items found."""
    words = words_of(text)
    if not words or not len(made):
        return len(words), [], set()
    line = " " + b" ".join(words).decode("latin-1") + " "
    spans, found, word, upto = [], set(), 0, 0
    for end, (n, ids) in made.iter(line):  # matches come in order of their end: spaces are counted onwards
        word += line.count(" ", upto, end)
        upto = end
        spans.append((word - n, word))
        found.update(ids)
    return len(words), _merged(spans), found


def offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words → spans of characters in the original text."""
    if not spans:
        return []
    places = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    out, seen, chars = [], 0, 0
    for a, b in spans:
        chars += len(text[seen:places[a][0]].decode("utf-8", "replace"))
        length = len(text[places[a][0]:places[b - 1][1]].decode("utf-8", "replace"))
        out.append((chars, chars + length))
        seen, chars = places[b - 1][1], chars + length
    return out


def _item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The items in blocks of about ``block_bytes`` at most; one block at a time is on the driver."""
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], bytes(r[1]) if r[1] is not None else None) for r in
               part.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("binary")).collect()]


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<begin:bigint,end:bigint>>"


def _scanned(rows: DataFrame, block: list[tuple[str, bytes | None]], window: int) -> DataFrame:
    """One scan with the automaton of one block; what earlier scans found stays in the row."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(automaton(block, window)))

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pickle.loads(shared.value)
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            counts, words, chars, items = [], [], [], []
            for cell, known, before in zip(cols["_text"], cols["words"], cols["items"]):
                text = cell.as_py()
                n, spans, found = scan(made, text)
                if len(before):
                    spans = _merged(spans + [(s["begin"], s["end"]) for s in known.as_py()])
                    found.update(before.as_py())
                counts.append(n)
                words.append([{"begin": a, "end": b} for a, b in spans])
                chars.append([{"begin": a, "end": b} for a, b in offsets(text, spans)] if spans else [])
                items.append(sorted(found))
            cols |= {"n_words": pa.array(counts, pa.int64()), "words": pa.array(words, _SPANS),
                     "chars": pa.array(chars, _SPANS), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return rows.mapInArrow(step, rows.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc`` (the row as a struct), ``n_words``, ``n_hit``, ``words`` (hit spans of words),
    ``chars`` (the same as character offsets in the original text), ``items``, ``contaminated``."""
    rows = docs.select(others(docs, text_col).alias("_rest"), F.col(f"`{text_col}`").cast("binary").alias("_text"),
                       F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS_SQL).alias("words"),
                       F.array().cast(_SPANS_SQL).alias("chars"), F.array().cast("array<string>").alias("items"))
    for k, block in enumerate(_item_blocks(fields(benchmark, item_id=item_col, text=item_text_col), block_bytes)):
        rows = _scanned(written(rows, "decontaminate") if k else rows, block, window)
    doc = F.struct(*[(F.col("_text").cast("string") if c == text_col else F.col("_rest").getField(c)).alias(c) for c in docs.columns])
    hit = F.aggregate("words", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return rows.select(doc.alias("doc"), "n_words", hit.alias("n_hit"), "words", "chars", "items").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    judged = decontaminate(docs.select("doc_id", "text"), benchmark)
    return judged.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


DECONTAMINATE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_aggregate(w[k:k + least(13, len(w)) - 1], 'string_agg', ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, k, n, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') AS win
           FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT r, k, p.n, item_id FROM places p JOIN windows USING (win)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""
