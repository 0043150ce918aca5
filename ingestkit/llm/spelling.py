"""Spelling variants by permuterm rotations.

A word of ``L`` code points with a terminator behind it has ``L + 1`` rotations ``Y$X`` (``X`` before the cut, ``Y`` after).
All rotations are sorted; a prefix range of the sorted rotations that skips one character holds neighbours: ``Y$X`` and one
more character are the words ``X?Y``, which differ by a replacement, and the rotation that ends with the prefix is the word
``XY``, which lacks that character. So every rotation is posted under itself (the word as it is) and under itself without
its last character (the edited one skipped), postings are sorted, and one scan goes over the groups of equal keys. All
members of a group are near each other, and a group has at most one word per character and one more, so it is small by
itself. A member needs only its group's size and its best other member, so the scan emits one row per member, not pairs.
A replacement is met in one group only. An indel is met once per character of the run it stands in and counted in the
first of them. Keys of words beyond ``LONG`` code points are hashes of 124 bits, computed for all cuts at once, as their
rotations would take the square of their length; words travel as numbers given in code-point order.

A form has at least ``RATIO`` times the occurrences of its word, so ways to the last form are short and acyclic; they are
halved per round (pointer jumping), in Spark.

Cases: null and empty texts have no words; a null id counts as an empty one in the hash that damages runs; texts of equal
id and text are damaged alike and both count; a deletion may leave an empty word, which is too short to stay; ties of form
go to the smaller word; an empty table gives no rows; extra columns of any name are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestkit.llm.common import fields, written

LEAST_LENGTH, LEAST_TIMES, RATIO, DAMAGE, LONG, FLUSH = 5, 3, 2, 97, 64, 200_000

#: UTF-8 of ``[a-zÀ-ÿ]+`` after ASCII letters were lowered.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_END = "$"
_PRIMES, _BASES = (2147483647, 2147483629, 2147483587, 2147483579), (1103515245, 1812433253, 1566083941, 1664525)


def damaged(owner: bytes, run: bytes, every: int) -> bytes:
    """``run`` without one code point if the CRC of ``owner:run`` says so."""
    h = zlib.crc32(owner + b":" + run)
    if h % every:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, damage: int | None = DAMAGE,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``. ``damage``: of every so many runs of a document one loses a code point (None: none does)."""
    named = fields(docs, doc_id=id_col, text=text_col)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            kept = [(w, n) for w, n in total.items() if len(w) >= least_length]  # bytes, so code points are judged below
            out = pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()),
                                              pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                runs = Counter(_RUN.findall(text.as_buffer().to_pybytes().lower()))
                if damage is None:
                    total.update(runs)
                else:
                    name = (owner or "").encode()
                    for run, n in runs.items():
                        total[damaged(name, run, damage)] += n
                if len(total) > FLUSH:
                    yield flushed()
        yield flushed()

    found = named.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(step, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least_times) & (F.char_length("word") >= least_length))


def _powers(n: int, base: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)))
    return out[:n]


def _hashed_keys(word: str) -> tuple[list[str], list[str]]:
    """The keys of a long word: of all its rotations, and of those that skip one character, in the order of the cuts.

    The key of ``Y$X`` is the polynomial of its characters in four prime fields; sums of the word before a cut give it at once.
    """
    codes, n = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64), len(word)
    whole, skipped = [], []
    for prime, base in zip(_PRIMES, _BASES):
        p = np.uint64(prime)
        up = _powers(n + 2, base, prime)
        weighted = codes * up[n - 1::-1] % p  # the last character counts once, the one before it ``base`` times
        before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64) % p))  # X, as it stands in the word
        after = (before[-1] + p - before) % p  # Y
        end = np.uint64(ord(_END))
        cuts = np.arange(n + 1)
        inverse = _powers(n + 2, pow(base, -1, prime), prime)
        own = before * inverse[n - cuts] % p  # X, as it stands at the end of the rotation
        whole.append(((after * up[cuts] % p) * up[1] + end * up[cuts] + own) % p)
        skipped.append(((after[1:] * up[cuts[:-1]] % p) * up[1] + end * up[cuts[:-1]] + own[:-1]) % p)  # X = word[:k], Y = word[k + 1:]

    def printed(parts: list[np.ndarray], length: int) -> list[str]:
        return [f"#{length}:{a:x}.{b:x}.{c:x}.{d:x}" for a, b, c, d in zip(*(x.tolist() for x in parts))]

    return printed(whole, n + 1), printed(skipped, n)


def keys(word: str, long: int = LONG) -> tuple[list[str], list[str]]:
    """Keys of the rotations of ``word`` and of the rotations that skip a character.

    Both kinds of a key have one length, that of ``Y$X``, so words on both sides of the bound ``long`` still meet.
    """
    n = len(word)
    whole = [word[k:] + _END + word[:k] for k in range(n + 1)] if n < long else None
    skipped = [word[k + 1:] + _END + word[:k] for k in range(n)] if n <= long else None
    if whole is None or skipped is None:
        hashed = _hashed_keys(word)
        whole, skipped = whole or hashed[0], skipped or hashed[1]
    return whole, skipped


def rotations(words: DataFrame, long: int = LONG) -> DataFrame:
    """``number, word, n`` → postings ``key, number, n, edited, counts``: ``counts`` marks the first of a run of characters."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for number, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                whole, skipped = keys(word, long)
                size = len(whole) + len(skipped)
                out[0] += whole
                out[0] += skipped
                out[1] += [number] * size
                out[2] += [n] * size
                out[3] += [False] * len(whole) + [True] * len(skipped)
                out[4] += [False] * len(whole) + [k == 0 or word[k - 1] != c for k, c in enumerate(word)]
                if len(out[0]) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    names, types = ["key", "number", "n", "edited", "counts"], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    return words.select("number", "word", "n").mapInArrow(step, "key string, number bigint, n bigint, edited boolean, counts boolean")


def scan_groups(keys: pa.Array, number: np.ndarray, n: np.ndarray, edited: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted whole groups (within a group by falling ``n``, then ``number``) → ``number, near, best_n, best`` of members with neighbours."""
    starts = np.flatnonzero(np.concatenate(([True], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))))
    sizes = np.diff(np.append(starts, len(keys)))
    group = np.repeat(np.arange(len(starts)), sizes)
    replaced, indels = np.add.reduceat(edited.astype(np.int64), starts)[group], np.add.reduceat(counts.astype(np.int64), starts)[group]
    shorter = sizes[group] - replaced  # 1 if the word that lacks the character is there
    near = np.where(edited, replaced - 1 + shorter * counts, indels)
    first = starts[group]
    best = np.where(np.arange(len(keys)) == first, np.minimum(first + 1, len(keys) - 1), first)
    alone = sizes[group] > 1
    return number[alone], near[alone], n[best][alone], number[best][alone]


def neighbours(postings: DataFrame) -> DataFrame:
    """``number, n_near, best_n, best`` of every word that has a near one."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scanned(table: pa.RecordBatch) -> pa.RecordBatch:
            columns = [c.to_numpy(zero_copy_only=False) for c in table.columns[1:]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in scan_groups(table.column(0), *columns)],
                                              names=["number", "near", "best_n", "best"])

        held: list[pa.RecordBatch] = []  # the last group of what was read may go on
        for batch in batches:
            if not len(batch):
                continue
            one = pa.concat_batches([*held, batch]) if held else batch
            same = pc.equal(one.column(0), one.column(0)[-1]).to_numpy(zero_copy_only=False)
            cut = int(len(one) - same.sum())
            if cut:
                yield scanned(one.slice(0, cut))
            held = [one.slice(cut)]
        if held:
            yield scanned(held[0])

    sorted_ = postings.repartition("key").sortWithinPartitions("key", F.desc("n"), "number")
    seen = sorted_.mapInArrow(step, "number bigint, near bigint, best_n bigint, best bigint")
    return seen.groupBy("number").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("best"))).alias("top")).select(
        "number", "n_near", F.col("top.best_n").alias("best_n"), (-F.col("top.best")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``number, form`` (null: none) → ``number, root``. Every round doubles the steps a pointer spans, until all end."""
    ways = written(forms.select("number", F.coalesce("form", "number").alias("root")), "spelling-ways")
    while True:
        further = ways.where("number != root").select(F.col("number").alias("_at"), F.col("root").alias("_further"))
        if further.join(ways.select("root"), F.col("_at") == F.col("root"), "left_semi").isEmpty():
            return ways
        ways = written(ways.join(further, F.col("root") == F.col("_at"), "left").select("number", F.coalesce("_further", "root").alias("root")), "spelling-ways")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, ratio: int = RATIO, damage: int | None = DAMAGE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word that occurs often enough.

    ``form`` is the near word with most occurrences, if these are at least ``ratio`` times (2 or more) the word's own.
    """
    if ratio < 2:
        raise ValueError("a form needs at least twice the occurrences, or forms could go in circles")
    counted = written(word_counts(docs, least_length, least_times, damage, id_col, text_col), "spelling-counts")
    # numbers rise with the words: ranges of words are sorted, and so are the numbers of ranges
    words = written(counted.orderBy("word").withColumn("number", F.monotonically_increasing_id()), "spelling-words")
    near = written(words.join(neighbours(rotations(words)), "number", "left"), "spelling-near")
    chosen = near.select("number", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")).alias("form"))
    ends = roots(chosen)
    named = words.select("number", F.col("word").alias("_word"), F.col("n").alias("_n"))
    result = (near.select("number", "word", "n", "n_near").join(chosen, "number").join(ends, "number")
              .join(named.select(F.col("number").alias("form"), F.col("_word").alias("form_word"), F.col("_n").alias("form_n")), "form", "left")
              .join(named.select(F.col("number").alias("root"), F.col("_word").alias("root_word")), "root"))
    return result.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_word").alias("form"), "form_n",
                         F.col("root_word").alias("root"))


def variants_digest(docs: DataFrame) -> DataFrame:
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


#: Near words share a form without one character (deleted from one, or from both at one place); CRC-32 is spelled out byte by byte.
VARIANTS_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zA-Z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)]::BIGINT[] END))),
    lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM each, crc),
cut AS (SELECT n, CASE WHEN h % 97 = 0 THEN concat(left(run, (h % length(run))::INT), substr(run, (h % length(run))::INT + 2)) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
skipped AS (SELECT word, k, concat(left(word, k), '$', substr(word, k + 2)) AS hole, concat(left(word, k), substr(word, k + 2)) AS rest
            FROM (SELECT word, unnest(range(0, length(word)))::INT AS k FROM words)),
pairs AS (
  SELECT a.word AS x, b.word AS y FROM skipped a JOIN skipped b USING (hole) WHERE a.word <> b.word
  UNION SELECT s.word, w.word FROM skipped s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM skipped s JOIN words w ON s.rest = w.word),
near AS (SELECT x, count(*) AS n_near, arg_max({'w': y, 'n': n}, {'n': n, 'r': -r}) AS top
         FROM pairs JOIN (SELECT *, row_number() OVER (ORDER BY encode(word)) AS r FROM words) p ON p.word = y GROUP BY x),
forms AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top.n >= 2 * n THEN top.w END AS form, CASE WHEN top.n >= 2 * n THEN top.n END AS form_n
          FROM words LEFT JOIN near ON x = word),
ways(word, last, form) AS (SELECT word, word, form FROM forms UNION ALL SELECT ways.word, f.word, f.form FROM ways JOIN forms f ON f.word = ways.form)
SELECT f.word, f.form, w.last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ways w ON w.word = f.word AND w.form IS NULL"""
