"""Alignment of the tokens that two tokenizers cut one text into, by products of sparse incidence matrices.

Tokenizer A is a byte-level BPE (a ``tokenizers`` JSON file) and reads a space and the text; tokenizer B is a piece model
(``sentencepiece``) and puts that space itself. Tokens are rows of 0/1 matrices in compressed sparse rows, built by hand:
their columns are the bytes of the text. ``product`` multiplies by Gustavson's rule, a row of the result being the sum of
the rows of the right matrix that the left row names: tokens x bytes of A times bytes x tokens of B gives, per pair of
overlapping tokens, the bytes they share (overlap links). Bytes at which both end cut the tokens into groups; tokens x
groups of A times groups x tokens of B gives the pairs that share a group. Texts of one piece of a batch stand in one
block-diagonal matrix, in pieces of about ``PIECE`` bytes, and a product is formed in blocks of ``PRODUCTS`` terms.

``align`` returns tokens, links and groups, ``shared`` the pairs of a group, ``pair_counts`` how often two ids are linked in
the whole corpus, ``align_digest`` sums per document. Two linked ids end together, so the bytes of one end those of the
other: there are at most as many id pairs as the entries of both vocabularies have bytes (with ids of equal bytes counted
apart), however large the corpus. Only that table is gathered and sent to all tasks.

Cases: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros, empty
lists, an empty ``groups_sha256``. Special tokens in a text are plain text. Repeated rows, and rows with a null id, are
documents of their own; an empty table gives no rows; extra columns of any name are left alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestkit.llm.common import fields, written

TOKENIZER_A, TOKENIZER_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
PIECE, PRODUCTS = 1 << 18, 1 << 20

#: Fixed value: the pattern that the byte-level pre-tokenizer splits by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Csr = tuple[np.ndarray, np.ndarray]  # where each row begins (and the last ends), the columns of all rows


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printable bytes for themselves, the others from U+0100 upwards."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_level(raw: bytes) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """Encoder and token bytes of a byte-level BPE file.

    Where ids are numbered in the order of the merges, ranks and merges say the same, and tiktoken, several times as fast,
    encodes; any other file is encoded by its own library.
    """
    from tokenizers import Tokenizer

    told, alphabet = json.loads(raw), byte_alphabet()
    vocabulary, added = told["model"]["vocab"], {t["content"] for t in told["added_tokens"]}
    spelled = {token: bytes(alphabet[c] for c in token) if token not in added else token.encode() for token in vocabulary}
    entries = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        entries[number] = spelled[token]
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in told["model"]["merges"]]
    numbers = [vocabulary[m] for m in merges]
    plain = told["normalizer"] is None and told["pre_tokenizer"] == {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and numbers == list(range(256, 256 + len(numbers))) and not told["model"].get("ignore_merges"):
        import tiktoken

        ranks = {spelled[t]: n for t, n in vocabulary.items() if t not in added}
        return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, entries
    slow = Tokenizer.from_str(raw.decode())
    slow.encode_special_tokens = True
    return lambda text: slow.encode(text, add_special_tokens=False).ids, entries


def piece_level(raw: bytes) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """Encoder and token bytes of a piece model with byte fallback."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=raw)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    entries = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
    return lambda text: model.encode(text, num_threads=1), entries


def transposed(matrix: Csr, width: int) -> Csr:
    begins, columns = matrix
    rows = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.argsort(columns, kind="stable")
    return np.concatenate(([0], np.cumsum(np.bincount(columns, minlength=width)))), rows[order]


def product(left: Csr, right: Csr, width: int, terms: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The product of two 0/1 matrices as blocks of ``rows, columns, values``, ordered by row and column.

    ``width`` is the number of columns of ``right``. A block holds whole rows of at most ``terms`` products, or one row.
    """
    begins, columns = left
    lengths = np.diff(right[0])[columns]
    upto = np.concatenate(([0], np.cumsum(lengths)))[begins]
    first, n = 0, len(begins) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + terms, "right")) - 1)
        named = slice(begins[first], begins[last])
        length = lengths[named]
        rows = np.repeat(np.repeat(np.arange(first, last), np.diff(begins[first:last + 1])), length)
        shift = np.repeat(right[0][columns[named]] - (np.cumsum(length) - length), length)
        keys = rows * width + right[1][shift + np.arange(len(shift))]
        if len(keys) > 1 and (keys[1:] < keys[:-1]).any():
            keys.sort()
        starts = np.flatnonzero(np.concatenate(([len(keys) > 0], keys[1:] != keys[:-1])))
        found = keys[starts]
        yield found // width, found % width, np.diff(np.append(starts, len(keys)))
        first = last


class Aligned(NamedTuple):
    """The tokens of several texts one after the other; token numbers count through all of them."""

    a: np.ndarray            # ids
    b: np.ndarray
    a_upto: np.ndarray       # tokens before each text, and of all
    b_upto: np.ndarray
    overlaps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # blocks: token of A, token of B, bytes shared
    ends: tuple[np.ndarray, np.ndarray]  # tokens of A and B that end together; the k-th pair closes group k

    def groups(self, side: int) -> np.ndarray:
        """The group of every token of a side."""
        return np.searchsorted(self.ends[side], np.arange(len((self.a, self.b)[side])))


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens x bytes for tokens that follow each other."""
    begins = np.concatenate(([0], np.cumsum(lengths)))
    return begins, np.arange(begins[-1])


def aligned(a: list[list[int]], b: list[list[int]], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Links of the tokens of several texts; both lists of ids spell the same bytes."""
    a_upto, b_upto = (np.concatenate(([0], np.cumsum([len(t) for t in side], dtype=np.int64))) for side in (a, b))
    flat_a, flat_b = (np.fromiter((k for t in side for k in t), np.int64, n) for side, n in ((a, a_upto[-1]), (b, b_upto[-1])))
    left, right = incidence(a_sizes[flat_a]), incidence(b_sizes[flat_b])
    blocks = list(product(left, transposed(right, int(right[0][-1])), max(1, len(flat_b))))
    together = [left[0][1:][x] == right[0][1:][y] for x, y, _ in blocks]
    ends = tuple(np.concatenate([block[side][same] for block, same in zip(blocks, together)] or [np.empty(0, np.int64)]) for side in (0, 1))
    return Aligned(flat_a, flat_b, a_upto, b_upto, blocks, ends)


def shared_blocks(found: Aligned) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of tokens of one group: the product of both group incidences."""
    n = len(found.ends[0])
    left, right = ((np.arange(len(g) + 1), g) for g in (found.groups(0), found.groups(1)))
    for x, y, _ in product(left, transposed(right, n), max(1, len(found.b))):
        yield x, y


class Loaded:
    """Both tokenizers inside a task, with their entries' bytes, sizes and printed ids."""

    def __init__(self, a: bytes, b: bytes):
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = byte_level(a), piece_level(b)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in e], np.int64) for e in (self.bytes_a, self.bytes_b))
        self.printed: list[str] | None = None

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        whole = b" " + text.encode()
        a = self.encode_a(" " + text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole:
            return [], []
        b = self.encode_b(text)
        return (a, b) if b"".join(map(self.bytes_b.__getitem__, b)) == whole else ([], [])

    def spelled(self, found: Aligned) -> list[str]:
        """Per text ``a1,a2|b1;a3|b2,b3``: every id is printed with the sign behind it."""
        if self.printed is None:
            self.printed = [f"{k}{sign}" for sign in ",|;" for k in range(max(len(self.bytes_a), len(self.bytes_b)))]
        size = len(self.printed) // 3
        a, b = found.a.copy(), found.b.copy()
        a[found.ends[0]] += size        # the last of a group
        b[found.ends[1]] += 2 * size
        out = np.empty(len(a) + len(b), np.int64)
        closed = np.concatenate(([-1], found.ends[1]))  # all tokens of B of earlier groups stand before a token of A
        out[np.arange(len(a)) + closed[found.groups(0)] + 1] = a
        out[np.arange(len(b)) + found.ends[0][found.groups(1)] + 1] = b
        upto, printed = (found.a_upto + found.b_upto).tolist(), self.printed
        return ["".join(map(printed.__getitem__, out[x:y].tolist()))[:-1] for x, y in zip(upto, upto[1:])]


def pieces(batch: pa.RecordBatch, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``size`` bytes of text: a long text may be a piece of its own."""
    lengths = [len(c.as_buffer()) if c.is_valid else 0 for c in batch.column(1)]
    first, held = 0, 0
    for k, n in enumerate(lengths):
        if held and held + n > size:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if len(batch) > first:
        yield batch.slice(first)


def _mapped(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, made: Callable[[pa.Array, Aligned, Loaded], Iterator[pa.RecordBatch]],
            schema: str) -> DataFrame:
    """Run ``made`` over the aligned texts of every piece. The driver reads both files and sends them along."""
    raw = []
    for path in (tokenizer_a, tokenizer_b):
        with open(path, "rb") as f:
            raw.append(f.read())
    sent = docs.sparkSession.sparkContext.broadcast(tuple(raw))  # two vocabulary files

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = None
        for batch in batches:
            for piece in pieces(batch):
                loaded = loaded or Loaded(*sent.value)
                both = [loaded.tokens(t) for t in piece.column(1).to_pylist()]
                yield from made(piece.column(0), aligned([x for x, _ in both], [y for _, y in both], loaded.sizes_a, loaded.sizes_b), loaded)

    return docs.mapInArrow(step, schema)


def _lists(values: pa.Array, upto: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), values)


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def align(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, token ids ``a`` and ``b``, the group of every token ``a_group`` and ``b_group`` (from 0),
    ``overlaps`` (token of A, token of B, bytes shared) and ``ends`` (tokens that end together); tokens are numbered from 0."""
    docs = fields(docs, doc_id=id_col, text=text_col)

    def made(ids: pa.Array, found: Aligned, _: Loaded) -> Iterator[pa.RecordBatch]:
        x, y, n = (np.concatenate([o[k] for o in found.overlaps] or [np.empty(0, np.int64)]) for k in range(3))
        columns = [ids, _lists(pa.array(found.a, pa.int32()), found.a_upto), _lists(pa.array(found.b, pa.int32()), found.b_upto)]
        for side, upto in ((0, found.a_upto), (1, found.b_upto)):
            group = found.groups(side)
            starts = np.concatenate((group, [len(found.ends[0])]))[np.minimum(upto[:-1], len(group))]
            columns.append(_lists(pa.array(group - np.repeat(starts, np.diff(upto)), pa.int32()), upto))
        for rows, cols, more in ((x, y, [n]), (*found.ends, [])):
            text = np.searchsorted(found.a_upto, rows, "right") - 1
            parts = [rows - found.a_upto[text], cols - found.b_upto[text], *more]
            packed = pa.StructArray.from_arrays([pa.array(p, pa.int32()) for p in parts], names=["a", "b", "bytes"][:len(parts)])
            columns.append(_lists(packed, np.searchsorted(rows, found.a_upto)))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "b", "a_group", "b_group", "overlaps", "ends"])

    return _mapped(docs, tokenizer_a, tokenizer_b, made, f"doc_id {_id_type(docs)}, a array<int>, b array<int>, a_group array<int>, b_group array<int>, "
                   "overlaps array<struct<a:int,b:int,bytes:int>>, ends array<struct<a:int,b:int>>")


def shared(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, a, b``: all pairs of tokens (numbered from 0 in their text) that share a group, a block of rows at a time."""
    docs = fields(docs, doc_id=id_col, text=text_col)

    def made(ids: pa.Array, found: Aligned, _: Loaded) -> Iterator[pa.RecordBatch]:
        for x, y in shared_blocks(found):
            text = np.searchsorted(found.a_upto, x, "right") - 1
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), pa.array(x - found.a_upto[text], pa.int32()),
                                              pa.array(y - found.b_upto[text], pa.int32())], names=["doc_id", "a", "b"])

    return _mapped(docs, tokenizer_a, tokenizer_b, made, f"doc_id {_id_type(docs)}, a int, b int")


def _summed(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """Per row the counts, the digest of its groups and its distinct linked id pairs (``pair`` = a * 2^32 + b) with their counts."""
    def made(ids: pa.Array, found: Aligned, loaded: Loaded) -> Iterator[pa.RecordBatch]:
        rows, cols = found.ends
        upto = np.searchsorted(rows, found.a_upto)
        n = np.diff(upto)
        text, pair = np.repeat(np.arange(len(ids)), n), found.a[rows] << 32 | found.b[cols]
        order = np.lexsort((pair, text))
        text, pair = text[order], pair[order]
        first = np.flatnonzero(np.concatenate(([len(pair) > 0], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1]))))
        lists = np.searchsorted(text[first], np.arange(len(ids) + 1))
        digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in loaded.spelled(found)]
        yield pa.RecordBatch.from_arrays(
            [ids, *(pa.array(np.diff(u), pa.int64()) for u in (found.a_upto, found.b_upto)), pa.array(n, pa.int64()), pa.array(n, pa.int64()),
             pa.array(digests, pa.string()), _lists(pa.array(pair[first], pa.int64()), lists),
             _lists(pa.array(np.diff(np.append(first, len(pair))), pa.int64()), lists)],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return _mapped(docs, tokenizer_a, tokenizer_b, made, f"doc_id {_id_type(docs)}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                   "groups_sha256 string, pairs array<bigint>, times array<bigint>")


def _counted(summed: DataFrame) -> DataFrame:
    one = summed.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = one.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    return counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "n")


def pair_counts(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``a, b, n``: how many links of the corpus hold these ids."""
    return _counted(_summed(fields(docs, doc_id=id_col, text=text_col), tokenizer_a, tokenizer_b)).select("a", "b", "n")


def align_digest(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    rows = written(_summed(fields(docs, doc_id="doc_id", text="text"), tokenizer_a, tokenizer_b), "aligned")
    table = _counted(rows).select("pair", "n").toPandas().sort_values("pair")  # bounded by the two vocabularies, see above
    pair, n = table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64)
    _, own = np.unique(pair & ((1 << 32) - 1), return_inverse=True)
    top = np.zeros(own.max(initial=-1) + 1, np.int64)
    np.maximum.at(top, own, n)
    sent = docs.sparkSession.sparkContext.broadcast((pair, n, n == top[own]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            pairs, times = batch.column(6), batch.column(7)
            at = np.searchsorted(pair, pairs.flatten().to_numpy(zero_copy_only=False))
            count = times.flatten().to_numpy(zero_copy_only=False)
            upto = np.concatenate(([0], np.cumsum(pc.list_value_length(pairs).to_numpy(zero_copy_only=False))))
            sums = [np.diff(np.concatenate(([0], np.cumsum(v)))[upto]) for v in (count * best[at], count * n[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(s, pa.int64()) for s in sums), batch.column(5)],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(step, f"doc_id {_id_type(rows)}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
                           "count_sum bigint, groups_sha256 string")
