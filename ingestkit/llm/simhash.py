"""SimHash near-dedup by a self-join of the binary trie of all fingerprints.

A document's fingerprint has a bit set if more than half of the 64-bit hashes of its word shingles (repeats included) have
it; fingerprints link at ``BUDGET`` or fewer differing bits. Documents of equal fingerprints are one entry.

Distinct fingerprints make a binary trie. The join walks pairs of its nodes from (root, root): a pair's differing bits so
far are known, a pair of children adds one if their bits differ, and a pair beyond the budget is pruned with everything
below it. The upper levels are walked in Spark, ``LEVELS`` bits a round: a pair whose nodes hold more than ``LEAF`` entries
together is replaced by the pairs of their children, so a dense part of the trie is split further than a thin one and no
task holds more than ``LEAF`` entries. Entries are then sent to the pairs they belong to, and a task walks each pair bit by
bit on sorted arrays, where a node is a range: frontiers of node pairs are expanded with array operations, a bounded number
at a time, deepest first; small pairs of ranges are compared directly.

A walked pair gives, per entry, how many documents it links with and one link to the smallest entry it is connected to in
that pair: a forest, never all links. Large and small stars make components of the forests. No link is left out.

Cases: null and empty texts and texts without words have fingerprint zero, linked like any other; fewer words than a
shingle make one shingle of all; repeated rows are copies; rows without an id take part, and their component is null if no
document of it has an id; an empty table gives no rows; extra columns of any name are left alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestkit.llm.common import fields, joined_by_key, lookup, written
from ingestkit.llm.components import components

WORDS, BUDGET, SEED, BITS, LEVELS = 3, 3, 42, 64, 2
LEAF, LEAST_LEAF, SPREAD, FRONTIER, DIRECT, HELD = 1 << 20, 1 << 10, 4, 1 << 14, 64, 1 << 16

_U = np.uint64
_LOW = _U(0x0101010101010101)


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    import xxhash

    found = text.lower().split()  # bytes: ASCII letters are lowered, ASCII white space splits
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) for w in found]) + np.arange(len(found))
    begins = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[x:y], seed) for x, y in zip(begins[:len(found) - width + 1].tolist(), ends[width - 1:].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes. Eight counters stand in one number, each for one bit of a byte."""
    out = 0
    if len(hashes):
        starts = np.arange(0, len(hashes), 255)  # a counter of eight bits holds that many
        for k in range(8):
            sums = np.add.reduceat((hashes >> _U(k)) & _LOW, starts).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
            for byte in np.flatnonzero(2 * sums > len(hashes)).tolist():
                out |= 1 << (8 * byte + k)
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed number) of every row."""
    named = fields(docs, doc_id=id_col, text=text_col)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(shingle_hashes(c.as_buffer().to_pybytes(), words, seed)) if c.is_valid else 0 for c in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return named.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(step, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _prefix(depth: int) -> Column:
    """The node of an entry at a depth."""
    return F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")


def trie_pairs(entries: DataFrame, budget: int = BUDGET, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """The pairs of trie nodes within the budget: ``depth, p, q`` (prefixes, p <= q), none with more than ``leaf`` entries."""
    pairs, depth, done = entries.sparkSession.createDataFrame([(0, 0)], "p long, q long"), 0, []
    while True:
        # only nodes that are still in a pair are counted
        alive = written(pairs.select(F.col("p").alias("node")).union(pairs.select("q")).distinct(), "trie-alive")
        sized = written(entries.select(_prefix(depth).alias("node")).join(lookup(alive, alive.count()), "node").groupBy("node").agg(F.count("*").alias("n")), "trie-nodes")
        left, right = (sized.select(F.col("node").alias(k), F.col("n").alias(f"n{k}")) for k in "pq")
        held = F.when(F.col("p") == F.col("q"), F.col("np")).otherwise(F.col("np") + F.col("nq"))
        known = written(pairs.join(left, "p").join(right, "q").withColumn("wide", (held > leaf) & F.lit(depth < BITS)), "trie-pairs")
        done.append(known.where("NOT wide AND (p != q OR np > 1)").select(F.lit(depth).alias("depth"), "p", "q"))
        wide = known.where("wide")
        if wide.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        step = min(levels, BITS - depth)
        digit = F.explode(F.sequence(F.lit(0), F.lit((1 << step) - 1)))
        pairs = (wide.select("p", "q", digit.alias("x")).select("p", "q", "x", digit.alias("y"))
                 .select((F.shiftleft("p", step) + F.col("x")).alias("p"), (F.shiftleft("q", step) + F.col("y")).alias("q"))
                 .where((F.col("p") <= F.col("q")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= budget)))
        depth += step


class Joined:
    """Links found so far in one pair of nodes: documents linked per entry, and a forest over the entries."""

    def __init__(self, fps: np.ndarray, members: np.ndarray):
        self.fps, self.members = fps, members
        self.linked = np.zeros(len(fps), np.int64)
        self.root = np.arange(len(fps))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(x):
            np.add.at(self.linked, x, self.members[y])
            np.add.at(self.linked, y, self.members[x])
            self.held.append((x, y))
            self.waiting += len(x)
            if self.waiting > max(HELD, len(self.fps)):
                self.settle()

    def settle(self) -> None:
        """Every entry's root becomes the smallest entry it is connected to."""
        if self.held:
            x, y = (np.concatenate([h[k] for h in self.held]) for k in (0, 1))
            self.held, self.waiting = [], 0
            while True:
                x, y = self.root[x], self.root[y]
                apart = x != y
                if not apart.any():
                    break
                x, y = x[apart], y[apart]
                np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
                while True:
                    further = self.root[self.root]
                    if (further == self.root).all():
                        break
                    self.root = further


def walk(fps: np.ndarray, split: int, depth: int, budget: int, found: Joined) -> None:
    """Walk one pair of nodes: ``fps[:split]`` and ``fps[split:]``, each sorted; ``split`` = all for a node with itself.

    A frontier holds pairs of ranges with the bits by which they differ so far, at one depth; the deepest goes on first.
    """
    n, itself = len(fps), split == len(fps)
    differing = 0 if itself else ((int(fps[0]) ^ int(fps[split])) >> (BITS - depth)).bit_count()
    stack = [(depth, np.array([[0], [split], [0 if itself else split], [n], [differing]], np.int64))]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            stack.append((depth, pairs[:, FRONTIER:]))
            pairs = pairs[:, :FRONTIER]
        a, b, c, d, e = pairs
        small = (b - a) * (d - c) <= DIRECT
        if small.any():
            _compare(fps, pairs[:4, small], budget, found)
            a, b, c, d, e = pairs[:, ~small]
        if not len(a):
            continue
        middle, other = _middle(fps, a, b, depth), _middle(fps, c, d, depth)
        same = (a == c) & (b == d)  # a node with itself: its children meet once
        children = [np.stack((a, middle, c, other, e)), np.stack((middle, b, other, d, e)), np.stack((a, middle, other, d, e + 1)),
                    np.stack((middle, b, c, other, e + 1))[:, ~same]]
        down = np.concatenate(children, axis=1)
        down = down[:, (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= budget)]
        if down.shape[1]:
            stack.append((depth + 1, down))


def _middle(fps: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where the entries of a range begin to have the bit below ``depth`` set: a binary search in all ranges at once."""
    bit, low, high = _U(BITS - 1 - depth), low.copy(), high.copy()
    for _ in range(int((high - low).max()).bit_length()):
        at = (low + high) >> 1
        searching = low < high
        at = np.where(searching, at, np.maximum(low - 1, 0))
        one = ((fps[at] >> bit) & _U(1)).astype(bool)
        high = np.where(searching & one, at, high)
        low = np.where(searching & ~one, at + 1, low)
    return low


def _compare(fps: np.ndarray, ranges: np.ndarray, budget: int, found: Joined) -> None:
    """All entries of the one against all of the other, in ranges of at most ``DIRECT`` combinations."""
    a, b, c, d = ranges
    width, size = d - c, (b - a) * (d - c)
    owner = np.repeat(np.arange(len(a)), size)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    x, y = a[owner] + k // width[owner], c[owner] + k % width[owner]
    near = (x < y) & (np.bitwise_count(fps[x] ^ fps[y]) <= budget)
    found.add(x[near], y[near])


def trie_join(entries: DataFrame, budget: int = BUDGET, leaf: int | None = None) -> DataFrame:
    """``fp, members`` (distinct fingerprints) → ``a, b, linked``: rows of walked pairs, ``a`` connected to ``b``, and the
    number of documents ``a`` links with in that pair."""
    if leaf is None:  # small tables are split for the sake of more tasks; the result is the same
        leaf = max(LEAST_LEAF, min(LEAF, entries.count() // SPREAD))
    pairs = written(trie_pairs(entries, budget, leaf).withColumn("number", F.monotonically_increasing_id()), "trie-leaves")
    parts = [entries.select("fp", "members", F.lit(0).cast("long").alias("pair")).where("false")]
    for depth in sorted(r[0] for r in pairs.select("depth").distinct().collect()):  # at most BITS / LEVELS + 1
        own = pairs.where(F.col("depth") == depth)
        # number of the pair, depth, side
        key = F.shiftleft("number", 8) + 2 * depth
        sides = own.select(F.col("p").alias("node"), key.alias("pair")).union(own.where("p != q").select("q", key + 1))
        parts.append(entries.withColumn("node", _prefix(depth)).join(lookup(sides, 2 * own.count()), "node").select("fp", "members", "pair"))
    sent = functools.reduce(DataFrame.unionByName, parts).repartition(F.shiftright("pair", 8)).sortWithinPartitions("pair", "fp")

    def joined(pair: np.ndarray, fps: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
        split = int((pair & 1 == 0).sum())
        fps = fps.view(np.uint64)  # Spark sorted them with a sign
        order = np.concatenate((np.argsort(fps[:split], kind="stable"), split + np.argsort(fps[split:], kind="stable")))
        fps = fps[order]
        found = Joined(fps, members[order])
        walk(fps, split, int(pair[0] & 255) >> 1, budget, found)
        found.settle()
        some = np.flatnonzero(found.linked)
        return pa.RecordBatch.from_arrays([pa.array(fps[some].view(np.int64)), pa.array(fps[found.root[some]].view(np.int64)),
                                           pa.array(found.linked[some])], names=["a", "b", "linked"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # what was read of one pair, at most ``leaf`` entries
        for batch in batches:
            fps, members, pair = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = [0, *(np.flatnonzero(pair[1:] >> 8 != pair[:-1] >> 8) + 1).tolist(), len(pair)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if held and held[0][0][0] >> 8 != pair[begin] >> 8:
                    yield joined(*map(np.concatenate, zip(*held)))
                    held = []
                held.append((pair[begin:end], fps[begin:end], members[begin:end]))
        if held:
            yield joined(*map(np.concatenate, zip(*held)))

    return sent.mapInArrow(step, "a bigint, b bigint, linked bigint")


def join(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
         leaf: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hexadecimal digits), ``component_id``, ``n_links`` (other
    documents within the budget), ``class_fingerprint`` (of the component: there without ids as well)."""
    rows = written(fingerprints(docs, words, seed, id_col, text_col), "simhash")
    entries = written(rows.groupBy("fp").agg(F.count("*").alias("members"), F.min("doc_id").alias("least")), "simhash-entries")
    found = written(trie_join(entries.select("fp", "members"), budget, leaf), "simhash-forest")
    parts = written(components(found.where("a != b").select("a", "b")), "simhash-components")
    linked = found.groupBy(F.col("a").alias("fp")).agg(F.sum("linked").alias("linked"))
    known = (entries.join(parts.withColumnRenamed("node", "fp"), "fp", "left").join(linked, "fp", "left")
             .withColumn("component", F.coalesce("component", "fp")).withColumn("n_links", F.col("members") - 1 + F.coalesce("linked", F.lit(0))))
    known = written(known, "simhash-classes")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = known.select("fp", "members", "component", "n_links").join(least, "component")

    def digits(c: str) -> Column:
        return F.lower(F.lpad(F.hex(c), 16, "0"))

    return joined_by_key(rows, classes, "fp", "members").select("doc_id", digits("fp").alias("fingerprint"), "component_id", "n_links", digits("component").alias("class_fingerprint"))


def join_digest(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "fingerprint", "component_id")
