"""N-gram Jaccard join with grouped prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles is at least ``percent`` / 100. A document
of n shingles shares at least ``ceil(percent * n / 100)`` of them with any partner, so under one fixed order of all
shingles two partners share one among their first ``n - ceil(percent * n / 100) + 1``: the prefix. The order is rarest
first, by a count sketch of fixed size over all documents, ties by hash; any order is exact, a good one is short.

1. Documents of equal sets are one node (its key is a hash of the set). Nodes with equal prefix and size are one group.
2. Groups are posted under the shingles of their prefix, once. Shingles posted for one node only are dropped.
3. Filter group pairs: in every posting, and there in every range of sizes, groups meet the group whose shingles are
   most frequent on the whole: in a family of near copies that is the least edited one. Two overlapping ranges per size
   make all sizes that can link meet. The groups of these pairs are expanded to their nodes; pairs whose prefixes leave
   too little to share are dropped, the others are verified on whole sets.
4. Links make components. A posting all of whose nodes are in one component is done: no link in it can change the
   result. In the others the nodes outside the posting's main component meet the others of different component, if the
   length and the place of the shingle in both prefixes leave enough to share. Those pairs are verified as well.
   This is the exact rest: every pair that could link is in one component or was verified. Nothing is capped.

A family of k near copies thus costs about k pairs instead of k * k / 2. Only pairs of representatives meet, never
copies. Sets are computed again for verification instead of being stored for all documents.

Cases: null or empty text and text without words have no shingles and are linked with nothing (``component_id`` is the
row's own id); fewer words than a shingle make one shingle of all; repeated rows are copies; rows without an id take
part, and their component is null where it has no id; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ingestkit.llm.common import arrow_rows, fields, lean, lookup, others, written
from ingestkit.llm.components import components
from ingestkit.llm.shingles import mixed, shingles, signed

WORDS, PERCENT, SKETCH_BITS, PARTS = 4, 85, 20, 64


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        yield batch, batch.column(batch.schema.get_field_index("text")).to_pylist()


def frequency_sketch(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """How many documents hold a shingle of each of 2^bits hash ranges. Tasks count all ranges; their counts are added up in
    ``PARTS`` parts at most, which is also how the driver gets them."""
    shift, parts = np.uint64(64 - bits), min(PARTS, 1 << bits)
    kind = "part int, counts binary"

    def rows(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
        packed = [zlib.compress(t.tobytes(), 1) for t in totals.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n = np.zeros(1 << bits, np.int64), [], 0
        for _, texts in _texts(batches):
            for text in texts:
                ids = shingles(text, words) >> shift
                waiting.append(ids.astype(np.int64))
                n += len(ids)
                if 4 * n > 1 << bits:
                    total += np.bincount(np.concatenate(waiting), minlength=1 << bits)
                    waiting, n = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=1 << bits)
        yield rows(dict(enumerate(np.split(total, parts))))

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(zlib.decompress(counts.as_buffer()), np.int64)
                totals[part] = totals[part] + more if part in totals else more
        yield rows(totals)

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, kind).repartition("part").mapInArrow(add, kind)
    out = np.zeros((parts, (1 << bits) // parts), np.int64)
    for part, counts in counted.collect():  # 2^bits counts, whatever the corpus
        out[part] = np.frombuffer(zlib.decompress(bytes(counts)), np.int64)
    return out.ravel()


def profiles(docs: DataFrame, words: int, percent: int, sketch, bits: int) -> DataFrame:
    """Per row: ``doc_id, n`` (set size), ``key`` (of the set), ``weight`` (mean log frequency), ``prefix``; ``own`` if there is one."""
    own = [f for f in docs.schema.fields if f.name == "own"]

    shift = np.uint64(64 - bits)

    @lean
    def profile(batches):
        for batch, texts in _texts(batches):
            n, keys, weights, prefixes = [], [], [], []
            for text in texts:
                found = shingles(text, words)
                n.append(len(found))
                if not len(found):
                    keys.append(None)
                    weights.append(0.0)
                    prefixes.append([])
                    continue
                frequency = sketch.value[(found >> shift).astype(np.int64)]
                size = len(found) - -(-percent * len(found) // 100) + 1
                least = np.lexsort((found, frequency))[:size]
                keys.append(_key(found))
                weights.append(float(np.log(frequency + 1.0).mean()))
                prefixes.append(signed(found[least]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(batch.schema.get_field_index("doc_id")), "n": pa.array(n, pa.int64()), "key": pa.array(keys, pa.int64()),
                "weight": pa.array(weights, pa.float64()), "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                **{f.name: batch.column(batch.schema.get_field_index(f.name)) for f in own}})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *[f.name for f in own]).mapInArrow(
        profile, f"doc_id {id_type}, n bigint, key bigint, weight double, prefix array<bigint>" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in own))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def most_shared(x: np.ndarray, nx: int, y: np.ndarray, ny: int, sketch: np.ndarray, shift: np.uint64) -> int:
    """How many shingles two sets can share at most, from their sizes and prefixes alone.

    The prefix that ends first has all its partners inside the other; what lies behind it can at best be shared whole.
    """
    fx, fy = sketch[(x >> shift).astype(np.int64)], sketch[(y >> shift).astype(np.int64)]
    if (fx[-1], x[-1]) > (fy[-1], y[-1]):
        x, nx, fx, y, ny, fy = y, ny, fy, x, nx, fx
    passed = int(((fy < fx[-1]) | ((fy == fx[-1]) & (y <= x[-1]))).sum())
    return len(np.intersect1d(x, y, assume_unique=True)) + min(nx - len(x), ny - passed)


def plausible(pairs: DataFrame, nodes: DataFrame, sketch, bits: int, percent: int) -> DataFrame:
    """The pairs whose prefixes leave enough to share."""
    shift = np.uint64(64 - bits)

    @lean
    def check(batches):
        for batch in batches:
            a, b, nx, x, ny, y = (batch.column(k) for k in range(6))
            keep = [(100 + percent) * most_shared(np.array(p.values, np.int64).view(np.uint64), n, np.array(q.values, np.int64).view(np.uint64), m, sketch.value, shift)
                    >= percent * (n + m) for n, p, m, q in zip(nx.to_pylist(), x, ny.to_pylist(), y)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = [nodes.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("prefix").alias(f"p{k}")) for k in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "pa", "nb", "pb").mapInArrow(check, "a bigint, b bigint")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b`` (keys of nodes) → those that link, checked on the sets of whole texts."""
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = written(wanted.join(nodes.select("key", "doc_id"), "key").select("key", F.col("doc_id").alias("_id")), "join-wanted")

    @lean
    def sets(batches):
        for batch, texts in _texts(batches):
            out = [shingles(t, words) for t in texts]
            yield pa.RecordBatch.from_pydict({"key": batch.column(batch.schema.get_field_index("key")), "set": pa.array([s.tobytes() for s in out], pa.binary()),
                                              "own": pa.array([_key(s) for s in out], pa.int64())})

    chosen = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        lookup(wanted, wanted.count()), F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", "text")
    # an id may stand for several texts: the one whose set has the key is meant
    held = written(chosen.mapInArrow(sets, "key bigint, set binary, own bigint").where("key = own").dropDuplicates(["key"]).select("key", "set"), "join-sets")

    @lean
    def check(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            keep = [linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(held.select(F.col("key").alias("a"), F.col("set").alias("x")), "a")
            .join(held.select(F.col("key").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
            .mapInArrow(check, "a bigint, b bigint"))


def _key(found: np.ndarray) -> int | None:
    if not len(found):
        return None
    ranks = np.arange(1, len(found) + 1, dtype=np.uint64)
    return int(signed(mixed(np.sum(mixed(found + ranks), dtype=np.uint64, keepdims=True)))[0])


def _compatible(n: Column, m: Column, percent: int) -> Column:
    return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bits: int = SKETCH_BITS, id_col: str = "doc_id",
         text_col: str = "text", own_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, n_links, set_key, component``; with ``own_col`` also that
    column, as ``own``.

    ``component`` is the key of one of the component's sets: unlike ``component_id`` it is there without ids and no two
    components share it. ``n_links`` counts the links that were verified for the document's set, enough of them to make the component.
    """
    docs = fields(docs, doc_id=id_col, text=text_col, **({"own": own_col} if own_col else {}))
    spark = docs.sparkSession
    with arrow_rows(spark):
        sketch = spark.sparkContext.broadcast(frequency_sketch(docs, words, bits))  # 2^bits counts, whatever the corpus
        joined = _joined(docs, words, percent, sketch, bits)
    sketch.destroy()  # all that used it is written
    return joined


def _joined(docs: DataFrame, words: int, percent: int, sketch, bits: int) -> DataFrame:
    rows = written(profiles(docs, words, percent, sketch, bits), "join-profiles")
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    first = rows.where("n > 0").select("key", F.col("doc_id").alias("_id"), "weight", "prefix").join(
        classes, "key").where(F.col("_id").eqNullSafe(F.col("doc_id"))).drop("_id").dropDuplicates(["key"])
    nodes = written(first.withColumn("group", F.xxhash64("n", "prefix")), "join-nodes")
    groups = nodes.groupBy("group").agg(F.first("n").alias("n"), F.count("*").alias("members"),
                                        F.max(F.struct("weight", "key")).alias("lead"), F.min("key").alias("_min"))
    groups = written(groups, "join-groups")
    prefixed = nodes.select("key", "group", "prefix").join(groups.select(F.col("_min").alias("key"), "members"), "key")
    posted = prefixed.select("group", "members", F.posexplode("prefix").alias("place", "token"))
    # one exchange of the postings: most shingles are posted once and end here
    shared = written(posted.withColumn("_n", F.sum("members").over(Window.partitionBy("token"))).where("_n > 1").drop("_n", "members"), "join-shared")
    postings = written(shared.join(groups.select("group", "n", "members", "lead"), "group"), "join-postings")

    # every posting meets its most central group, in two overlapping ranges of sizes
    step = math.log(100 / percent)
    band = F.floor(F.log(F.col("n")) / step).cast("int")
    ranged = postings.withColumn("band", F.explode(F.array(band, band + 1)))
    leaders = ranged.groupBy("token", "band").agg(F.max(F.struct("lead.weight", "lead.key", "n")).alias("top"))
    stars = (ranged.join(leaders, ["token", "band"]).where(_compatible(F.col("n"), F.col("top.n"), percent))
             .select(F.col("top.key").alias("a"), "group").distinct())
    inner = groups.where("members > 1").select(F.col("lead.key").alias("a"), "group")
    expanded = stars.unionByName(inner).join(nodes.select("group", F.col("key").alias("b")), "group")
    stars = written(plausible(_ordered(expanded), nodes, sketch, bits, percent), "join-stars")
    links = written(verify(stars, nodes, docs, words, percent), "join-links")
    parts = written(components(links), "join-components")

    # the exact rest: pairs of different components in postings that are not settled
    member = (postings.select("token", "place", "group").join(nodes.select("group", "key", "n"), "group")
              .join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("component", "key")).drop("component", "group"))
    member = written(member, "join-members")
    sizes = member.groupBy("token", "part").agg(F.count("*").alias("c"))
    main = sizes.groupBy("token").agg(F.max(F.struct("c", "part")).alias("top"), F.count("*").alias("k")).where("k > 1").select("token", F.col("top.part").alias("main"))
    open_ = member.join(main, "token")
    odd = open_.where("part != main").select("token", F.col("key").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("part").alias("qa"))
    enough = (100 + percent) * (1 + F.least(F.col("na") - F.col("pa") - 1, F.col("n") - F.col("place") - 1)) >= percent * (F.col("na") + F.col("n"))
    rest = odd.join(open_, "token").where(
        (F.col("qa") != F.col("part")) & ((F.col("part") == F.col("main")) | (F.col("a") < F.col("key")))
        & _compatible(F.col("na"), F.col("n"), percent) & enough).select("a", F.col("key").alias("b"))
    rest = written(plausible(_ordered(rest), nodes, sketch, bits, percent), "join-rest")
    late = written(verify(rest, nodes, docs, words, percent), "join-late")
    if not late.isEmpty():
        links = links.unionByName(late)
        parts = written(components(links), "join-components")

    counted = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links"))
    member_of = nodes.select("key", "doc_id").join(parts.withColumnRenamed("node", "key"), "key")
    smallest = member_of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = member_of.select("key", "component").join(smallest, "component").select("key", "component", "component_id")
    known = classes.select("key", F.col("doc_id").alias("least")).join(named, "key", "left").join(
        counted.withColumnRenamed("a", "key"), "key", "left").select(
            F.col("key").alias("_key"), F.coalesce("component_id", "least").alias("_component"), F.coalesce("component", "key").alias("component"), "n_links")
    own = [c for c in rows.columns if c == "own"]
    return rows.select("doc_id", "n", "key", *own).join(known, F.col("key") == F.col("_key"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("key").alias("set_key"), "component", *own)


def with_keys(docs: DataFrame, words: int = WORDS, text_col: str = "text", name: str = "_key") -> DataFrame:
    """``docs`` with the key of every row's set as a column ``name``: what ``join`` calls ``set_key``."""
    @lean
    def step(batches):
        for batch in batches:
            for begin in range(0, len(batch), 512):  # whole texts pass: small pieces hold little memory
                part = batch.slice(begin, 512)
                keys = [_key(shingles(c.as_buffer().to_pybytes() if c.is_valid else None, words)) for c in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], names=["doc", "text", "key"])

    source = docs.select(others(docs, text_col).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    keyed = source.mapInArrow(step, f"doc {source.schema['doc'].dataType.simpleString()}, text string, key bigint")
    return keyed.select(*[(F.col("text") if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns], F.col("key").alias(name))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def join_digest(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "n_shingles", "component_id")


JOIN_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[k:k + 3], 'string_agg', ' ') AS gram
      FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.y AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN least ON least.x = d.doc_id"""
