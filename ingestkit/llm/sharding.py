"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A document's key is the MD5 of its id and text. The ring is cut into 65,536 equal ranges; Spark sums the bytes of each
range, and that table (never more rows, whatever the corpus) is placed on the driver. A range goes to the shard of the
first virtual node clockwise from it; a shard that is full passes it on clockwise to the next shard that has room.
No shard holds more than ``(1 + SLACK)`` times the mean, unless one document is larger than that.

Law ``bytes``: shard sizes are near equal. Large ranges are placed first, so the small ones fill what is left. Ranges keep
their place on the ring when a shard is added: the new shard's virtual nodes take over some, and only those and what
passes a full shard moves.

Inside a shard the ``slot`` numbers have no gap: rows are numbered within cells of a second hash, and cells start where
the one before ends. Groups of equal texts are not kept together, as their ids differ: a hot text spreads over all
shards, which law ``bytes`` needs.

Equal rows have one key; many of them would make a range that no shard has room for. So the rows of a key that repeats and
holds more than ``1 / HEAVY`` of a shard's mean load take ranges by the hash of their number in the written table, and the
loads are summed again. There are at most ``HEAVY`` such keys per shard. Equal rows are interchangeable; no other row moves.

Cases: a null or empty text has size 8; a null id hashes like an empty one, so its text places it; repeated rows get
different slots, and many of them spread over the shards; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import bisect
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ingestkit.llm.common import fields, written

SHARDS, VIRTUAL_NODES, RANGES, CELLS, SLACK, HEAVY = 24, 128, 1 << 16, 128, 0.001, 16


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Sorted ``(range, shard)`` of all virtual nodes; adding a shard leaves the others where they are."""
    def at(shard: int, node: int) -> int:
        return int(hashlib.md5(f"shard {shard} node {node}".encode()).hexdigest()[:4], 16)
    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def place(loads: list[tuple[int, int]], shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> dict[int, int]:
    """``(range, bytes)`` → shard of every range, with bounded loads.

    Only where no shard has room (a range larger than what is left anywhere) the least loaded one takes it.
    """
    nodes = ring(shards, virtual_nodes)
    starts = [p for p, _ in nodes]
    capacity = (1 + slack) * sum(b for _, b in loads) / shards
    held, out = [0] * shards, {}
    clockwise: dict[int, list[int]] = {}
    for position, size in sorted(loads, key=lambda x: (-x[1], x[0])):
        first = bisect.bisect_left(starts, position) % len(nodes)
        if first not in clockwise:
            clockwise[first] = list(dict.fromkeys(s for _, s in nodes[first:] + nodes[:first]))
        shard = next((s for s in clockwise[first] if held[s] + size <= capacity), None)
        if shard is None:
            shard = min(range(shards), key=lambda s: (held[s], s))
        held[shard] += size
        out[position] = shard
    return out


def _loads(rows: DataFrame) -> list[tuple[int, int]]:
    return [(r[0], r[1]) for r in rows.groupBy("_range").agg(F.sum("size")).collect()]  # at most RANGES rows


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
               virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``."""
    spark = docs.sparkSession
    text = F.col("text")
    hashed = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit(""))))
    rows = written(fields(docs, doc_id=id_col, text=text_col).select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.conv(F.substring(hashed, 1, 4), 16, 10).cast("int").alias("_range"),
        (F.conv(F.substring(hashed, 5, 4), 16, 10).cast("int") % CELLS).alias("_cell"),
        F.conv(F.substring(hashed, 9, 15), 16, 10).cast("long").alias("_key"), F.monotonically_increasing_id().alias("_number")), "shard-keys")
    loads = _loads(rows)
    most = sum(b for _, b in loads) / shards / HEAVY
    heavy = [p for p, b in loads if b > most]  # at most HEAVY a shard
    if heavy:
        keys = rows.where(F.col("_range").isin(heavy)).groupBy("_key").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
        repeated = [r[0] for r in keys.where((F.col("n") > 1) & (F.col("b") > most)).collect()]  # at most HEAVY a shard
        if repeated:
            own = F.pmod(F.xxhash64("_number"), F.lit(RANGES)).cast("int")
            rows = rows.withColumn("_range", F.when(F.col("_key").isin(repeated), own).otherwise(F.col("_range")))
            loads = _loads(rows)
    where = place(loads, shards, virtual_nodes, slack)
    # from Arrow; from a list of rows it would be made by Python workers, which stay with the executors
    placed = spark.createDataFrame(pa.table({"_at": pa.array(list(where), pa.int32()), "shard": pa.array(list(where.values()), pa.int32())}))
    sharded = rows.join(F.broadcast(placed), F.col("_range") == F.col("_at"))  # at most RANGES rows
    cells = sharded.groupBy("shard", "_cell").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col("shard").alias("_s"), F.col("_cell").alias("_c"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_cell").orderBy("_key", "doc_id", "size", "_number")
    numbered = sharded.withColumn("_n", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), (F.col("shard") == F.col("_s")) & (F.col("_cell") == F.col("_c"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_start") + F.col("_n")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))  # shards * CELLS rows


