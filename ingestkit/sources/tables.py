"""Target tables as partitioned parquet: created from a spec, changed by touched partition.

A table is partitioned by columns of its key or, in ``BUCKETS`` parts unless told otherwise, by a hash of it. How is written
once, beside the data (``_layout``, with the columns and the unique keys), and every later call keeps to it: another layout
is refused. Upserts, updates and deletes first find the partitions they touch, by a scan of the columns they need, then
write the new content of these into a staging folder and replace them by Spark's dynamic partition overwrite; all other
files stay as they are. A run that dies in between can be repeated.

The partition column ``_part`` is text of its own, so NULL and empty key values are kept apart and come back as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ingestkit.operators.mutations import equals, update_where
from ingestkit.operators.unique import UniqueError, upsert_unique
from ingestkit.operators.upsert import assert_not_null, upsert
from ingestkit.spec import TableSpec

_LAYOUT, _PART = "_layout", "_part"
BUCKETS = 16

#: More partitions than these are not replaced at once: the table should have been cut into buckets.
MOST_TOUCHED = 10_000


class TableError(RuntimeError):
    """The table is not as this call needs it."""


@dataclass(frozen=True)
class Layout:
    schema: StructType
    unique: tuple[tuple[str, ...], ...]
    columns: tuple[str, ...]   # partitioned by these, or
    buckets: int               # by a hash of the first unique key (all columns where there is none)

    def part(self) -> Column:
        """Name of a row's partition."""
        if self.buckets:
            named = self.unique[0] if self.unique else self.schema.fieldNames()
            return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in named]), F.lit(self.buckets)).cast("string")
        texts = [F.coalesce(F.concat(F.lit("="), F.url_encode(F.col(f"`{c}`").cast("string"))), F.lit("null")) for c in self.columns]
        return F.concat_ws("&", *texts)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def layout_of(spark: SparkSession, path: str) -> Layout | None:
    """How the table at ``path`` is laid out; None if there is no table."""
    fs, p = _path(spark, f"{path}/{_LAYOUT}/_SUCCESS")
    if not fs.exists(p):
        fs, p = _path(spark, path)
        if fs.exists(p) and any(not s.getPath().getName().startswith("_") or s.getPath().getName().startswith(f"{_PART}=") for s in fs.listStatus(p)):
            raise TableError(f"{path} holds data but says nothing of its layout")
        return None
    row = spark.read.parquet(f"{path}/{_LAYOUT}").first()
    return Layout(StructType.fromDDL(row["ddl"]), tuple(map(tuple, row["unique"])), tuple(row["columns"]), row["buckets"])


def _opened(spark: SparkSession, path: str, spec: TableSpec, partition_by: Sequence[str], buckets: int | None) -> Layout:
    """The table's layout; a table is created empty where there is none, another layout than the table's is refused."""
    parts = tuple(partition_by)
    if parts and buckets:
        raise ValueError("give partition columns or a number of buckets")
    if not set(parts) <= set(spec.keys):
        raise ValueError("partition columns must belong to the key")
    known = layout_of(spark, path)
    if known is None:
        if not spec.columns:
            raise ValueError(f"table {spec.name} declares no columns")
        known = Layout(spec.schema, spec.unique, parts, 0 if parts else buckets or BUCKETS)
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in spec.schema.fields)
        row = (ddl, [list(k) for k in spec.unique], list(parts), known.buckets)
        told = spark.createDataFrame([row], "ddl string, `unique` array<array<string>>, columns array<string>, buckets int")
        told.coalesce(1).write.mode("overwrite").parquet(f"{path}/{_LAYOUT}")
    if (parts and parts != known.columns) or (buckets and buckets != known.buckets):
        raise TableError(f"{path} is partitioned by {', '.join(known.columns) or f'{known.buckets} buckets'}, not by {', '.join(parts) or f'{buckets} buckets'}")
    if spec.unique != known.unique or set(spec.schema.fieldNames()) != set(known.schema.fieldNames()):
        raise TableError(f"{path} has other columns or unique keys than {spec.name} declares")
    return known


def _stored(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """All rows, with ``_part``."""
    return spark.read.schema(StructType([*layout.schema.fields, StructField(_PART, StringType())])).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    layout = layout_of(spark, path)
    if layout is None:
        raise FileNotFoundError(f"no table at {path}")
    return _stored(spark, path, layout).drop(_PART)


def read_partitions(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """The rows of a table in the order of the columns of its spec."""
    return read_table(spark, path).select(*[F.col(f"`{c.name}`") for c in spec.columns])


def ensure_table(spark: SparkSession, path: str, spec: TableSpec, partition_by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """The table at ``path``, created empty from its declared columns if there is none yet."""
    _opened(spark, path, spec, partition_by, buckets)
    return read_table(spark, path)


@contextmanager
def _staging(spark: SparkSession, path: str):
    """A folder for what a change computes; it is gone afterwards, whatever happens."""
    folder = f"{path.rstrip('/')}__staged_{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        fs, p = _path(spark, folder)
        fs.delete(p, True)


def _names(parts: DataFrame) -> list[str]:
    """Names of partitions: as few as there are folders to replace, or none of them comes to the driver."""
    found = [r[0] for r in parts.distinct().limit(MOST_TOUCHED + 1).collect()]
    if len(found) > MOST_TOUCHED:
        raise TableError(f"more than {MOST_TOUCHED} partitions would be replaced: cut the table into buckets instead")
    return found


def _overwrite(spark: SparkSession, path: str, layout: Layout, staged: str) -> None:
    """Replace the partitions that staged rows fall into."""
    placed = spark.read.schema(layout.schema).parquet(staged).withColumn(_PART, layout.part())
    # rebalancing gathers a partition's rows for few files, but splits one that is too large
    (placed.hint("rebalance", _PART).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(path))


def _replace(spark: SparkSession, path: str, layout: Layout, staging: str, touched: list[str]) -> None:
    """Replace the partitions ``touched``, and with them those that staged rows have moved to; emptied ones go."""
    staged = spark.read.schema(layout.schema).parquet(f"{staging}/table")
    left = _names(staged.select(layout.part().alias(_PART)))
    moved, gone = sorted(set(left) - set(touched)), sorted(set(touched) - set(left))
    stored = _stored(spark, path, layout)
    if moved:
        stored.where(F.col(_PART).isin(moved)).drop(_PART).write.mode("append").parquet(f"{staging}/table")
    file = F.col("_metadata.file_path")
    held = stored.where(F.col(_PART).isin(gone)).select(F.regexp_extract(file, "^(.*)/[^/]*$", 1)).distinct()
    folders = [r[0] for r in held.collect()] if gone else []
    _overwrite(spark, path, layout, f"{staging}/table")
    jvm = spark.sparkContext._jvm
    for folder in folders:
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def upsert_partitions(spark: SparkSession, path: str, spec: TableSpec, batch: DataFrame, run_ts, partition_by: Sequence[str] = (),
                      order_by: str | Sequence[str] | None = None, buckets: int | None = None) -> dict[str, int]:
    """Merge a batch into the table, reading and replacing only the partitions it falls into, and return its counts
    (inserted, updated, total).

    The batch is computed once. A NOT NULL violation, or a row that meets two rows by different unique keys, fails the
    call before anything of the table is replaced. With several unique keys the partitions of all rows that are met are
    found first, by a scan of the key columns.
    """
    layout = _opened(spark, path, spec, partition_by, buckets)
    missing = [k for k in spec.keys if k not in batch.columns]
    if missing and len(spec.unique) < 2:
        raise ValueError(f"batch lacks key columns: {missing}")
    kinds = {f.name: f.dataType for f in layout.schema.fields}
    typed = batch.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in batch.columns])
    with _staging(spark, path) as staging:
        if not spec.keys:
            return _appended(spark, path, layout, spec, typed, run_ts, staging)
        placed = typed if missing else typed.withColumn(_PART, layout.part())
        placed.write.parquet(f"{staging}/batch")
        landed = spark.read.schema(placed.schema).parquet(f"{staging}/batch")
        stored = _stored(spark, path, layout)
        if missing:  # rows go where the default of the key puts them, or nowhere if it is NULL: look at every partition
            parts = stored.select(_PART)
        else:
            parts = landed.select(_PART)
        for key in spec.unique[1:] if not missing else spec.unique:
            if set(key) <= set(landed.columns):
                asked = landed.select(*[F.col(f"`{c}`") for c in key]).dropna().distinct()
                parts = parts.unionByName(stored.join(asked, list(key), "left_semi").select(_PART))
        touched = _names(parts)
        target = stored.where(F.col(_PART).isin(touched)).drop(_PART)
        supplied = [c for c in landed.columns if c in kinds]
        defaults = spec.defaults(run_ts, supplied)
        seen = Observation() if len(spec.unique) < 2 else None
        if seen is not None:
            result = upsert(target, landed.drop(_PART), spec.keys, order_by, defaults, seen)
        else:
            result = upsert_unique(target, landed.drop(_PART), spec.unique, order_by, defaults)
        assert_not_null(result.table, spec.not_null()).write.parquet(f"{staging}/table")
        if seen is None:
            _replace(spark, path, layout, staging, touched)
            return result.metrics.first().asDict()
        _overwrite(spark, path, layout, f"{staging}/table")
        return {"inserted": seen.get["inserted"], "updated": seen.get["total"] - seen.get["inserted"], "total": seen.get["total"]}


def _appended(spark: SparkSession, path: str, layout: Layout, spec: TableSpec, batch: DataFrame, run_ts, staging: str) -> dict[str, int]:
    """Rows of a table without a key meet nothing: they are added to their partitions."""
    empty = spark.createDataFrame([], layout.schema)
    result = upsert(empty, batch, (), None, spec.defaults(run_ts, batch.columns))
    assert_not_null(result.table, spec.not_null()).write.parquet(f"{staging}/table")
    added = spark.read.schema(layout.schema).parquet(f"{staging}/table")
    added.withColumn(_PART, layout.part()).hint("rebalance", _PART).write.mode("append").partitionBy(_PART).parquet(path)
    n = added.count()
    return {"inserted": n, "updated": 0, "total": n}


def upsert_table(spark: SparkSession, path: str, spec: TableSpec, batch: DataFrame, run_ts,
                 order_by: str | Sequence[str] | None = None) -> dict[str, int]:
    """``upsert_partitions`` into a table of any layout; a new one is cut into ``BUCKETS``."""
    return upsert_partitions(spark, path, spec, batch, run_ts, (), order_by)


def _changed(spark: SparkSession, path: str, column: str, value, change, set_: set[str]) -> int:
    """Rewrite by ``change`` the partitions that hold rows whose ``column`` equals ``value``; how many rows that are."""
    layout = layout_of(spark, path)
    if layout is None:
        raise FileNotFoundError(f"no table at {path}")
    stored = _stored(spark, path, layout)
    hits = stored.where(equals(stored, column, value))
    touched = _names(hits.select(_PART))
    if not touched:
        return 0
    n = hits.where(F.col(_PART).isin(touched)).count()
    with _staging(spark, path) as staging:
        kept = stored.where(F.col(_PART).isin(touched)).drop(_PART)
        change(kept).write.parquet(f"{staging}/table")
        staged = spark.read.schema(layout.schema).parquet(f"{staging}/table")
        rest = stored.where(~F.col(_PART).isin(touched))
        for key in layout.unique:
            if set_ & set(key):  # a changed key must still be unique in the whole table
                cells = [F.col(f"`{c}`") for c in key]
                twice = staged.select(*cells).unionByName(rest.select(*cells)).dropna().groupBy(*cells).count().where("count > 1")
                if not twice.isEmpty():
                    raise UniqueError(f"UNIQUE constraint failed: {', '.join(key)}")
        _replace(spark, path, layout, staging, touched)
    return n


def update_table(spark: SparkSession, path: str, column: str, value, changes) -> int:
    """Set ``changes`` in the stored rows whose ``column`` equals ``value``; how many those are."""
    return _changed(spark, path, column, value, lambda df: update_where(df, column, value, changes), set(changes))


def delete_from_table(spark: SparkSession, path: str, column: str, value) -> int:
    """Delete the stored rows whose ``column`` equals ``value``; how many those are."""
    return _changed(spark, path, column, value, lambda df: df.where(~equals(df, column, value)), set())


def truncate_table(spark: SparkSession, path: str) -> int:
    """Delete all rows; the table and its layout stay."""
    n = read_table(spark, path).count()
    fs, p = _path(spark, path)
    for status in fs.listStatus(p):
        if status.getPath().getName().startswith(f"{_PART}="):
            fs.delete(status.getPath(), True)
    return n
