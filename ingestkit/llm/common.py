"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestkit.session import setting, shared_dir

#: A lookup table is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 50_000

#: Java and DuckDB read this class alike: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends, sizes are known, nothing is computed twice."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame, rows: int) -> DataFrame:
    """A written table as the small side of a join: broadcast only if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone (32 bits of an MD5)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def fields(df: DataFrame, **renamed: str) -> DataFrame:
    """Only the named columns, under names of our own: extra columns of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in renamed.items()])


def joined_by_key(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with the row of ``table`` that has their ``key`` (never null); ``weight`` is the number of rows it stands for.

    Keys of more than a thousandth of all rows, so fewer than a thousand, are broadcast: no task gets all rows of a hot key.
    """
    hot = F.col(weight) * 1000 > F.lit(table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0])
    often = F.broadcast(table.where(hot))
    rest = rows.join(often.select(key), key, "left_anti").join(table.where(~hot), key)
    return rows.join(often, key).unionByName(rest)


_ARROW_ROWS, _SCAN_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Batches of at most ``rows`` rows between Spark and Python for what runs inside: whole texts pass, and both sides hold a
    batch or two of them. The session's own value, or none, is put back afterwards."""
    before = int(spark.conf.get(_ARROW_ROWS))
    with setting(spark, _ARROW_ROWS, str(min(rows, before) if before > 0 else rows)):
        yield


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Batches of ``rows`` rows in scans and between Spark and Python, unless the session has values of its own. It stays so, as
    a frame of whole texts may be run by whoever gets it: with thousands of rows a task fills arrays of tens of megabytes."""
    for name in (_ARROW_ROWS, _SCAN_ROWS):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(rows))


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` for ``mapInArrow``; at its end the worker gives the system back what it has freed. Workers are kept from task to
    task, so that what one has held at most would stand beside the executor's heap in all later stages."""
    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def others(df: DataFrame, column: str) -> Column:
    """All columns but one in a struct, whatever their names; without any other it holds a constant, as it needs a member."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name if ``df`` has such a column (Spark's names are alike in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
