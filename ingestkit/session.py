"""Session helpers shared by tests, the bench and the registered queries."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", name: str = "ingestkit") -> SparkSession:
    """A small local session. On a cluster use the session you are given."""
    n = str(os.cpu_count() or 8) if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("INGESTKIT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        # call sites are not recorded for every single Column: long rule chains build much faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests on one machine) a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="ingestkit-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so a lost executor does not replay the whole plan."""
    shared_dir_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_dir_ready(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for what runs inside; the session's own comes back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def plan_size_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan of scans and projections; explodes and compression make it too low."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parse_bytes(text: str) -> int:
    raw = text.strip().lower()
    for suffix, factor in (("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30), ("k", 1 << 10), ("m", 1 << 20),
                           ("g", 1 << 30), ("b", 1)):
        if raw.endswith(suffix):
            return int(float(raw[: -len(suffix)]) * factor)
    return int(raw)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for CPU-heavy parsing of an input too small to fill more than one split.

    Beyond that size the scan itself gives enough tasks, and nothing is shuffled.
    """
    spark = df.sparkSession
    one_split = parse_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728b"))
    if plan_size_bytes(df) >= one_split:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)
