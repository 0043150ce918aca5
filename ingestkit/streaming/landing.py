"""Incremental landing: new payload files become upserts into the target table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestkit.sources.tables import upsert_partitions, upsert_table
from ingestkit.spec import TableSpec


def read_landed(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def stream_upsert(stream: DataFrame, path: str, spec: TableSpec, run_ts, checkpoint: str,
                  order_by: str | Sequence[str], prepare: Callable[[DataFrame], DataFrame] | None = None,
                  partition_by: Sequence[str] = (), buckets: int | None = None):
    """Run all that has landed through ``prepare`` and into the table, then stop.

    With ``partition_by`` or ``buckets`` a micro-batch reads and replaces only the partitions it falls into, which is the
    form for large tables; without, it writes a new version of the whole table.

    A replayed batch meets the rows it wrote before and overwrites them with the same values, so a
    restart after a lost driver or executor leaves the same table.
    """
    def merge(batch: DataFrame, _batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        if partition_by or buckets:
            upsert_partitions(batch.sparkSession, path, spec, rows, run_ts, partition_by, order_by, buckets)
        else:
            upsert_table(batch.sparkSession, path, spec, rows, run_ts, order_by)

    query = (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def bucket_latest(df: DataFrame, keys: Sequence[str], bucket: Column, value: str, order: Column,
                  name: str = "bucket") -> DataFrame:
    """Newest value per key and time bucket: the batch form of floor + upsert on (key, bucket)."""
    return df.groupBy(*keys, bucket.alias(name)).agg(F.max_by(value, order).alias(value))


def stream_bucket_latest(stream: DataFrame, keys: Sequence[str], ts: str, bucket: str, value: str, order: Sequence[str], delay: str,
                         path: str, checkpoint: str):
    """``bucket_latest`` on a stream: the newest value per key and window of length ``bucket``, added to ``path`` once.

    A window is written when the watermark (the latest time less ``delay``) has passed its end, so its row never changes;
    until then it is state, one candidate per key and window. Rows of windows that were passed before they came are dropped
    by Spark. ``bucket`` in the result is the start of the window in milliseconds.
    """
    timed = stream.withColumn("_at", F.col(f"`{ts}`").cast("timestamp")).withWatermark("_at", delay)
    newest = timed.groupBy(*[F.col(f"`{k}`") for k in keys], F.window("_at", bucket).alias("_window")).agg(
        F.max_by(F.struct(F.col(f"`{value}`").alias("v")), F.struct(*[F.col(f"`{c}`") for c in order])).alias("_newest"))
    rows = newest.select(*[F.col(f"`{k}`") for k in keys], F.unix_millis("_window.start").alias("bucket"), F.col("_newest.v").alias(value))
    query = (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
