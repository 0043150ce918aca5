"""Time-to-live dedup on a stream: against written history, by keyed state, or loosely by a watermark."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ingestkit.operators.ttl import ttl_dedup

# Executors need no copy of this package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_ttl_dedup(stream: DataFrame, key: str, ts: str, seconds: int, tie: str, path: str, checkpoint: str):
    """Exact greedy rule over micro-batches; kept rows land under ``path``, one folder per batch.

    All the rule needs to know of the past are the kept rows within one TTL of the batch's range; a key has at most one
    per TTL. They join the micro-batch in the batch operator, so a hot key is cut into spans here as well and no key's
    rows are gathered in one task. A replayed batch rewrites its own folder and looks only at earlier ones.

    A late row is dropped if a row kept before it, or one that comes with it, is less than a TTL older. Rows that were
    written stay, so a late row that is kept may be followed within a TTL by one from an earlier batch.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_past", F.lit(False))
        if batch_id > 0:
            # two values, so that the look at the past is a range the scan can prune by
            oldest, newest = batch.agg(F.min(ts).cast("string"), F.max(ts).cast("string")).first()
            schema = StructType([*batch.schema.fields, StructField("_batch", LongType())])
            past = spark.read.schema(schema).parquet(path).where(F.col("_batch") < batch_id)
            kind, span = batch.schema[ts].dataType, F.make_interval(secs=F.lit(seconds))
            near = past.where((F.col(ts) > F.lit(oldest).cast(kind) - span) & (F.col(ts) <= F.lit(newest).cast(kind)))
            rows = rows.unionByName(near.drop("_batch").withColumn("_past", F.lit(True)))
        kept = ttl_dedup(rows, key, ts, seconds, tie).where(~F.col("_past")).drop("_past")
        kept.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stream_dedup_loose(stream: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """The built-in form: first row per key, forgotten once the watermark has passed it."""
    return stream.withWatermark(ts, f"{seconds} seconds").dropDuplicatesWithinWatermark([key])


#: Keys share this many rows of state: a call into Python costs milliseconds, whether it brings one key or a hundred.
BUCKETS = 4_096

#: Stands for no time: before all times, and never one.
_NO_TIME = -(1 << 63)


def _free_again(ttl_us: int, columns: list[str]):
    """State of a bucket of keys: the moments from which they are free again. Once the watermark has passed its moment a key
    is forgotten."""
    def step(bucket, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free, seen, keep = dict(zip(*state.get)) if state.exists else {}, None, []
        if not state.hasTimedOut:
            seen = pd.concat(list(rows))
            seen.columns = [*columns, "_at", "_us", "_key", "_tied", "_tie", "_bucket"]  # names that begin with a line may not come through
            seen = seen.sort_values(["_us", "_tied", "_tie"], na_position="first", kind="stable")
            for key, us in zip(seen["_key"].tolist(), seen["_us"].tolist()):
                kept = us == _NO_TIME or key not in free or us >= free[key]  # a row without a time is kept
                if kept and us != _NO_TIME:
                    free[key] = us + ttl_us
                keep.append(kept)
        passed = state.getCurrentWatermarkMs()
        free = {key: us for key, us in free.items() if -(-us // 1000) > passed}
        if free:
            state.update((list(free), list(free.values())))
            state.setTimeoutTimestamp(-(-min(free.values()) // 1000))
        elif state.exists:
            state.remove()
        if any(keep):
            yield seen[keep][columns]
    return step


def stream_ttl_state(stream: DataFrame, key: str, ts: str, seconds: int, tie: str, path: str, checkpoint: str, delay: str = "0 seconds",
                     buckets: int = BUCKETS):
    """The greedy rule with the moment each key is free again as keyed state; kept rows are added to ``path``.

    The state holds one number for every key kept within one TTL before the watermark (the latest time less ``delay``);
    older keys are forgotten by timeouts, so nothing of the past is read again. Rows later than the watermark are dropped by
    Spark; a late row within it is kept if its key is free by then. Keys are dealt by hash into ``buckets`` rows of state, a
    number that stays with a checkpoint. A bucket's rows of one micro-batch are ordered in one task: for hot keys in large
    batches ``stream_ttl_dedup``, which cuts them into spans, is the right form.
    """
    names = [f.name for f in stream.schema.fields]
    # pandas makes a column of integers with a null one of floats: long integers travel as text
    carried = StructType([StructField(f.name, StringType() if isinstance(f.dataType, LongType) else f.dataType) for f in stream.schema.fields])
    at, order = F.col(f"`{ts}`").cast("timestamp"), F.col(f"`{tie}`")
    timed = stream.withColumn("_at", at).withColumn("_us", F.coalesce(F.unix_micros("_at"), F.lit(_NO_TIME))).withWatermark("_at", delay)
    keyed = timed.withColumn("_key", F.coalesce(F.concat(F.lit("k"), F.col(f"`{key}`").cast("string")), F.lit("")))
    tied = keyed.withColumn("_tied", order.isNotNull()).withColumn(
        "_tie", F.coalesce(order, F.lit(0)) if isinstance(stream.schema[tie].dataType, LongType) else order)
    dealt = tied.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))
    texts = dealt.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in carried.fields], "_at", "_us", "_key", "_tied", "_tie", "_bucket")
    kept = texts.groupBy("_bucket").applyInPandasWithState(_free_again(seconds * 1_000_000, names), carried, "keys array<string>, free array<bigint>",
                                                           "append", GroupStateTimeout.EventTimeTimeout)
    kept = kept.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in stream.schema.fields])
    query = (
        kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
