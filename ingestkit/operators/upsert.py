"""Keyed upsert: last row per key wins, supplied columns replace old ones, others keep their value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

_NEW = "_new"
_ROWS = "_rows"
_SALT = "_salt"


@dataclass(frozen=True)
class Upsert:
    table: DataFrame    # the table after the upsert
    metrics: DataFrame  # one row: inserted, updated, total


def _no_null_key(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"`{k}`").isNotNull() for k in keys])


def _apart(df: DataFrame, keys: Sequence[str], sign: int) -> DataFrame:
    """``_salt`` is 0 for rows with a key; the others get numbers of their own, on either side of a join.

    They meet nobody, not even each other: a million equal rows without a key spread over all tasks.
    """
    own = F.lit(sign) * (F.monotonically_increasing_id() + 1)
    return df.withColumn(_SALT, F.when(_no_null_key(keys), F.lit(0).cast("bigint")).otherwise(own))


def latest_per_key(batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, ``keys, _salt, _new STRUCT<other columns>, _rows``, and every row without a key.

    ``max_by`` keeps one candidate per key in every map task, so a key that fills a third of the batch still sends only
    one row per task over the network. The order is a struct, as a bare NULL would leave a row out of account: NULL
    sorts before any value.
    """
    values = [c for c in batch.columns if c not in keys]
    payload = F.struct(*[F.col(f"`{c}`") for c in values]) if values else F.struct(F.lit(1).alias("_none"))
    order = F.struct(*[F.col(f"`{c}`") for c in order_by])
    return _apart(batch, keys, 1).groupBy(*keys, _SALT).agg(F.max_by(payload, order).alias(_NEW), F.count(F.lit(1)).alias(_ROWS))


def upsert(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order_by: str | Sequence[str] | None = None,
    defaults: Mapping[str, Column] | None = None,
    observation: Observation | None = None,
) -> Upsert:
    """Merge ``batch`` into ``target``.

    ``order_by`` names the batch columns that say which of several rows for a key is the last one; a keyed upsert needs
    it, and rows that tie in it are the caller's choice. These columns are dropped unless the target has them. Rows with
    a NULL in the key never conflict and are all inserted. ``defaults`` fill columns that inserted rows do not supply.

    The batch is read once and costs one exchange, the target another; sizes at run time decide how they are joined. An
    ``observation`` receives ``inserted`` and ``total`` while the table is written; ``metrics`` is a pass of its own.
    """
    keys = list(keys)
    order_cols = [order_by] if isinstance(order_by, str) else list(order_by or [])
    supplied = [c for c in batch.columns if c in target.columns]
    extra = [c for c in batch.columns if c not in target.columns and c not in order_cols]
    if extra:
        raise ValueError(f"columns not in the table: {extra}")
    missing = [k for k in keys if k not in supplied]
    if missing:
        raise ValueError(f"batch lacks key columns: {missing}")
    if keys and not order_cols:
        raise ValueError("a keyed upsert needs order_by: which row of a key is the last")
    defaults = dict(defaults or {})
    kinds = {f.name: f.dataType for f in target.schema.fields}

    def watched(df: DataFrame, inserted: Column, total: Column) -> DataFrame:
        if observation is None:
            return df
        return df.observe(observation, F.coalesce(F.sum(inserted), F.lit(0)).alias("inserted"),
                          F.coalesce(F.sum(total), F.lit(0)).alias("total"))

    if not keys:
        one = F.lit(1)
        added = watched(batch, one, one).select(*[
            (F.col(f"`{c}`") if c in supplied else defaults.get(c, F.lit(None))).cast(kinds[c]).alias(c) for c in target.columns])
        metrics = batch.agg(F.count(F.lit(1)).alias("inserted"))
        return Upsert(target.unionByName(added), _metrics(metrics.withColumn("total", F.col("inserted"))))

    # key columns take the table's types before they meet
    typed = batch.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in batch.columns])
    values = [c for c in supplied if c not in keys]
    newest = latest_per_key(typed.select(*dict.fromkeys(keys + values + order_cols)), keys, order_cols)
    old = _apart(target, keys, -1).withColumn("_old", F.lit(True)).alias("t")
    joined = old.join(newest, [*keys, _SALT], "full_outer")
    is_new, hit = F.col("_old").isNull(), F.col(_ROWS).isNotNull()
    joined = watched(joined, F.when(is_new, 1), F.col(_ROWS))
    columns = []
    for c in target.columns:
        if c in keys:
            value = F.col(f"`{c}`")
        elif c in values:
            value = F.when(hit, F.col(_NEW).getField(c)).otherwise(F.col(f"t.`{c}`"))
        else:
            value = F.when(is_new, defaults.get(c, F.lit(None)).cast(kinds[c])).otherwise(F.col(f"t.`{c}`"))
        columns.append(value.alias(c))
    return Upsert(joined.select(*columns), upsert_counts(target, typed, keys))


def upsert_counts(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``inserted`` = new distinct keys + rows without a key; every other batch row counts as updated."""
    whole = batch.where(_no_null_key(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(_ROWS))
    known = target.select(*keys).withColumn("_hit", F.lit(1))
    keyed = whole.join(known, list(keys), "left").agg(
        F.count_if(F.col("_hit").isNull()).alias("inserted"), F.coalesce(F.sum(_ROWS), F.lit(0)).alias("total"))
    lone = batch.agg(F.count_if(~_no_null_key(keys)).alias("_lone"))
    return _metrics(keyed.crossJoin(lone).select(  # one row each
        (F.col("inserted") + F.col("_lone")).alias("inserted"), (F.col("total") + F.col("_lone")).alias("total")))


def _metrics(counts: DataFrame) -> DataFrame:
    return counts.select("inserted", (F.col("total") - F.col("inserted")).alias("updated"), "total")


def run_totals(metrics: DataFrame) -> DataFrame:
    """Sum over outputs and contexts; ``skipped = total - inserted - updated``."""
    sums = metrics.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("inserted", "updated", "total")])
    return sums.select(
        F.col("inserted").alias("new"), "updated",
        (F.col("total") - F.col("inserted") - F.col("updated")).alias("skipped"), "total")


def not_null_violations(batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per checked column with the number of NULL cells in the batch."""
    counts = batch.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("nulls")) for c in columns])
    return counts.select(F.inline(pairs))


def assert_not_null(batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The batch itself; writing it fails as a whole when a NOT NULL column holds a NULL."""
    checked = {c: F.when(F.col(f"`{c}`").isNull(), F.raise_error(F.lit(f"NOT NULL constraint failed: {c}"))
                         ).otherwise(F.col(f"`{c}`")) for c in columns}
    return batch.withColumns(checked) if checked else batch
