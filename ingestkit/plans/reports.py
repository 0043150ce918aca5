"""Run reports and chart series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestkit.functions.datetimes import run_time
from ingestkit.operators.query import QueryError, page

# The statuses a report lists, in this order.
STATUSES = ("success", "running", "failed")
MAX_LOG_PAGE = 500


def recent(logs: DataFrame, run_ts, days: int = 7) -> DataFrame:
    since = run_time(run_ts) - F.make_interval(days=F.lit(days))
    return logs.where(F.col("run_time").cast("timestamp_ntz") >= since)


def status_distribution(logs: DataFrame, run_ts, days: int = 7) -> DataFrame:
    """One row per known status in fixed order, 0 where there was no run. One pass, no join."""
    counts = recent(logs, run_ts, days).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("status"), F.col(s).alias("runs"))
                      for i, s in enumerate(STATUSES)])
    return counts.select(F.inline(pairs))


def daily_trend(logs: DataFrame, run_ts, days: int = 7) -> DataFrame:
    return (
        recent(logs, run_ts, days)
        .groupBy(F.col("run_time").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("runs"),
             F.coalesce(F.sum("records_new"), F.lit(0)).alias("new_total"),
             F.coalesce(F.sum("records_updated"), F.lit(0)).alias("updated_total"))
        .orderBy("day")
    )


def with_task_names(logs: DataFrame, tasks: DataFrame) -> DataFrame:
    names = tasks.select(F.col("id").alias("task_id"), "task_name")
    return logs.join(names, "task_id", "left")


def list_logs(logs: DataFrame, tasks: DataFrame, task_name: str | None = None, status: str | None = None,
              limit: int | None = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page newest first, total). The filters come before the join; an unknown task lists nothing."""
    if limit is not None and not 1 <= limit <= MAX_LOG_PAGE:
        raise QueryError(f"limit must be between 1 and {MAX_LOG_PAGE}")
    chosen = logs.where(F.col("status") == status) if status else logs
    if task_name:
        ids = tasks.where(F.col("task_name") == task_name).select(F.col("id").alias("task_id"))
        chosen = chosen.join(ids, "task_id", "left_semi")
    total = chosen.agg(F.count(F.lit(1)).alias("total"))
    order = "run_time DESC, id DESC"
    if limit is None:
        return with_task_names(chosen, tasks).orderBy(F.desc("run_time"), F.desc("id")), total
    # the page is cut before task names are joined on
    return with_task_names(page(chosen, order, limit, offset), tasks).orderBy(F.desc("run_time"), F.desc("id")), total


def one_log(logs: DataFrame, tasks: DataFrame, log_id) -> DataFrame:
    return with_task_names(logs.where(F.col("id") == log_id), tasks)


def task_counts(tasks: DataFrame) -> DataFrame:
    return tasks.agg(
        F.count(F.lit(1)).alias("tasks_total"), F.count_if(F.col("enabled") == 1).alias("tasks_enabled"),
        F.count_distinct("target_table").alias("business_tables"))


def tables_per_task(outputs: DataFrame, task: str, table: str) -> DataFrame:
    """Target tables of each task; equal names are dropped in the map tasks already."""
    return outputs.groupBy(task).agg(F.sort_array(F.collect_set(table)).alias("target_tables"))


def numeric_prefix(c: Column) -> Column:
    """The number a text starts with, else 0: ``"12.5 km"`` is 12.5."""
    text = F.regexp_extract(c.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def chart_points(df: DataFrame, x: str, y: str, series: str | None = None) -> DataFrame:
    """Long format ``(series, x, y)``; a missing series is named ``null``."""
    kind = df.schema[y].dataType.simpleString()
    value = (F.coalesce(F.col(y).cast("double"), F.lit(0.0)) if kind in ("double", "float", "bigint", "int", "smallint")
             else numeric_prefix(F.col(y)))
    name = F.coalesce(F.col(series).cast("string"), F.lit("null")) if series else F.lit(y)
    return df.select(name.alias("series"), F.col(x).alias("x"), value.alias("y"))


def chart_series(df: DataFrame, x: str, y: str, series: str | None = None, order_by: str | None = None,
                 rows: int | None = None) -> DataFrame:
    """The whole table as chart points, or the first ``rows`` rows in order."""
    ordered = page(df, order_by or f"{x} ASC", rows, 0) if rows is not None else df
    return chart_points(ordered, x, y, series)


def series_means(points: DataFrame) -> DataFrame:
    """Mean line of every series and, with a NULL name, of all points together, in one pass."""
    return points.rollup("series").agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("points"))
