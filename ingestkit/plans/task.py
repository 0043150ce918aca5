"""A whole task: grid × source × outputs, with totals and a run record."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestkit.functions.templates import has_variables, render
from ingestkit.operators.grid import contexts
from ingestkit.operators.upsert import run_totals
from ingestkit.plans.output import OutputResult, Toolkit, run_outputs
from ingestkit.sources.database import read_jdbc, sql_source
from ingestkit.sources.files import acceptable, read_csv, read_csv_grid
from ingestkit.spec import TaskSpec

RUN_SCHEMA = ("task_name string, run_time timestamp, status string, records_new bigint, records_updated bigint, "
              "records_skipped bigint, error_msg string, duration_ms bigint")


@dataclass(frozen=True)
class TaskResult:
    outputs: dict[str, OutputResult]
    totals: DataFrame   # one row: new, updated, skipped, total
    errors: DataFrame   # one row: failed payloads and the last error text


def requests(spark: SparkSession, task: TaskSpec, run_ts) -> DataFrame:
    """The contexts of a run, one per address: of those with one address, the first in the order of the grid."""
    grid = contexts(spark, task.iterate, run_ts, task.url, task.name, task.params)
    if task.type not in ("api", "web"):
        return grid
    # explodes of one row in one partition number its contexts in grid order
    members = F.struct(*[F.col(f"`{c}`") for c in grid.columns if c != "url"])
    return grid.withColumn("_n", F.monotonically_increasing_id()).groupBy("url").agg(F.min_by(members, "_n").alias("_c")).select("url", "_c.*")


def attach(grid: DataFrame, landed: DataFrame) -> DataFrame:
    """Landed payloads of the requested addresses, with the context variables as columns."""
    extra = [c for c in grid.columns if c not in landed.columns or c == "url"]
    return landed.join(grid.select(*extra), "url")


def run_task(spark: SparkSession, task: TaskSpec, run_ts, targets: Mapping[str, DataFrame],
             landed: DataFrame | None = None, views: Mapping[str, DataFrame] | None = None,
             kit: Toolkit | None = None, doc: str = "doc_id", **options) -> TaskResult:
    """Compile the task to one plan per output.

    ``landed`` holds fetched payloads ``(doc_id, url, body[, status, error])`` for ``api`` and
    ``web`` tasks. A payload with an error is counted and left out; the others go on.
    """
    if task.type in ("api", "web"):
        if landed is None:
            raise ValueError("api and web tasks read landed payloads")
        fetched, failures = attach(requests(spark, task, run_ts), landed), []
    else:
        fetched, failures = _tabular(spark, task, run_ts, views)
    if "error" in fetched.columns and task.type in ("api", "web"):
        errors = fetched.agg(F.count("error").alias("failed"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col(doc))).alias("error"))
        fetched = fetched.where(F.col("error").isNull()).drop("error")
    else:
        errors = spark.range(1).select(F.lit(len(failures)).cast("bigint").alias("failed"),
                                       F.lit(failures[-1] if failures else None).cast("string").alias("error"))
    outputs = run_outputs(acceptable(fetched), task.outputs, targets, run_ts, kit, doc=doc, **options)
    totals = run_totals(reduce(DataFrame.unionByName, [r.metrics for r in outputs.values()]))
    return TaskResult(outputs, totals, errors)


def _tabular(spark: SparkSession, task: TaskSpec, run_ts, views: Mapping[str, DataFrame] | None) -> tuple[DataFrame, list[str]]:
    """Rows of a file or a query, once per context of the grid, with the context's variables as columns, and the errors of
    contexts that cannot be read while others can.

    A query or path without variables is read once and meets the grid in a join. One with variables is rendered for each
    context: files are one scan for all contexts, queries one each. The grid is what the task description lists, so it is
    small and known before anything is read. If no context can be read the task fails.
    """
    if task.type not in ("csv", "db"):
        raise ValueError(f"a task of type {task.type} cannot be read here; sheets are given as frames to normalize_sheet"
                         if task.type == "excel" else f"unknown task type: {task.type}")
    grid = contexts(spark, task.iterate, run_ts, task.url, task.name, task.params)
    place = "path" if task.type == "csv" else "query"
    text = str(task.source.get(place) or "")

    def read(source: Mapping) -> DataFrame:
        if task.type == "csv":
            return read_csv(spark, source)
        return sql_source(spark, source.get("query", ""), views) if views else read_jdbc(spark, source)

    if not has_variables(text):
        rows = read(task.source)
        return rows.crossJoin(F.broadcast(grid.select(*[c for c in grid.columns if c not in rows.columns]))), []  # the task's own list
    rendered = grid.withColumn("_text", render(text, run_ts, {c: F.col(f"`{c}`") for c in grid.columns}))
    listed = [(values.pop("_text"), values) for values in (r.asDict() for r in rendered.collect())]
    if task.type == "csv":
        rows, failures = read_csv_grid(spark, task.source, listed)
        if rows is None:
            raise FileNotFoundError("; ".join(failures) or "every file is empty")
        return rows, failures
    parts, failures = [], []
    for text, values in listed:
        try:
            rows = read({**task.source, place: text})
        except Exception as e:  # one query that cannot be planned leaves the others alone
            failures.append(str(e).splitlines()[0])
            continue
        parts.append(rows.withColumns({k: F.lit(v) for k, v in values.items() if k not in rows.columns}))
    if not parts:
        raise ValueError("; ".join(failures))
    return reduce(DataFrame.unionByName, parts), failures


def record_run(spark: SparkSession, log_path: str, task_name: str,
               work: Callable[[], TaskResult], run_ts: dt.datetime,
               write: Callable[[TaskResult], Mapping[str, int]]) -> dict:
    """Run, write and append one row to the run log.

    Status: ``success``; ``partial`` when some payloads failed (counts are kept); ``failed``.
    """
    started = time.time()
    row = {"task_name": task_name, "run_time": run_ts, "status": "success", "records_new": 0, "records_updated": 0,
           "records_skipped": 0, "error_msg": None, "duration_ms": 0}
    failure = None
    try:
        result = work()
        counts = write(result)
        row.update(records_new=counts["new"], records_updated=counts["updated"], records_skipped=counts["skipped"])
        errors = result.errors.first()
        if errors["failed"]:
            row.update(status="partial", error_msg=errors["error"])
    except Exception as e:  # the run record must be written whatever went wrong
        failure = e
        row.update(status="failed", error_msg=str(e))
    row["duration_ms"] = int((time.time() - started) * 1000)
    spark.createDataFrame([tuple(row.values())], RUN_SCHEMA).write.mode("append").parquet(log_path)
    if failure is not None:
        raise failure
    return row
