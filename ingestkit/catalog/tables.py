"""Table queries, reports and whole jobs."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestkit.catalog.base import RUN_TS, query, table
from ingestkit.catalog.cleaning import typed_k
from ingestkit.catalog.ingest import order_pages, order_payloads
from ingestkit.functions.predicates import Predicates
from ingestkit.operators.query import count_where, filter_table, page_count, positions, query_table
from ingestkit.plans import reports
from ingestkit.plans.output import run_output
from ingestkit.plans.task import RUN_SCHEMA, record_run, run_task
from ingestkit.session import shared_dir
from ingestkit.spec import OutputSpec, TaskSpec

# --------------------------------------------------------------- table queries


def _page(spark, sf, name, **kw) -> DataFrame:
    return query_table(table(spark, sf, name), **{"limit": None, **kw})[0]


@query("q_project", "SELECT o_orderkey, o_totalprice FROM orders")
def q_project(spark, sf):
    return _page(spark, sf, "orders", fields="o_orderkey, o_totalprice")


@query("q_where_cmp", """
    SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
    WHERE o_totalprice > 1000 AND o_totalprice <= 250000 AND o_orderstatus <> 'P' AND o_custkey >= 10 AND o_custkey < 900 AND o_orderkey != 3""")
def q_where_cmp(spark, sf):
    return _page(spark, sf, "orders", fields="o_orderkey,o_totalprice,o_orderstatus", where=[
        {"col": "o_totalprice", "op": ">", "value": "1000"}, {"col": "o_totalprice", "op": "<=", "value": 250000},
        {"col": "o_orderstatus", "op": "<>", "value": "P"}, {"col": "o_custkey", "op": ">=", "value": 10},
        {"col": "o_custkey", "op": "<", "value": 900}, {"col": "o_orderkey", "op": "!=", "value": 3}])


@query("q_where_in", """
    SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('P')""")
def q_where_in(spark, sf):
    return _page(spark, sf, "orders", fields="o_orderkey,o_orderpriority", where=[
        {"col": "o_orderpriority", "op": "in", "value": ["1-URGENT", "5-LOW"]},
        {"col": "o_orderstatus", "op": "NOT IN", "value": ["P"]}, {"col": "o_custkey", "op": "NOT IN", "value": []}])


@query("q_where_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WID_et' AND p_type NOT ILIKE 'eco%'")
def q_where_like(spark, sf):
    return _page(spark, sf, "part", fields="p_partkey,p_name", where=[
        {"col": "p_name", "op": "LIKE", "value": "%WID_et"}, {"col": "p_type", "op": "NOT LIKE", "value": "eco%"}])


@query("q_where_null", """
    SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL AND d.lang IS NOT NULL""")
def q_where_null(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return query_table(df, "doc_id,quality", limit=None, where=[
        {"col": "quality", "op": "IS NULL"}, {"col": "lang", "op": "is not null"}])[0]


@query("q_where_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def q_where_between(spark, sf):
    return _page(spark, sf, "lineitem", fields="l_orderkey,l_linenumber,l_quantity",
                 where=[{"col": "l_quantity", "op": "BETWEEN", "value": [10, 20]}])


@query("q_where_all", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity BETWEEN 5 AND 40 AND l_linestatus IN ('F', 'O') AND l_linenumber <> 2 AND l_discount IS NOT NULL""")
def q_where_all(spark, sf):
    return _page(spark, sf, "lineitem", fields="l_orderkey,l_linenumber,l_partkey", where="""[
        {"col": "l_returnflag", "op": "=", "value": "R"}, {"col": "l_quantity", "op": "between", "value": [5, 40]},
        {"col": "l_linestatus", "op": "IN", "value": ["F", "O"]}, {"col": "l_linenumber", "op": "!=", "value": 2},
        {"col": "l_discount", "op": "IS NOT NULL"}]""")


@query("q_group", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def q_group(spark, sf):
    return _page(spark, sf, "lineitem", fields="l_returnflag,l_linestatus", group_by="l_returnflag,l_linestatus")


@query("q_aggregate", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n, round(avg(l_discount), 6) AS disc,
           max(l_extendedprice) AS top, min(l_shipdate)::VARCHAR AS first FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_aggregate(spark, sf):
    df = _page(spark, sf, "lineitem", group_by="l_returnflag,l_linestatus", order_by="l_returnflag ASC, n DESC", aggregate=(
        "SUM(l_quantity) as qty, COUNT(*) as n, avg(l_discount) disc, MAX(l_extendedprice) AS top, MIN(l_shipdate) AS first"))
    return df.withColumns({"qty": F.round("qty", 2), "disc": F.round("disc", 6),
                           "first": F.date_format("first", "yyyy-MM-dd HH:mm:ss")})


@query("q_global_agg", """
    SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty, count(l_comment) AS c FROM (SELECT *, CASE WHEN l_linenumber > 2 THEN 1 END AS l_comment FROM lineitem)""")
def q_global_agg(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("l_comment", F.when(F.col("l_linenumber") > 2, 1))
    return query_table(df, aggregate="COUNT(*) AS n, SUM(l_quantity) AS qty, COUNT(l_comment) AS c", limit=None)[0].withColumn(
        "qty", F.round("qty", 2))


@query("q_order", """
    SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY cust DESC NULLS LAST, o_orderkey NULLS FIRST) AS place
    FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS cust FROM orders)""")
def q_order(spark, sf):
    """The whole ordered table with its places, numbered without gathering it."""
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.pmod("o_orderkey", F.lit(7)) != 0, F.col("o_custkey")).alias("cust"))
    return positions(df, "cust DESC, o_orderkey ASC").select("o_orderkey", "o_custkey", F.col("_position").alias("place"))


@query("q_page", """
    SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey FROM lineitem WHERE l_quantity > 10
    ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey LIMIT 50 OFFSET 100""")
def q_page(spark, sf):
    return _page(spark, sf, "lineitem", fields="l_orderkey,l_linenumber,l_extendedprice,l_partkey", limit=50, offset=100,
                 where=[{"col": "l_quantity", "op": ">", "value": 10}],
                 order_by="l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey")


@query("q_total", "SELECT count(*) AS total FROM lineitem WHERE l_quantity > 10")
def q_total(spark, sf):
    return query_table(table(spark, sf, "lineitem"), group_by="l_returnflag", aggregate="COUNT(*) AS n", limit=50,
                       where=[{"col": "l_quantity", "op": ">", "value": 10}])[1]


@query("q_count", "SELECT count(*) AS \"count\" FROM events WHERE event_type = 'click' AND value >= 10")
def q_count(spark, sf):
    return count_where(table(spark, sf, "events"), [
        {"col": "event_type", "op": "=", "value": "click"}, {"col": "value", "op": ">=", "value": 10}], "count")


@query("q_pages", "SELECT count(*) AS total, ceil(count(*) / 100.0)::BIGINT AS pages FROM orders WHERE o_orderstatus = 'O'")
def q_pages(spark, sf):
    total = query_table(table(spark, sf, "orders"), where=[{"col": "o_orderstatus", "op": "=", "value": "O"}])[1]
    return page_count(total)


# --------------------------------------------------------------------- reports

def run_logs(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    status = (F.when(kind.isin("view", "click", "signup"), "success").when(kind == "error", "failed").otherwise("paused"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), F.col("ts").alias("run_time"), status.alias("status"),
        typed_k("props").alias("records_new"), F.when(kind == "click", F.col("event_id")).alias("records_updated"))


_LOGS = """(SELECT event_id AS id, user_id AS task_id, ts AS run_time,
      CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'success' WHEN event_type = 'error' THEN 'failed' ELSE 'paused' END AS status,
      json_extract_string(props, '$.k')::BIGINT AS records_new, CASE WHEN event_type = 'click' THEN event_id END AS records_updated
    FROM events)"""


def all_tasks(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("task_name"),
        F.pmod("c_custkey", F.lit(2)).alias("enabled"), F.col("c_mktsegment").alias("target_table"))


def tasks(spark, sf) -> DataFrame:
    """Known tasks; runs of every fifth have none, as its table row was deleted."""
    return all_tasks(spark, sf).where(F.pmod("id", F.lit(5)) != 0)


_TASKS = "(SELECT c_custkey AS id, c_name AS task_name, c_mktsegment AS target_table FROM customer WHERE c_custkey % 5 <> 0)"


@query("rep_status", f"""
    SELECT p AS position, s AS status, count(l.id) AS runs
    FROM (VALUES (0, 'success'), (1, 'running'), (2, 'failed')) d(p, s)
    LEFT JOIN {_LOGS} l ON l.status = s AND run_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY p, s""")
def rep_status(spark, sf):
    return reports.status_distribution(run_logs(spark, sf), RUN_TS)


@query("rep_trend", f"""
    SELECT run_time::DATE::VARCHAR AS day, count(*) AS runs, coalesce(sum(records_new), 0)::BIGINT AS new_total,
           coalesce(sum(records_updated), 0)::BIGINT AS updated_total
    FROM {_LOGS} WHERE run_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1""")
def rep_trend(spark, sf):
    return reports.daily_trend(run_logs(spark, sf), RUN_TS).withColumn("day", F.col("day").cast("string"))


def _log_columns(df):
    return df.select("id", "task_id", "task_name", "status", F.date_format("run_time", "yyyy-MM-dd HH:mm:ss").alias("run_time"))


@query("rep_logs", f"""
    SELECT l.id, l.task_id, t.task_name, l.status, strftime(l.run_time, '%Y-%m-%d %H:%M:%S') AS run_time
    FROM {_LOGS} l LEFT JOIN {_TASKS} t ON l.task_id = t.id WHERE l.status = 'failed'
    ORDER BY l.run_time DESC, l.id DESC LIMIT 500""")
def rep_logs(spark, sf):
    return _log_columns(reports.list_logs(run_logs(spark, sf), tasks(spark, sf), status="failed", limit=500)[0])


@query("rep_logs_task", f"""
    SELECT l.id, l.task_id, t.task_name, l.status, strftime(l.run_time, '%Y-%m-%d %H:%M:%S') AS run_time
    FROM {_LOGS} l JOIN {_TASKS} t ON l.task_id = t.id WHERE t.task_name = 'Customer#000000001'""")
def rep_logs_task(spark, sf):
    return _log_columns(reports.list_logs(run_logs(spark, sf), tasks(spark, sf), task_name="Customer#000000001", limit=None)[0])


@query("rep_log_one", f"""
    SELECT l.id, l.task_id, t.task_name, l.status, strftime(l.run_time, '%Y-%m-%d %H:%M:%S') AS run_time
    FROM {_LOGS} l LEFT JOIN {_TASKS} t ON l.task_id = t.id WHERE l.id = 77""")
def rep_log_one(spark, sf):
    return _log_columns(reports.one_log(run_logs(spark, sf), tasks(spark, sf), 77))


@query("rep_counts", """
    SELECT count(*) AS tasks_total, count(*) FILTER (c_custkey % 2 = 1) AS tasks_enabled, count(DISTINCT c_mktsegment) AS business_tables
    FROM customer""")
def rep_counts(spark, sf):
    return reports.task_counts(all_tasks(spark, sf))


@query("rep_task_tables", """
    SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS target_tables FROM part GROUP BY p_brand""")
def rep_task_tables(spark, sf):
    return reports.tables_per_task(table(spark, sf, "part"), "p_brand", "p_type").withColumn(
        "target_tables", F.array_join("target_tables", ","))


def _chart_rows(spark, sf):
    e, third = table(spark, sf, "events"), F.pmod("event_id", F.lit(3))
    y = F.when(third == 0, F.concat(F.col("value").cast("string"), F.lit(" km"))).when(third == 1, F.lit("none")).otherwise(
        F.col("event_id").cast("string"))
    return e.select("event_id", y.alias("y"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))


_POINTS = """(SELECT coalesce(nullif(event_type, 'error'), 'null') AS series, event_id AS x,
      CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN 0 ELSE event_id END::DOUBLE AS y FROM events)"""


@query("rep_series", f"SELECT series, x, y FROM {_POINTS}")
def rep_series(spark, sf):
    """Every point of the chart."""
    return reports.chart_series(_chart_rows(spark, sf), "event_id", "y", "kind")


@query("rep_series_mean", f"""
    SELECT series, round(avg(y), 4) AS mean, count(*) AS points FROM {_POINTS} GROUP BY ROLLUP (series)""")
def rep_series_mean(spark, sf):
    points = reports.chart_series(_chart_rows(spark, sf), "event_id", "y", "kind")
    return reports.series_means(points).withColumn("mean", F.round("mean", 4))


# ------------------------------------------------------------------------ jobs

ORDER_OUTPUT = {
    "target_table": "orders",
    "table_schema": {
        "columns": [{"name": "id", "type": "INTEGER", "constraint": "PRIMARY KEY AUTOINCREMENT"},
                    {"name": "k", "type": "INTEGER NOT NULL"}, {"name": "priority", "type": "TEXT"}, {"name": "page", "type": "TEXT"},
                    {"name": "crawled_at", "type": "TEXT NOT NULL DEFAULT (datetime('now', 'localtime'))"}],
        "indexes": [{"name": "uk", "columns": ["k"], "unique": True}]},
    "parser": {"type": "json", "root_path": "data.items", "fields": [
        {"name": "k", "path": "k", "to_number": True, "where": {"op": ">", "value": 20}},
        {"name": "priority", "path": "p", "regex_extract": "^([0-9])", "default": "?"}, {"name": "page", "value": "{url}"}]},
}


@query("job_json", """
    WITH rows AS (
      SELECT o_orderkey AS doc, 0 AS i, o_orderkey AS k, left(o_orderpriority, 1) AS priority, '/o/' || o_orderkey AS page FROM orders WHERE o_orderkey % 6 IN (0, 1)
      UNION ALL SELECT o_orderkey, 1, o_orderkey + 1, '?', '/o/' || o_orderkey FROM orders WHERE o_orderkey % 6 IN (0, 5)),
    kept AS (SELECT * FROM rows WHERE k > 20 QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc DESC, i DESC) = 1)
    SELECT coalesce(n.k, o.o_orderkey) AS k, coalesce(n.priority, 'old') AS priority, coalesce(n.page, 'old') AS page,
           CASE WHEN o.o_orderkey IS NULL THEN '2024-01-31 00:00:00' ELSE 'before' END AS crawled_at
    FROM kept n FULL OUTER JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) o ON n.k = o.o_orderkey""")
def job_json(spark, sf):
    """Payload text → rows → cleaning → predicate → keyed table, over an existing table."""
    target = table(spark, sf, "orders").where(F.pmod("o_orderkey", F.lit(4)) == 0).select(
        F.col("o_orderkey").alias("k"), F.lit("old").alias("priority"), F.lit("old").alias("page"), F.lit("before").alias("crawled_at"))
    return run_output(order_payloads(spark, sf), OutputSpec.from_dict(ORDER_OUTPUT), target, RUN_TS).table


PAGE_OUTPUT = {
    "target_table": "cells",
    "table_schema": {
        "columns": [{"name": "key", "type": "INTEGER"}, {"name": "status", "type": "TEXT"}, {"name": "customer", "type": "INTEGER"},
                    {"name": "heading", "type": "TEXT"}],
        "indexes": [{"name": "uk", "columns": ["key"], "unique": True}]},
    "parser": {"type": "html_table", "row_selector": "table tr", "filters": {"skip_lines": 1},
               "element_selector": {"heading": {"selector": "p"}},
               "fields": [{"name": "key", "column": 0, "to_number": True}, {"name": "status", "column": 1, "truncate_left": 1},
                          {"name": "customer", "column": 2, "selector": "a", "attr": "href", "regex_extract": r"/c/(\d+)", "to_number": True},
                          {"name": "heading", "value": "{heading}"}]},
}


@query("job_html", "SELECT o_orderkey AS key, o_orderstatus AS status, o_custkey AS customer, 'Orders' AS heading FROM orders")
def job_html(spark, sf):
    spec = OutputSpec.from_dict(PAGE_OUTPUT)
    target = spark.createDataFrame([], spec.table.schema)
    return run_output(order_pages(spark, sf), spec, target, RUN_TS).table


TASK = {
    "name": "segments", "type": "api", "url": "{base}/{segment}?page={page}",
    "params": {"base": "https://h.example"},
    "iterate": [{"var_name": "segment", "values": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]},
                {"var_name": "page", "values": [1, 2, 2, 3]}],
    "outputs": [
        {"target_table": "customers", "table_schema": {
            "columns": [{"name": "custkey", "type": "INTEGER"}, {"name": "name", "type": "TEXT"}, {"name": "segment", "type": "TEXT"}],
            "indexes": [{"name": "uk", "columns": ["custkey"], "unique": True}]},
         "parser": {"type": "json", "fields": [{"name": "custkey", "path": "id", "to_number": True}, {"name": "name", "path": "name"},
                                               {"name": "segment", "value": "{segment}"}]}},
        {"target_table": "nations", "table_schema": {
            "columns": [{"name": "nation", "type": "INTEGER"}, {"name": "seen_on", "type": "TEXT"}],
            "indexes": [{"name": "uk", "columns": ["nation"], "unique": True}]},
         "parser": {"type": "json", "fields": [{"name": "nation", "path": "n", "to_number": True}, {"name": "seen_on", "value": "{task_name}"}]}},
    ],
}


def task_result(spark, sf):
    c = table(spark, sf, "customer")
    body = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n")))
    landed = c.select(
        F.col("c_custkey").alias("doc_id"),
        F.concat(F.lit("https://h.example/"), F.col("c_mktsegment"), F.lit("?page="), F.pmod("c_custkey", F.lit(3)) + 1).alias("url"),
        body.alias("body"), F.when(F.pmod("c_custkey", F.lit(11)) == 0, F.lit(503)).otherwise(F.lit(404)).alias("status"),
        F.when(F.pmod("c_custkey", F.lit(13)) == 0, F.lit("timeout")).alias("error"))
    task = TaskSpec.from_dict(TASK)
    targets = {o.table.name: spark.createDataFrame([], o.table.schema) for o in task.outputs}
    return run_task(spark, task, RUN_TS, targets, landed)


@query("job_task", """
    SELECT c_custkey AS custkey, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0""")
def job_task(spark, sf):
    """Grid × landed answers × two outputs; failed answers are left out, the rest goes on."""
    return task_result(spark, sf).outputs["customers"].table


@query("job_task_totals", """
    SELECT count(*) + count(DISTINCT c_nationkey) AS new, count(*) - count(DISTINCT c_nationkey) AS updated, 0::BIGINT AS skipped, 2 * count(*) AS total
    FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0""")
def job_task_totals(spark, sf):
    return task_result(spark, sf).totals


_GRID_TABLE = {
    "columns": [{"name": "k", "type": "INTEGER NOT NULL"}, {"name": "name", "type": "TEXT"}, {"name": "region", "type": "TEXT"}],
    "indexes": [{"name": "uk", "columns": ["k", "region"], "unique": True}]}
_GRID_FIELDS = [{"name": "k", "source": "k", "to_number": True}, {"name": "name", "source": "name"}, {"name": "region", "value": "{region}"}]


@query("job_db_grid", """
    SELECT n_nationkey AS k, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA')""")
def job_db_grid(spark, sf):
    """A query with a variable is rendered and read once per value of the grid."""
    task = TaskSpec.from_dict({
        "name": "nations", "type": "db", "iterate": {"var_name": "region", "values": ["ASIA", "EUROPE", "AFRICA"]},
        "db": {"query": "SELECT n_nationkey AS k, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = '{region}'"},
        "target_table": "nations", "table_schema": _GRID_TABLE, "parser": {"type": "records", "fields": _GRID_FIELDS}})
    target = spark.createDataFrame([], task.outputs[0].table.schema)
    views = {"nation": table(spark, sf, "nation"), "region": table(spark, sf, "region")}
    return run_task(spark, task, RUN_TS, {"nations": target}, views=views).outputs["nations"].table


@query("job_csv_grid", """
    SELECT c_custkey AS k, c_name AS name, region FROM customer, (VALUES ('CN'), ('US')) g(region)""")
def job_csv_grid(spark, sf):
    """A file without variables in its path is read once and meets every value of the grid."""
    path = f"{shared_dir(spark)}/grid-{uuid.uuid4().hex}"
    table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).write.csv(path, header=True)
    task = TaskSpec.from_dict({
        "name": "customers", "type": "csv", "iterate": {"var_name": "region", "values": ["CN", "US"]}, "file": {"path": path, "multiline": False},
        "target_table": "customers", "table_schema": _GRID_TABLE, "parser": {"type": "records", "fields": _GRID_FIELDS}})
    target = spark.createDataFrame([], task.outputs[0].table.schema)
    return run_task(spark, task, RUN_TS, {"customers": target}).outputs["customers"].table


def _csv_files_task(base):
    return TaskSpec.from_dict({
        "name": "customer files", "type": "csv", "iterate": {"var_name": "region", "values": ["0", "1", "9", "3"]}, "file": {"path": base + "/r={region}", "multiline": False},
        "target_table": "customers", "table_schema": _GRID_TABLE, "parser": {"type": "records", "fields": _GRID_FIELDS}})


def _land_csv_files(spark, sf):
    base = f"{shared_dir(spark)}/grid-files-{uuid.uuid4().hex}"
    fifth = F.pmod("c_custkey", F.lit(5)).alias("r")
    table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), fifth).write.partitionBy("r").csv(base, header=True)
    return base


@query("job_csv_files", """
    SELECT c_custkey AS k, c_name AS name, (c_custkey % 5)::VARCHAR AS region FROM customer WHERE c_custkey % 5 IN (0, 1, 3)""")
def job_csv_files(spark, sf):
    """Paths rendered per value of the grid are one scan; the value whose files are absent is an error of its own."""
    task = _csv_files_task(_land_csv_files(spark, sf))
    target = spark.createDataFrame([], task.outputs[0].table.schema)
    return run_task(spark, task, RUN_TS, {"customers": target}).outputs["customers"].table


@query("rep_run_log", """
    SELECT 'customer files' AS task_name, 'partial' AS status, count(*) AS records_new, 0 AS records_updated, 0 AS records_skipped, true AS has_error
    FROM customer WHERE c_custkey % 5 IN (0, 1, 3)
    UNION ALL SELECT 'customers again', 'success', count(*) FILTER (c_custkey % 2 = 1), count(*) FILTER (c_custkey % 2 = 0), 0, false FROM customer
    UNION ALL SELECT 'no files', 'failed', 0, 0, 0, true""")
def rep_run_log(spark, sf):
    """Three runs, one of them with an absent file and one without any, and the log read back."""
    log, run_ts = f"{shared_dir(spark)}/run-log-{uuid.uuid4().hex}", dt.datetime(2024, 1, 31)
    base = _land_csv_files(spark, sf)
    task, absent = _csv_files_task(base), _csv_files_task(base + "-none")
    again = TaskSpec.from_dict({"name": "customers again", "type": "db", "db": {"query": "SELECT c_custkey AS k, c_name AS name, 'x' AS region FROM customer"},
                                "target_table": "customers", "table_schema": _GRID_TABLE,
                                "parser": {"type": "records", "fields": [*_GRID_FIELDS[:2], {"name": "region", "source": "region"}]}})
    empty = spark.createDataFrame([], task.outputs[0].table.schema)
    customer = table(spark, sf, "customer")
    half = customer.where("c_custkey % 2 = 0").selectExpr("c_custkey AS k", "c_name AS name", "'x' AS region")
    totals = lambda result: result.totals.first().asDict()
    record_run(spark, log, "customer files", lambda: run_task(spark, task, RUN_TS, {"customers": empty}), run_ts, totals)
    record_run(spark, log, "customers again", lambda: run_task(spark, again, RUN_TS, {"customers": half}, views={"customer": customer}), run_ts, totals)
    try:
        record_run(spark, log, "no files", lambda: run_task(spark, absent, RUN_TS, {"customers": empty}), run_ts, totals)
    except FileNotFoundError:
        pass  # recorded, and raised for the caller
    runs = spark.read.schema(RUN_SCHEMA).parquet(log)
    return runs.select("task_name", "status", "records_new", "records_updated", "records_skipped", F.col("error_msg").isNotNull().alias("has_error"))


@query("where_mixed", """
    SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (3, 5)""")
def where_mixed(spark, sf):
    """Literals of another kind than the column never equal it."""
    df = table(spark, sf, "customer")
    rules = [{"name": "c_mktsegment", "where": {"op": "in", "value": [7, "BUILDING", True, "MACHINERY"]}},
             {"name": "c_nationkey", "where": {"op": "not_in", "value": ["x", 3, "4", 5]}},
             {"name": "c_custkey", "where": {"op": "!=", "value": "1"}}]
    return Predicates().keep(df, rules).select("c_custkey", "c_name")


@query("where_in_long", """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_orderkey IN (SELECT 3 * x FROM range(100000) r(x)) AND o_custkey NOT IN (SELECT 7 * x FROM range(100000) r(x))""")
def where_in_long(spark, sf):
    """Lists of 100,000 values are tables, and the tests joins."""
    rules = [{"name": "o_orderkey", "where": {"op": "in", "value": [3 * k for k in range(100_000)]}},
             {"name": "o_custkey", "where": {"op": "not_in", "value": [7 * k for k in range(100_000)]}}]
    return Predicates().keep(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), rules)


@query("q_where_not_in_long", """
    SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT 2 * x FROM range(100000) r(x)) AND l_partkey IN (SELECT 3 * x FROM range(100000) r(x))
    GROUP BY l_orderkey""")
def q_where_not_in_long(spark, sf):
    where = [{"col": "l_orderkey", "op": "NOT IN", "value": [2 * k for k in range(100_000)]}, {"col": "l_partkey", "op": "IN", "value": [str(3 * k) for k in range(100_000)]}]
    rows = filter_table(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), where)
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"))
