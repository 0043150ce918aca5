import datetime as dt

import pytest
from pyspark.sql import functions as F

from ingestkit.operators import query as q
from ingestkit.plans import reports
from ingestkit.plans.output import Toolkit, run_output
from ingestkit.plans.task import requests, record_run, run_task
from ingestkit.sources.database import env_value, jdbc_options, sql_source
from ingestkit.sources.files import acceptable, normalize_sheet, read_csv, read_payload_files
from ingestkit.sources.tables import ensure_table, read_partitions, read_table, upsert_partitions, upsert_table
from ingestkit.spec import OutputSpec, SpecError, TableSpec, TaskSpec
from ingestkit.streaming.landing import read_landed
from ingestkit.streaming.ttl import stream_dedup_loose
from tests.conftest import plan_of

RUN = "2026-08-03 14:30:00"
LOTS = {
    "name": "lots", "type": "api", "url": "https://h.example/lots/{n}", "iterate": {"var_name": "n", "values": [1, 2, 3]},
    "outputs": [{
        "target_table": "lots",
        "table_schema": {
            "columns": [{"name": "id", "type": "INTEGER", "constraint": "PRIMARY KEY AUTOINCREMENT"},
                        {"name": "lot_no", "type": "INTEGER NOT NULL"}, {"name": "label", "type": "TEXT"},
                        {"name": "found_at", "type": "TEXT NOT NULL"},
                        {"name": "crawled_at", "type": "TEXT NOT NULL DEFAULT (datetime('now', 'localtime'))"}],
            "indexes": [{"name": "i", "columns": ["lot_no"], "unique": True}, {"name": "j", "columns": ["label"]}]},
        "parser": {"type": "json", "fields": [{"name": "lot_no", "path": "id", "to_number": True}, {"name": "label", "path": "label"},
                                              {"name": "found_at", "value": "{url}"}]}}],
}


def landed(spark):
    return spark.createDataFrame([
        (1, "https://h.example/lots/1", '{"id": 1, "label": " a "}', None), (2, "https://h.example/lots/2", '[{"id": 2}, {"id": 1, "label": "b"}]', None),
        (3, "https://h.example/lots/3", None, "timeout"), (4, "https://h.example/lots/9", '{"id": 9}', None)],
        "doc_id long, url string, body string, error string")


# ----------------------------------------------------------------------- query

@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, "Apple", 10.0), (2, "apricot", None), (3, "b\\c", 30.0), (None, "pear", 5.0)], "k int, name string, v double")


WHERE = [
    ("k", "=", "2", [2]), ("k", "<>", 2, [1, 3]), ("k", ">", "1", [2, 3]), ("k", "<=", "x", [1, 2, 3]), ("k", "=", "x", []),
    ("k", "IN", [1, "3"], [1, 3]), ("k", "IN", [], []), ("k", "NOT IN", [], [1, 2, 3, None]), ("k", "not in", [1], [2, 3]),
    ("k", "IN", ["x"], []), ("name", "LIKE", "AP%", [1, 2]), ("name", "NOT LIKE", "ap%", [3, None]), ("name", "LIKE", "b\\c", [3]),
    ("v", "IS NULL", None, [2]), ("k", "IS NOT NULL", None, [1, 2, 3]), ("v", "BETWEEN", [10, "30"], [1, 3]), ("name", "=", 5, []),
]


@pytest.mark.parametrize("col,op,value,expected", WHERE)
def test_where(small, col, op, value, expected):
    page, total = q.query_table(small, where=[{"col": col, "op": op, "value": value}])
    assert sorted((r.k for r in page.collect()), key=lambda k: (k is None, k)) == expected
    assert total.first()[0] == len(expected)


@pytest.mark.parametrize("kw", [
    {"fields": "nope"}, {"where": "not json"}, {"where": '{"col": "k"}'}, {"where": [{"col": "nope"}]}, {"where": [{"col": "k", "op": "~"}]},
    {"where": [{"col": "k", "op": "IN", "value": 1}]}, {"where": [{"col": "k", "op": "BETWEEN", "value": [1]}]}, {"group_by": "nope"},
    {"group_by": "k"}, {"group_by": "k", "fields": "name"}, {"order_by": "nope"}, {"order_by": "k; DROP"}, {"aggregate": "SUM(nope)"},
    {"aggregate": "COUNT(DISTINCT k)"}, {"aggregate": "SUM(v) AS s; --"}, {"aggregate": "MEDIAN(v)"}, {"aggregate": "SUM(*)"}, {"limit": 0}, {"limit": 10_000},
    {"offset": -1}])
def test_bad_queries(small, kw):
    with pytest.raises(q.QueryError):
        q.query_table(small, **kw)


def test_order_page_and_hidden_order_column(small):
    page, total = q.query_table(small, "name", order_by="v DESC, k", limit=2, offset=1)
    assert [r.name for r in page.collect()] == ["Apple", "pear"] and total.first().total == 4
    assert [r.k for r in q.query_table(small, "k", order_by="v")[0].collect()][0] == 2  # NULL first when ascending
    assert "TakeOrderedAndProject" in plan_of(page)


def test_default_order_only_where_the_column_exists(spark, small):
    assert q.query_table(small)[0].count() == 4
    crawled = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, crawled_at string")
    assert [r.k for r in q.query_table(crawled)[0].collect()] == ["b", "a"]


def test_deep_page_equals_plain_page(spark, monkeypatch):
    df = spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(5000)).alias("x"), F.pmod("id", F.lit(7)).alias("g"))
    want = [tuple(r) for r in q.page(df, "g DESC, x", 40, 3000).collect()]
    monkeypatch.setattr(q, "TOP_K_ROWS", 10)
    assert [tuple(r) for r in q.page(df, "g DESC, x", 40, 3000).collect()] == want


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = q.query_table(df, "l_orderkey", where=[{"col": "l_quantity", "op": ">", "value": 10}], limit=None)[0]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


# --------------------------------------------------------------------- sources

def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes('﻿ id , name ,x\r\n1,"a ""q"", b",\r\n\r\n 2 ,"two\nlines"\r\n3,　c　,"",extra\r\n'.encode())
    df = read_csv(spark, {"path": str(f)})
    assert df.columns == ["id", "name", "x"]
    assert [tuple(r) for r in df.collect()] == [("1", 'a "q", b', ""), ("2", "two\nlines", None), ("3", "c", "")]
    g = tmp_path / "b.csv"
    g.write_bytes("名;v\n香港;1\n".encode("gbk"))
    assert read_csv(spark, {"path": str(g), "encoding": "gbk", "delimiter": ";"}).collect()[0]["名"] == "香港"
    h = tmp_path / "c.csv"
    h.write_text('a,b,c,d\n1,,\n"x,""y",,,\n"p,q"\n')
    assert [tuple(r) for r in read_csv(spark, {"path": str(h)}).collect()] == [
        ("1", "", "", None), ('x,"y', "", "", ""), ("p,q", None, None, None)]
    assert [r.d for r in read_csv(spark, {"path": str(h)}).select("d").collect()] == [None, "", None]
    with pytest.raises(ValueError):
        read_csv(spark, {})


def test_sheet(spark):
    df = spark.createDataFrame([(1, " a ", None), (None, None, None)], "k int, ` ` string, z string")
    out = normalize_sheet(df)
    assert out.columns == ["k", "col_1", "z"] and [tuple(r) for r in out.collect()] == [("1", "a", "")]


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>1\n2</p>", encoding="utf-8")
    assert read_payload_files(spark, str(tmp_path / "*.html")).first().body == "<p>1\n2</p>"
    (tmp_path / "b.txt").write_bytes("é".encode("latin-1"))
    assert read_payload_files(spark, str(tmp_path / "*.txt"), "iso-8859-1").first().body == "é"
    (tmp_path / "c.dat").write_bytes("香港嘅".encode("big5hkscs"))
    assert read_payload_files(spark, str(tmp_path / "*.dat"), "big5hkscs").first().body == "香港嘅"
    df = spark.createDataFrame([(200,), (404,), (500,), (None,)], "status int")
    assert acceptable(df).count() == 3


def test_database_options(spark):
    opts = jdbc_options({"type": "mysql", "host": "db", "user": "u", "password": "${SECRET}", "database": "d", "query": "SELECT 1"}, {"SECRET": "s3"})
    assert opts["url"] == "jdbc:mysql://db:3306/d" and opts["password"] == "s3" and opts["query"] == "SELECT 1"
    parts = jdbc_options({"type": "mysql", "query": "SELECT 1", "partition": {"column": "id", "lower": 0, "upper": 9, "partitions": 3}})
    assert parts["dbtable"] == "(SELECT 1) q" and parts["numPartitions"] == "3" and "query" not in parts
    assert env_value("a${X}b", {"X": "1"}) == "a1b" and env_value(5) == 5
    for bad in ({"type": "oracle", "query": "x"}, {"type": "mysql"}):
        with pytest.raises(ValueError):
            jdbc_options(bad)
    t = spark.createDataFrame([(1, "{x}")], "k int, t string")
    assert sql_source(spark, "SELECT t.k, t FROM tab t WHERE t.t = '{x}'", {"tab": t}).first().k == 1


# ------------------------------------------------------------------ spec, jobs

def test_spec_checks():
    with pytest.raises(SpecError):
        TaskSpec.from_dict({"name": "x"})
    with pytest.raises(SpecError):
        TaskSpec.from_dict({"outputs": [{"target_table": "t"}]})
    with pytest.raises(SpecError):
        OutputSpec.from_dict({"target_table": "t", "parser": {"fields": [{"name": "a"}, {"name": "a"}]}})
    with pytest.raises(SpecError):
        OutputSpec.from_dict({"target_table": "t", "table_schema": {"columns": [{"name": "a", "type": "TEXT"}]}, "parser": {"fields": [{"name": "b"}]}})
    two = [{"columns": ["a"], "unique": True}, {"columns": ["b"], "unique": True}]
    both = TableSpec.from_dict("t", {"columns": [{"name": "a", "type": "TEXT"}, {"name": "b", "type": "TEXT"}, {"name": "c", "type": "TEXT UNIQUE"}], "indexes": two})
    assert both.keys == ("a",) and both.unique == (("a",), ("b",), ("c",))
    with pytest.raises(SpecError):
        TableSpec.from_dict("t", {"columns": [{"name": "a", "type": "TEXT"}], "indexes": two})
    quoted = TableSpec.from_dict("t", {"columns": [{"name": "a", "type": "TEXT NOT NULL DEFAULT 'unique'"}, {"name": "b", "type": "INTEGER", "constraint": "PRIMARY KEY"}]})
    assert quoted.unique == (("b",),)
    t = TaskSpec.from_dict(LOTS).outputs[0].table
    assert t.keys == ("lot_no",) and t.not_null() == ["lot_no", "found_at", "crawled_at"]
    assert [c.name for c in t.columns] == ["lot_no", "label", "found_at", "crawled_at"]


def test_column_defaults(spark):
    spec = TableSpec.from_dict("t", {"columns": [
        {"name": "a", "type": "TEXT DEFAULT (strftime('%Y-%m-%d %H', 'now', 'localtime'))"}, {"name": "b", "type": "REAL", "constraint": "DEFAULT 1.5"},
        {"name": "c", "type": "TEXT DEFAULT 'it''s'"}, {"name": "d", "type": "TEXT DEFAULT NULL"}, {"name": "e", "type": "TEXT DEFAULT (date('now'))"}]})
    found = spec.defaults(RUN)
    row = spark.range(1).select(*[v.alias(k) for k, v in found.items()]).first()
    assert row.asDict() == {"a": "2026-08-03 14", "b": 1.5, "c": "it's", "e": "2026-08-03"}


def test_task_end_to_end(spark, tmp_path):
    task = TaskSpec.from_dict(LOTS)
    spec = task.outputs[0].table
    target = ensure_table(spark, str(tmp_path / "t"), spec)
    assert target.count() == 0
    result = run_task(spark, task, RUN, {"lots": target}, landed(spark))
    rows = {r.lot_no: r for r in result.outputs["lots"].table.collect()}
    assert set(rows) == {1, 2} and rows[1].label == "b" and rows[1].found_at.endswith("/2") and rows[2].crawled_at == RUN
    assert tuple(result.totals.first()) == (2, 1, 0, 3)
    assert tuple(result.errors.first()) == (1, "timeout")
    batch = result.outputs["lots"].rows
    first = upsert_table(spark, str(tmp_path / "t"), spec, batch, RUN, ["_doc", "_ordinal"])
    assert first == {"inserted": 2, "updated": 1, "total": 3}
    later = upsert_table(spark, str(tmp_path / "t"), spec, batch, "2026-08-04 00:00:00", ["_doc", "_ordinal"])
    assert later == {"inserted": 0, "updated": 3, "total": 3}
    # the default is not applied again to rows that were there
    assert {r.crawled_at for r in read_table(spark, str(tmp_path / "t")).collect()} == {RUN}


def test_batch_is_counted_while_written(spark, tmp_path):
    spec = TaskSpec.from_dict(LOTS).outputs[0].table
    batch = spark.createDataFrame([(1, "a", "u"), (1, "b", "u"), (2, "c", "u")], "lot_no long, label string, found_at string")
    assert upsert_table(spark, str(tmp_path / "t"), spec, batch, RUN, "label") == {"inserted": 2, "updated": 1, "total": 3}
    assert upsert_table(spark, str(tmp_path / "t"), spec, batch, RUN, "label") == {"inserted": 0, "updated": 3, "total": 3}


def test_not_null_batch_changes_nothing(spark, tmp_path):
    spec = TaskSpec.from_dict(LOTS).outputs[0].table
    good = spark.createDataFrame([(1, "a", "u")], "lot_no long, label string, found_at string")
    bad = spark.createDataFrame([(2, "a", "u"), (3, "a", None)], "lot_no long, label string, found_at string")
    upsert_table(spark, str(tmp_path / "t"), spec, good, RUN, "label")
    with pytest.raises(Exception, match="NOT NULL constraint failed: found_at"):
        upsert_table(spark, str(tmp_path / "t"), spec, bad, RUN, "label")
    assert [r.lot_no for r in read_table(spark, str(tmp_path / "t")).collect()] == [1]


def test_partitioned_upsert_replaces_touched_partitions_only(spark, tmp_path):
    spec = TableSpec.from_dict("p", {"columns": [{"name": "day", "type": "TEXT"}, {"name": "k", "type": "INTEGER"}, {"name": "v", "type": "REAL"}],
                                     "indexes": [{"columns": ["day", "k"], "unique": True}]})
    path = str(tmp_path / "p")
    upsert_partitions(spark, path, spec, spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "day string, k long, v double"), RUN, ["day"], "v")
    untouched = sorted(f.name for f in (tmp_path / "p" / "_part=%3Da").glob("*.parquet"))
    counts = upsert_partitions(spark, path, spec, spark.createDataFrame([("b", 2, 5.0), ("c", 3, 3.0)], "day string, k long, v double"), RUN, ["day"], "v")
    assert counts == {"inserted": 1, "updated": 1, "total": 2}
    assert sorted((r.day, r.k, r.v) for r in read_partitions(spark, path, spec).collect()) == [("a", 1, 1.0), ("b", 2, 5.0), ("c", 3, 3.0)]
    assert sorted(f.name for f in (tmp_path / "p" / "_part=%3Da").glob("*.parquet")) == untouched
    with pytest.raises(ValueError):
        upsert_partitions(spark, path, spec, spark.range(1), RUN, ["v"], "v")


def test_null_and_empty_partition_values_survive(spark, tmp_path):
    spec = TableSpec.from_dict("p", {"columns": [{"name": "p", "type": "TEXT"}, {"name": "k", "type": "INTEGER"}],
                                     "indexes": [{"columns": ["p", "k"], "unique": True}]})
    path = str(tmp_path / "p")
    for batch in ([(None, 1), ("", 5), ("null", 6)], [(None, 2)], [("", 5), ("a/b=&", 7)]):
        upsert_partitions(spark, path, spec, spark.createDataFrame(batch, "p string, k long"), RUN, ["p"], "k")
    assert sorted(((r.p, r.k) for r in read_partitions(spark, path, spec).collect()), key=str) == sorted(
        [(None, 1), (None, 2), ("", 5), ("null", 6), ("a/b=&", 7)], key=str)


def test_buckets_read_only_what_a_batch_touches(spark, tmp_path):
    spec = TableSpec.from_dict("b", {"columns": [{"name": "k", "type": "INTEGER"}, {"name": "v", "type": "TEXT"}], "indexes": [{"columns": ["k"], "unique": True}]})
    path = str(tmp_path / "b")
    upsert_partitions(spark, path, spec, spark.range(100).selectExpr("id AS k", "'old' AS v"), RUN, order_by="v", buckets=8)
    before = {f.name for f in (tmp_path / "b").glob("_part=*/*.parquet")}
    counts = upsert_partitions(spark, path, spec, spark.createDataFrame([(7, "new")], "k long, v string"), RUN, order_by="v", buckets=8)
    after = {f.name for f in (tmp_path / "b").glob("_part=*/*.parquet")}
    assert counts == {"inserted": 0, "updated": 1, "total": 1} and len({f.split("-")[2] for f in before - after}) <= 1 and before & after
    assert {r.k: r.v for r in read_partitions(spark, path, spec).collect()} == {k: "new" if k == 7 else "old" for k in range(100)}


def test_excel_task_is_refused(spark):
    task = TaskSpec.from_dict({**LOTS, "type": "excel", "file": {"path": "x.xlsx"}})
    with pytest.raises(ValueError, match="normalize_sheet"):
        run_task(spark, task, RUN, {"lots": spark.createDataFrame([], task.outputs[0].table.schema)})


def test_first_context_of_a_repeated_address(spark):
    task = TaskSpec.from_dict({**LOTS, "url": "https://x.example/same", "iterate": {"var_name": "region", "values": ["ZZ", "AA", "MM"]}})
    assert [r.region for r in requests(spark, task, RUN).collect()] == ["ZZ"]


def test_quarantine(spark):
    spec = OutputSpec.from_dict({**LOTS["outputs"][0], "parser": {"type": "json", "fields": [{"name": "lot_no", "path": "id", "to_number": True}]}})
    payloads = spark.createDataFrame([(1, "u", '[{"id": 1}, {"id": "x"}]')], "doc_id long, url string, body string")
    target = spark.createDataFrame([], spec.table.schema)
    out = run_output(payloads, spec, target, RUN, on_error="quarantine")
    assert out.table.count() == 1 and [r._errors for r in out.quarantined.collect()] == [["lot_no"]]
    assert run_output(payloads, spec, target, RUN).table.count() == 2


def test_page_variables_reach_later_outputs(spark):
    from ingestkit.plans.output import run_outputs

    def out(table, parser):
        return OutputSpec.from_dict({"target_table": table, "parser": parser})

    payloads = spark.createDataFrame([(1, "u", "<h1>T</h1><p>a<p>b")], "doc_id long, url string, body string")
    first = out("a", {"type": "html", "row_selector": "p", "element_selector": {"h": {"selector": "h1"}}, "fields": [{"name": "x"}]})
    second = out("b", {"type": "html", "row_selector": "h1", "fields": [{"name": "y", "value": "{h}"}]})
    empty = {"a": spark.createDataFrame([], "x string"), "b": spark.createDataFrame([], "y string")}
    got = run_outputs(payloads, [first, second], empty, RUN, Toolkit())
    assert sorted(r.x for r in got["a"].table.collect()) == ["a", "b"] and got["b"].table.first().y == "T"


@pytest.mark.parametrize("error,status", [(None, "success"), ("timeout", "partial")])
def test_run_record(spark, tmp_path, error, status):
    task = TaskSpec.from_dict(LOTS)
    source = landed(spark).withColumn("error", F.when(F.col("error").isNotNull(), F.lit(error)))
    target = spark.createDataFrame([], task.outputs[0].table.schema)
    row = record_run(spark, str(tmp_path / "log"), "lots", lambda: run_task(spark, task, RUN, {"lots": target}, source),
                     dt.datetime(2026, 8, 3), lambda r: r.totals.first().asDict())
    assert row["status"] == status and row["records_new"] == 2 and row["records_updated"] == 1
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_failed_run_is_recorded(spark, tmp_path):
    def broken():
        raise RuntimeError("no source")
    with pytest.raises(RuntimeError):
        record_run(spark, str(tmp_path / "log"), "x", broken, dt.datetime(2026, 8, 3), lambda r: {})
    assert spark.read.parquet(str(tmp_path / "log")).first().error_msg == "no source"


def test_csv_and_db_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("game,rank\n1, 5 \n1,6\n")
    output = {"target_table": "t", "table_schema": {"columns": [{"name": "s", "type": "INTEGER"}, {"name": "r", "type": "INTEGER"}, {"name": "who", "type": "TEXT"}],
                                                    "indexes": [{"columns": ["s"], "unique": True}]},
              "parser": {"type": "sdk_mapping", "fields": [{"name": "s", "source": "game", "to_number": True}, {"name": "r", "source": "rank", "to_number": True},
                                                           {"name": "who", "value": "{owner}"}]}}
    target = {"t": spark.createDataFrame([], "s long, r long, who string")}
    csv = TaskSpec.from_dict({"name": "c", "type": "csv", "params": {"owner": "me"}, "file": {"path": str(tmp_path / "a.csv")}, "outputs": [output]})
    assert [tuple(r) for r in run_task(spark, csv, RUN, target).outputs["t"].table.collect()] == [(1, 6, "me")]
    db = TaskSpec.from_dict({"name": "d", "type": "db", "db": {"query": "SELECT id AS game, id + 1 AS rank FROM src"}, "outputs": [output]})
    got = run_task(spark, db, RUN, target, views={"src": spark.range(3)}).outputs["t"].table.collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, "{owner}"), (1, 2, "{owner}"), (2, 3, "{owner}")]


# --------------------------------------------------------------------- reports

def test_reports(spark):
    logs = spark.createDataFrame([
        (1, 1, dt.datetime(2026, 8, 3, 1), "success", 5, 1), (2, 1, dt.datetime(2026, 8, 3, 2), "failed", None, None),
        (3, 2, dt.datetime(2026, 8, 1), "success", 7, 0), (4, 9, dt.datetime(2026, 7, 1), "running", 1, 1)],
        "id long, task_id long, run_time timestamp, status string, records_new long, records_updated long")
    tasks = spark.createDataFrame([(1, "a", 1, "t"), (2, "b", 0, "t")], "id long, task_name string, enabled int, target_table string")
    assert [(r.status, r.runs) for r in reports.status_distribution(logs, RUN).collect()] == [("success", 2), ("running", 0), ("failed", 1)]
    assert [tuple(r)[1:] for r in reports.daily_trend(logs, RUN).collect()] == [(1, 7, 0), (2, 5, 1)]
    page, total = reports.list_logs(logs, tasks, limit=3)
    assert [(r.id, r.task_name) for r in page.collect()] == [(2, "a"), (1, "a"), (3, "b")] and total.first()[0] == 4
    page, total = reports.list_logs(logs, tasks, task_name="nobody")
    assert page.count() == 0 and total.first()[0] == 0
    assert reports.list_logs(logs, tasks, task_name="a", status="failed")[0].first().id == 2
    assert reports.one_log(logs, tasks, 4).first().task_name is None
    assert tuple(reports.task_counts(tasks).first()) == (2, 1, 1)
    with pytest.raises(q.QueryError):
        reports.list_logs(logs, tasks, limit=501)


@pytest.mark.parametrize("text,value", [("12.5 km", 12.5), (" -3", -3.0), ("1e3x", 1000.0), (".5", 0.5), ("x1", 0.0), (None, 0.0), ("5.", 5.0)])
def test_numeric_prefix(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(reports.numeric_prefix(F.col("t"))).first()[0] == value


def test_series(spark):
    df = spark.createDataFrame([(1, "2", "a"), (2, "4", "a"), (3, "x", None)], "x int, y string, s string")
    points = reports.chart_series(df, "x", "y", "s")
    assert [tuple(r) for r in points.collect()] == [("a", 1, 2.0), ("a", 2, 4.0), ("null", 3, 0.0)]
    assert {r.series: r.mean for r in reports.series_means(points).collect()} == {"a": 3.0, "null": 0.0, None: 2.0}


# ------------------------------------------------------------------- streaming

def test_loose_stream_dedup(spark, tmp_path):
    rows = spark.createDataFrame([("u", dt.datetime(2026, 1, 1), 1), ("u", dt.datetime(2026, 1, 1, 0, 1), 2), ("v", dt.datetime(2026, 1, 1), 3)],
                                 "url string, ts timestamp, i long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = stream_dedup_loose(read_landed(spark, str(tmp_path / "in"), rows.schema), "url", "ts", 300)
    run = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    run.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u", "v"]
