"""Second forms of reading, filtering and remembering, held against the first ones."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from ingestkit.functions.predicates import Predicates
from ingestkit.operators import members as M
from ingestkit.operators.json_rows import ORDINAL, json_field, json_rows
from ingestkit.operators.query import filter_table
from ingestkit.operators.seen import change_against, change_against_saved, merge_saved, merge_seen, save_seen
from ingestkit.operators.variant_rows import variant_field, variant_rows
from ingestkit.operators.xml_rows import xml_rows
from ingestkit.plans.output import Toolkit, extract_rows
from ingestkit.plans.task import RUN_SCHEMA, record_run, run_task
from ingestkit.sources.files import read_csv_grid, read_payload_files
from ingestkit.spec import OutputSpec, TaskSpec
from ingestkit.streaming.landing import read_landed, stream_bucket_latest
from ingestkit.streaming.ttl import stream_ttl_state
from tests.conftest import plan_of

RUN = "2026-08-03 14:30:00"


# ------------------------------------------------------------------ file grids

def test_files_of_a_grid_are_one_scan(spark, tmp_path):
    (tmp_path / "a 1%.csv").write_text(' id , name\n1,"x, y"\n\n2, z \n')
    (tmp_path / "b.csv").write_text("id,name\n3\n", encoding="utf-8-sig")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "p.csv").write_text("id,name\n4,q\n")
    (tmp_path / "c" / "_hidden.csv").write_text("id,name\n9,q\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.csv").write_text("name,id,v\nn,5,6\n")
    paths = ["a 1%.csv", "b.csv", "none.csv", "c", "empty.csv", "b.csv"]
    contexts = [(f"{tmp_path}/{p}", {"n": str(k), "who": "me"}) for k, p in enumerate(paths)]
    rows, errors = read_csv_grid(spark, {}, contexts)
    assert sorted(map(str, (tuple(r) for r in rows.select("id", "name", "n", "who").collect()))) == sorted(map(str, [
        ("1", "x, y", "0", "me"), ("2", "z", "0", "me"), ("3", None, "1", "me"), ("3", None, "5", "me"), ("4", "q", "3", "me")]))
    assert len(errors) == 1 and "none.csv" in errors[0] and plan_of(rows).count("FileScan csv") == 1
    mixed, _ = read_csv_grid(spark, {}, [*contexts[:2], (f"{tmp_path}/other.csv", {"n": "7", "who": "me"}), (f"{tmp_path}/?.csv", {"n": "8", "who": "me"})])
    assert plan_of(mixed).count("FileScan csv") == 2  # one for every header
    got = {(r.id, r.name, r.v, r.n) for r in mixed.collect()}
    assert ("5", "n", "6", "7") in got and ("3", None, None, "8") in got and len(got) == 5
    assert read_csv_grid(spark, {}, contexts[2:3])[0] is None


def test_a_failed_context_leaves_the_others(spark, tmp_path):
    (tmp_path / "1.csv").write_text("k\n1\n")
    (tmp_path / "3.csv").write_text("k\n3\n")
    output = {"target_table": "t", "table_schema": {"columns": [{"name": "k", "type": "INTEGER"}], "indexes": [{"columns": ["k"], "unique": True}]},
              "parser": {"type": "records", "fields": [{"name": "k", "source": "k", "to_number": True}]}}
    target = {"t": spark.createDataFrame([], "k long")}
    base = {"name": "n", "iterate": {"var_name": "n", "values": [1, 2, 3]}, "outputs": [output]}
    files = TaskSpec.from_dict({**base, "type": "csv", "file": {"path": f"{tmp_path}/{{n}}.csv"}})
    views = {"v1": spark.range(1, 2).toDF("k"), "v3": spark.range(3, 4).toDF("k")}
    queries = TaskSpec.from_dict({**base, "type": "db", "db": {"query": "SELECT k FROM v{n}"}})
    for task, more in ((files, {}), (queries, {"views": views})):
        log = str(tmp_path / f"log-{task.type}")
        kept = []
        row = record_run(spark, log, "n", lambda task=task, more=more: run_task(spark, task, RUN, target, **more), dt.datetime(2026, 8, 3),
                         lambda r: kept.append(sorted(x.k for x in r.outputs["t"].table.collect())) or r.totals.first().asDict())
        assert kept == [[1, 3]] and (row["status"], row["records_new"]) == ("partial", 2) and row["error_msg"]
        assert [tuple(r) for r in spark.read.schema(RUN_SCHEMA).parquet(log).select("status", "records_new").collect()] == [("partial", 2)]
    with pytest.raises(FileNotFoundError):
        run_task(spark, TaskSpec.from_dict({**base, "type": "csv", "file": {"path": f"{tmp_path}/x{{n}}.csv"}}), RUN, target)


def test_charset_leaves_the_session_as_it_was(spark, tmp_path):
    (tmp_path / "a").write_bytes("<p>漢字</p>".encode("big5hkscs"))
    name = "spark.sql.legacy.javaCharsets"
    spark.conf.unset(name)
    before = spark.conf.get(name)
    pages = read_payload_files(spark, str(tmp_path), "big5-hkscs")
    assert spark.conf.get(name) == before and pages.first().body == "<p>漢字</p>"


# ------------------------------------------------------------------ long lists

LISTS = [[1, 2, None], [1, 2.5, 3], [None], ["1", "x"], ["a", None, "b"], [2, 2, 2], list("abc")]


@pytest.mark.parametrize("column", ["k", "s"])
def test_long_lists_mean_what_short_ones_do(spark, monkeypatch, column):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "1"), (None, None), (4, "x"), (1, "c")], "k long, s string").withColumn("i", F.monotonically_increasing_id())
    ids = lambda frame: sorted(r.i for r in frame.collect())
    for values in LISTS:
        for op in ("in", "not_in"):
            rule = [{"name": column, "where": {"op": op, "value": values}}, {"name": "i", "where": {"op": ">=", "value": 0}}]
            cond = [{"col": column, "op": op.upper().replace("_", " "), "value": values}, {"col": "i", "op": ">=", "value": 0}]
            monkeypatch.setattr(M, "LONG", 1_000)
            short = ids(Predicates().keep(df, rule)), ids(filter_table(df, cond))
            monkeypatch.setattr(M, "LONG", -1)
            assert (ids(Predicates().keep(df, rule)), ids(filter_table(df, cond))) == short, (values, op)


def test_long_lists_are_no_literals(spark):
    df = spark.range(50_000).withColumnRenamed("id", "k")
    kept = Predicates().keep(df, [{"name": "k", "where": {"op": "in", "value": list(range(0, 40_000, 2))}}])
    assert kept.count() == 20_000 and "INSET" not in plan_of(kept).upper() and "LeftSemi" in plan_of(kept)


# -------------------------------------------------------------------- seen-log

def test_the_saved_log_is_not_shuffled(spark):
    import uuid

    a, b = (f"seen_{uuid.uuid4().hex}" for _ in range(2))
    schema = "url_hash string, url string, first_seen long, last_seen long, hit_count long, content_hash string"
    h = lambda u: __import__("hashlib").sha256(u.encode()).hexdigest()
    old = spark.createDataFrame([(h(u), u, 1, 5, 2, "x") for u in ("u1", "u2", "u3")], schema)
    new = spark.createDataFrame([(h("u2"), "u2", 4, 9, 1, "y"), (h("u3"), "u3", 0, 3, 1, "z"), (h("u4"), "u4", 7, 7, 1, "w")], schema)
    try:
        save_seen(old, a, 16)
        batch = spark.createDataFrame([("u1", "x"), ("u2", "q"), ("u9", "x"), (None, "x")], "url string, h string")
        got = change_against_saved(batch, a, "url", "h")
        assert sorted(map(str, got.collect())) == sorted(map(str, change_against(batch, old, "url", "h").collect()))
        log_side = plan_of(got).split("FileScan")[0].rsplit("SortMergeJoin", 1)[1]
        assert log_side.count("Exchange") == 1 and "Bucketed: true" in plan_of(got)  # the batch's
        merge_saved(a, new, b, 16)
        assert sorted(map(str, (tuple(r) for r in spark.table(b).select(*old.columns).collect()))) == sorted(
            map(str, (tuple(r) for r in merge_seen(old, new).select(*old.columns).collect())))
    finally:
        for t in (a, b):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


# --------------------------------------------------------------------- streams

def test_ttl_by_state_over_restarts(spark, tmp_path):
    rnd, ttl = random.Random(3), 40
    rows = sorted((s, rnd.choice(["hot", "hot", "a", "b", None]), i) for i, s in enumerate(rnd.sample(range(2_000), 300)))
    free, want = {}, []
    for s, k, i in rows:
        if s >= free.get(k, -1):
            want.append(i)
            free[k] = s + ttl
    schema = "k string, ts timestamp, i long, _odd int"
    for n in range(3):
        part = spark.createDataFrame([(k, s, i, 7) for s, k, i in rows[n * 100:(n + 1) * 100]] + ([("a", None, 10_000, 7)] if n == 1 else []), "k string, s long, i long, _odd int")
        part.select("k", F.timestamp_seconds("s").alias("ts"), "i", "_odd").write.mode("append").parquet(str(tmp_path / "in"))
        stream_ttl_state(read_landed(spark, str(tmp_path / "in"), schema), "k", "ts", ttl, "i", str(tmp_path / "out"), str(tmp_path / "cp"), "10 seconds")
    got = spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()
    assert sorted(r.i for r in got) == sorted([*want, 10_000]) and {r._odd for r in got} == {7}


@pytest.mark.parametrize("buckets", [1, 8])
def test_ttl_state_is_dealt_into_buckets(spark, tmp_path, buckets):
    """Many keys share a row of state: rows of state and calls into Python do not grow with the keys."""
    rnd, ttl, big = random.Random(buckets), 40, 1 << 60
    rows = sorted(((s, rnd.choice([None, *range(60)]), big + 2 * i + 1) for i, s in enumerate(rnd.choices(range(1, 600), k=900))), key=lambda r: (r[0], r[2]))
    free, want = {}, []
    for s, k, i in rows:
        if s >= free.get(k, -1):
            want.append((k, s, i, i if i % 3 else None))
            free[k] = s + ttl
    schema, states = "k long, s long, ts timestamp, i long, w long", []
    for n in range(3):
        part = spark.createDataFrame([(k, s, i, i if i % 3 else None) for s, k, i in rows if s // 200 == n], "k long, s long, i long, w long")
        part.select("k", "s", F.timestamp_seconds("s").alias("ts"), "i", "w").write.mode("append").parquet(str(tmp_path / "in"))
        query = stream_ttl_state(read_landed(spark, str(tmp_path / "in"), schema), "k", "ts", ttl, "i", str(tmp_path / "out"), str(tmp_path / "cp"), buckets=buckets)
        states += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()
    assert sorted(((r.k, r.s, r.i, r.w) for r in got), key=str) == sorted(want, key=str)
    assert 0 < max(states) <= buckets


def test_windows_are_written_once_the_watermark_has_passed(spark, tmp_path):
    schema = "k string, ts timestamp, v long, o long"

    def land(rows):
        spark.createDataFrame(rows, "k string, s long, v long, o long").select("k", F.timestamp_seconds("s").alias("ts"), "v", "o").write.mode("append").parquet(str(tmp_path / "in"))
        stream_bucket_latest(read_landed(spark, str(tmp_path / "in"), schema), ["k"], "ts", "1 hour", "v", ["ts", "o"], "2 hours", str(tmp_path / "out"), str(tmp_path / "cp"))
        return sorted((r.k, r.bucket // 3_600_000, r.v) for r in spark.read.schema("k string, bucket long, v long").parquet(str(tmp_path / "out")).collect())

    h = 3_600
    assert land([("a", 10, 1, 1), ("a", 20, 2, 1), ("a", 20, None, 2), ("b", h + 5, 3, 1), ("a", 4 * h, 4, 1)]) == sorted([("a", 0, None), ("b", 1, 3)], key=str)
    # within the watermark: hour 2 is open; hour 0 has been written
    assert land([("a", 2 * h + 9, 5, 1), ("a", 30, 99, 1), ("a", 6 * h, 6, 1)]) == sorted([("a", 0, None), ("a", 2, 5), ("b", 1, 3)], key=str)


# --------------------------------------------------------------------- Variant

BODIES = ['{"d":{"r":[{"a":1,"b":"x","c":{"l":[1,2]}},{"a":null,"A":7,"b":"{\\"q\\":1}"},5]}}', '{"d":{"r":{"a":true,"b":{"z":[1]}}}}', '{"d":{"r":"[{\\"a\\":1}]"}}',
          '{"d":{"r":[]}}', '{"d":{}}', "no json", None, '{"d":{"r":[{"a":"é\\u00e8","b":1.5,"c":{"l":[]}}]}}']


def test_variant_rows_equal_json_rows(spark):
    df = spark.createDataFrame(list(enumerate(BODIES)), "i int, body string")
    fields = [{"name": "a", "path": "a"}, {"name": "big", "source": "A"}, {"name": "b", "path": "b"}, {"name": "last", "path": "c.l.-1"}, {"name": "first", "path": "c.l.0"}]
    for filters in ({}, {"skip_lines": 1, "head": 1}):
        cfg = {"root_path": "d.r", "fields": fields, "filters": filters}
        rows = [{(r.i, r[ORDINAL], *(r[f["name"]] for f in fields)) for r in made(df, cfg).select("i", ORDINAL, *[field(f).alias(f["name"]) for f in fields]).collect()}
                for made, field in ((json_rows, json_field), (variant_rows, variant_field))]
        assert rows[0] == rows[1] and rows[0]
    plan = plan_of(variant_rows(df, {"root_path": "d.r", "fields": fields}).select(*[variant_field(f).alias(f["name"]) for f in fields]))
    assert len(re.findall(r"parseJson|parse_json", plan)) == 1


# -------------------------------------------------------------- table function

def test_xml_rows(spark):
    kit = Toolkit()
    kit.register_table_function("xml", xml_rows)
    out = OutputSpec.from_dict({"target_table": "t", "parser": {"type": "xml", "arguments": ["r"], "fields": [{"name": "n", "source": "n"}, {"name": "m", "path": "m"}]}})
    bodies = ['<x><r n="1"><m>a</m></r><g><r><n>2</n></r></g></x>', "<x/>", "<x><r n='3'>", None, "", "<r n='é'/>"]
    raw, _ = extract_rows(spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string"), out, kit)
    assert sorted(map(str, (tuple(r) for r in raw.collect()))) == sorted(map(str, [(0, 0, "1", "a"), (0, 1, "2", None), (5, 0, "é", None)]))
