import pytest
from pyspark.sql import functions as F

from ingestkit.functions.templates import render
from ingestkit.operators.fields import map_fields
from ingestkit.operators.grid import contexts, expand_grid
from ingestkit.operators.html_rows import html_rows, node_table, page_vars
from ingestkit.operators.json_rows import ORDINAL, ROW, json_field, json_rows
from ingestkit.operators.row_filters import filter_rows, first_row
from ingestkit.plans.output import Toolkit, extract_rows
from ingestkit.spec import OutputSpec
from tests.conftest import plan_of

RUN = "2026-08-03 14:30:00"  # a Monday


def payload(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "doc_id long, body string")


def jrows(spark, body, cfg):
    rows = json_rows(payload(spark, body), cfg)
    positional = bool(cfg.get("array_index_mapping"))
    return [tuple(r) for r in rows.orderBy(ORDINAL).select(*[json_field(f, positional) for f in cfg["fields"]]).collect()]


JSON = [
    ('{"title": "Hello", "count": 42}', {"fields": [{"path": "title"}, {"path": "count"}]}, [("Hello", "42")]),
    ('{"data": []}', {"root_path": "nonexistent", "fields": [{"path": "a"}]}, []),
    ('{"data": []}', {"root_path": "data", "fields": [{"path": "a"}]}, []),
    ("not json", {"fields": [{"path": "a"}]}, []),
    ("7", {"fields": [{"path": "a"}]}, []),
    ('"text"', {"fields": [{"path": "a"}]}, []),
    ('[{"a": 1}, {"a": 2}]', {"fields": [{"path": "a"}]}, [("1",), ("2",)]),
    ('{"x": [[{"a": 1}], [{"a": 2}, {"a": 3}]]}', {"root_path": "x.1", "fields": [{"path": "a"}]}, [("2",), ("3",)]),
    ('{"x": {"a": 5}}', {"root_path": "x", "fields": [{"path": "a"}]}, [("5",)]),
    ('[{"a": {"b": [10, 20, 30]}}]', {"fields": [{"path": "a.b.0"}, {"path": "a.b.-1"}, {"path": "a.b.9"}, {"path": "a.b.x"}]},
     [("10", "30", None, None)]),
    ('[{"a": {"0": "key"}}]', {"fields": [{"path": "a.0"}]}, [("key",)]),
    ('[{"a": 1}, 5, {"a": 2}]', {"fields": [{"path": "a"}]}, [("1",), (None,), ("2",)]),
    ('[{"s": null, "p": "x"}]', {"fields": [{"source": "none", "path": "p"}]}, [("x",)]),
    ('[{"a.b": 1}]', {"fields": [{"source": "a.b"}]}, [("1",)]),
    ('[[1, 2.5], ["x"], 3]', {"array_index_mapping": True, "fields": [{"position": 0}, {"position": 1}]},
     [("1", "2.5"), ("x", None), (None, None)]),
    ('[{"a":1},{"a":2},{"a":3},{"a":4}]', {"filters": {"skip_lines": 1, "head": 2, "tail": 1}, "fields": [{"path": "a"}]}, [("3",)]),
    ('[{"a":1}]', {"filters": {"skip_lines": 5}, "fields": [{"path": "a"}]}, []),
    ('[{"a":1}]', {"filters": {"tail": 5}, "fields": [{"path": "a"}]}, [("1",)]),
    ('{"a": true, "b": {"c": 1}, "d": [1, 2]}', {"fields": [{"path": "a"}, {"path": "b"}, {"path": "d"}]},
     [("true", '{"c":1}', "[1,2]")]),
]


@pytest.mark.parametrize("body,cfg,expected", JSON)
def test_json(spark, body, cfg, expected):
    assert jrows(spark, body, cfg) == expected


def test_json_is_parsed_once(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("props").alias("body"))
    rows = json_rows(events, {"fields": [{"path": "k"}]}).select("event_id", f"{ROW}.k")
    plan = plan_of(rows)
    assert plan.count("Generate") == 1 and "size(" not in plan.split("Generate")[1]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><script>var a = "<p>no</p>";</script></head><body>
<h1 id=top class="big red">Head</h1><nav><ul><li><a href="/a">A</a><li><a href='/b' rel=nofollow>B <b>bold</b></a></ul></nav>
<!-- <p>gone</p> --><div><p>one<p>two &lt;3<br>x</div><table class="data grid"><thead><tr><th>k<th>v</thead>
<tr><td> 1 <td><i>x</i></tr><tr><td>2<td><a href="/l">y</a> z</table>tail</body></html>"""

HTML = [
    ("nav li", [{}], [("A",), ("B bold",)]),
    ("nav > ul > li a[rel]", [{"attr": "href"}], [("/b",)]),
    ("nav > li", [{}], []),
    ("h1#top.red, title", [{}], [("T & x",), ("Head",)]),
    ("div p", [{}], [("one",), ("two <3x",)]),
    ("table.data tr", [{"column": 0}, {"column": 1}, {"column": 2}], [("k", "v", None), ("1", "x", None), ("2", "y z", None)]),
    ("table tr", [{"column": 1, "selector": "a", "attr": "href"}], [(None,), (None,), ("/l",)]),
    ("nav", [{"selector": "a", "multiple": True}, {"selector": "a"}, {"selector": "q"}], [(["A", "B bold"], "A", None)]),
    ("nav", [{"selector": "a", "multiple": True, "attr": "rel"}], [(["", "nofollow"],)]),
    ("tr:nth-child(3) td:first-child", [{"strip": False}], [("2",)]),
    ("table", [{"column": 0, "strip": False}], [("k",)]),
    ("[class~=grid] i, a[href$='b'], a[href^='/l'], a[href*='zz']", [{}], [("B bold",), ("x",), ("y",)]),
    ("script", [{}], [("",)]),
    ("h1 + nav a", [{}], [("A",), ("B bold",)]),
    ("title + script, p + p", [{}], [("",), ("two <3x",)]),
    ("h1 ~ div p", [{}], [("one",), ("two <3x",)]),
    ("li:last-child a:not([href='/a'])", [{}], [("B bold",)]),
    ("li:not(:first-child)", [{}], [("B bold",)]),
    ("tr:nth-child(odd) td:nth-of-type(2)", [{}], [("y z",)]),
    ("p:nth-child(-n+1), tr td:nth-child(2n)", [{}], [("one",), ("x",), ("y z",)]),
    ("div p:first-of-type, p:only-child", [{}], [("one",)]),
    ("br:empty, td i:only-child", [{}], [("",), ("x",)]),
    ("tr td", [{"strip": False}], [(" 1 ",), ("x",), ("2",), ("y z",)]),
]


@pytest.mark.parametrize("selector,fields,expected", HTML)
def test_html(spark, selector, fields, expected):
    named = [{"name": f"f{i}", **f} for i, f in enumerate(fields)]
    rows = html_rows(payload(spark, PAGE), {"row_selector": selector, "fields": named})
    assert [tuple(r[0]) for r in rows.orderBy(ORDINAL).select(ROW).collect()] == expected


def test_html_without_row_selector_or_body(spark):
    assert html_rows(payload(spark, PAGE), {"fields": [{"name": "a"}]}).count() == 0
    assert html_rows(payload(spark, None, "", "   "), {"row_selector": "p", "fields": [{"name": "a"}]}).count() == 0
    for bad in ("p:hover", "p >", "> p", "p:nth-child(x)", "p{", ":not(a b)"):
        with pytest.raises(ValueError):
            html_rows(payload(spark, PAGE), {"row_selector": bad, "fields": []})


def test_html_is_parsed_once_without_shuffle(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("html").alias("body"))
    rows = html_rows(page_vars(pages, {"t": {"selector": "title"}}), {"row_selector": "li", "fields": [{"name": "x"}]})
    plan = plan_of(rows.where("t <> 'q' AND _row.x <> ''"))
    assert plan.count("ArrowEvalPython") == 1
    # the only exchange is the one that spreads this tiny input over the cores
    assert plan.count("Exchange ") == plan.count("REPARTITION_BY_NUM") == 1
    # an input of more than one split is left where it is
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert "Exchange" not in plan_of(html_rows(pages, {"row_selector": "li", "fields": [{"name": "x"}]}))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_page_vars(spark):
    row = page_vars(payload(spark, PAGE), {"t": {"selector": "title"}, "h": {"selector": "h1", "attr": "class"},
                                           "no": {"selector": "h7"}, "noattr": {"selector": "h1", "attr": "zz"}, "c": 5,
                                           "skipped": {"attr": "x"}}).first()
    assert (row.t, row.h, row.no, row.noattr, row.c) == ("T & x", "big red", "", "", 5)
    assert "skipped" not in row.asDict()


def test_node_table(spark):
    nodes = {r.tag: r.text for r in node_table(payload(spark, PAGE), ["doc_id"]).collect()}
    assert nodes["h1"] == "Head" and nodes["title"] == "T & x"


TEMPLATES = [
    ("plain", "plain"), ("{today}", "2026-08-03"), ("{today:%Y%m%d}", "20260803"), ("{yesterday}", "2026-08-02"),
    ("{now}", "2026-08-03 14:30:00"), ("{now:%H}", "14"), ("{timestamp}", "1785767400"), ("{timestamp_ms}", "1785767400000"),
    ("{days_ago:3}", "2026-07-31"), ("{days_ago:7:%Y%m%d}", "20260727"), ("{weeks_ago:1}", "2026-07-27"),
    ("{weeks_ago:2:%d/%m}", "20/07"), ("{this_week:1}", "2026-08-03"), ("{this_week:7:%Y%m%d}", "20260809"),
    ("{last_week:1}", "2026-07-27"), ("{last_week:7}", "2026-08-02"), ("{task_name}", "job"), ("{id}/{ID}/{Mixed}", "5/5/{Mixed}"),
    ("{unknown}:{unknown:x}", "{unknown}:{unknown:x}"), ("{a b}", "{a b}"), ("{{id}}", "{5}"), ("{TODAY}", "2026-08-03"),
]


@pytest.mark.parametrize("template,expected", TEMPLATES)
def test_template(spark, template, expected):
    cols = {"task_name": F.lit("job"), "id": F.lit(5), "Mixed": F.lit("never found")}
    assert spark.range(1).select(render(template, RUN, cols)).first()[0] == expected


def test_grid(spark):
    df = expand_grid(spark.range(1).select("id"), [{"var_name": "a", "values": ["x", 1]}, {"var_name": "b", "values": [2, 3]}])
    assert sorted((r.a, r.b) for r in df.collect()) == [("1", "2"), ("1", "3"), ("x", "2"), ("x", "3")]
    assert expand_grid(spark.range(3), None).count() == 3
    assert expand_grid(spark.range(1), {"var_name": "a", "values": []}).count() == 0


def test_contexts(spark):
    rows = contexts(spark, {"var_name": "day", "values": ["{yesterday}", "now"]}, RUN, "u/{base}/{day}", "t", {"base": "b{today:%d}"}).collect()
    assert sorted((r.day, r.base, r.task_name) for r in rows) == [("2026-08-02", "b03", "t"), ("now", "b03", "t")]
    assert contexts(spark, None, RUN, "u/{task_name}", "t").collect()[0].url == "u/t"


def test_map_fields_nested_and_missing(spark):
    df = spark.createDataFrame([((1, ["x", "y"]), "n")], "a struct<b:int,c:array<string>>, name string")
    row = map_fields(df, [{"name": "b", "path": "a.b"}, {"name": "c", "path": "a.c.-1"}, {"name": "z", "path": "a.q"},
                          {"name": "v", "value": "{name}"}, {"name": "w", "value": "{today}"}]).first()
    assert tuple(row) == (1, "y", None, "n", "{today}")


def test_row_filters(spark):
    df = spark.createDataFrame([(d, i) for d in "ab" for i in range(6)], "doc string, i int")
    got = sorted((r.doc, r.i) for r in filter_rows(df, ["doc"], "i", {"skip_lines": 1, "head": 4, "tail": 2}).collect())
    assert got == [("a", 3), ("a", 4), ("b", 3), ("b", 4)]
    assert "Exchange" not in plan_of(filter_rows(df, ["doc"], "i", {"skip_lines": 1, "head": 2}))
    assert "WindowGroupLimit" in plan_of(filter_rows(df, ["doc"], "i", {"tail": 2}))
    assert sorted((r.doc, r.i) for r in first_row(df, ["doc"], "i").collect()) == [("a", 0), ("b", 0)]


def test_field_strategy_order(spark):
    kit = Toolkit()
    kit.register_field_first(lambda f, _p, _d: F.lit("secret") if f.get("encrypted") else None)
    out = OutputSpec.from_dict({"target_table": "t", "parser": {"type": "json", "fields": [
        {"name": "a", "path": "a", "encrypted": True}, {"name": "b", "path": "a"}]}})
    raw, _ = extract_rows(payload(spark, '{"a": "x"}'), out, kit)
    assert tuple(raw.select("a", "b").first()) == ("secret", "x")
