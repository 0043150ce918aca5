"""Sources, contexts, templates, extraction and per-payload filters."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestkit.catalog.base import ORACLES, query, table
from ingestkit.functions.cleaning import WHITESPACE, Cleaner
from ingestkit.functions.templates import render
from ingestkit.operators.fields import map_fields
from ingestkit.operators.grid import expand_grid
from ingestkit.operators.html_rows import html_field, html_rows, page_vars
from ingestkit.operators.json_rows import ORDINAL, ROW, json_field, json_rows
from ingestkit.operators.row_filters import filter_rows, first_row, skip_head, tail
from ingestkit.operators.variant_rows import variant_field, variant_rows
from ingestkit.operators.xml_rows import xml_rows
from ingestkit.plans.output import Toolkit, extract_rows
from ingestkit.session import setting, shared_dir
from ingestkit.sources.database import sql_source
from ingestkit.sources.files import normalize_sheet, payload_frame, read_csv, read_payload_files
from ingestkit.spec import OutputSpec

# -------------------------------------------------------------------- sources


@query("src_csv", """
    SELECT c_custkey::VARCHAR AS custkey, 'say "' || c_name || '", ok' AS name, c_mktsegment AS segment,
           CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_nationkey::VARCHAR END AS nation FROM customer""")
def src_csv(spark, sf):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("custkey"),
        F.concat(F.lit(' say "'), F.col("c_name"), F.lit('", ok ')).alias(" name"),
        F.concat(F.lit("　"), F.col("c_mktsegment"), F.lit("\t")).alias("segment "),
        F.when(F.pmod("c_custkey", F.lit(7)) == 0, F.lit("")).otherwise(F.col("c_nationkey").cast("string")).alias("nation"),
    ).write.csv(path, header=True, sep=";", quoteAll=True, escape='"',
                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    # no line ends inside cells, so large files may be split
    return read_csv(spark, {"path": path, "delimiter": ";", "multiline": False})


@query("normalize_sheet", """
    SELECT CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_custkey::VARCHAR END AS key,
           CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS col_1,
           CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS segment
    FROM customer WHERE c_custkey % 15 <> 0""")
def normalize(spark, sf):
    key = F.col("c_custkey")
    by5, by3 = F.pmod(key, F.lit(5)) == 0, F.pmod(key, F.lit(3)) == 0
    df = table(spark, sf, "customer").select(
        F.when(~by5, key).alias(" key "), F.when(~by3, F.concat(F.col("c_name"), F.lit(" "))).alias(" "),
        F.when(~by5, F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("segment"))
    return normalize_sheet(df)


@query("src_sql_season_day", """
    SELECT user_id, 13 AS ss, ((epoch_us(ts) // 1000) - 1704067200000) // 86400000 + 1 AS ss_day, max(value) AS peak
    FROM events GROUP BY ALL""")
def src_sql_season_day(spark, sf):
    events = table(spark, sf, "events").withColumn("stat_ts", F.unix_millis(F.col("ts").cast("timestamp")))
    return sql_source(spark, """
        SELECT user_id, 13 AS ss, (stat_ts - 1704067200000) div 86400000 + 1 AS ss_day, max(value) AS peak
        FROM hourly GROUP BY user_id, ss, ss_day""", {"hourly": events})


@query("src_payload_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def src_payload_json(spark, sf):
    payloads = payload_frame(table(spark, sf, "events"), "props", doc_id="event_id")
    field = {"name": "k", "path": "k", "type": "INTEGER", "to_number": True}
    rows = json_rows(payloads, {"fields": [field]}).select(F.col("doc_id").alias("event_id"), json_field(field).alias("k"))
    return Cleaner().clean(rows, [field], keep=["event_id"])


# ------------------------------------------------------- contexts and templates

@query("ctx_grid", """
    SELECT c_custkey, r.region, p.page, 'x' AS mode FROM customer,
      (SELECT unnest(['global', 'CN', '7']) AS region) r, (SELECT unnest(['1', '2']) AS page) p""")
def ctx_grid(spark, sf):
    return expand_grid(table(spark, sf, "customer").select("c_custkey"),
                       [{"var_name": "region", "values": ["global", "CN", 7]}, {"var_name": "page", "values": [1, 2]}],
                       {"mode": "x"})


@query("tpl_url", """
    SELECT c_custkey, 'https://h.example/' || c_mktsegment || '?n=' || c_nationkey || '&d=20240130&t=daily&{nope}={c_Custkey:x}'
      || '-' || c_custkey AS url FROM customer""")
def tpl_url(spark, sf):
    df = table(spark, sf, "customer")
    cols = {"seg": F.col("c_mktsegment"), "nat": F.col("c_nationkey"), "key": F.col("c_custkey"), "task_name": F.lit("daily")}
    text = "https://h.example/{seg}?n={NAT}&d={yesterday:%Y%m%d}&t={task_name}&{nope}={c_Custkey:x}-{key}"
    return df.select("c_custkey", render(text, "2024-01-31 08:00:00", cols).alias("url"))


@query("tpl_dates", """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS today, strftime(ts - INTERVAL 1 DAY, '%d/%m/%y') AS yesterday,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS now, (epoch_us(ts) // 1000) // 1000 || '|' || (epoch_us(ts) // 1000) AS stamps,
      strftime(ts - INTERVAL 3 DAY, '%Y-%m-%d') AS days_ago, strftime(ts - INTERVAL 14 DAY, '%Y%m%d') AS weeks_ago,
      strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS this_sunday,
      strftime(date_trunc('week', ts) - INTERVAL 7 DAY, '%Y.%m.%d') AS last_monday
    FROM events""")
def tpl_dates(spark, sf):
    templates = {
        "today": "{today}", "yesterday": "{yesterday:%d/%m/%y}", "now": "{now}", "stamps": "{timestamp}|{timestamp_ms}",
        "days_ago": "{days_ago:3}", "weeks_ago": "{weeks_ago:2:%Y%m%d}", "this_sunday": "{this_week:7}",
        "last_monday": "{last_week:1:%Y.%m.%d}",
    }
    df = table(spark, sf, "events")
    return df.select("event_id", *[render(t, F.col("ts")).alias(n) for n, t in templates.items()])


_UNESCAPE = ("replace(replace(replace(replace({0}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')")


def _pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", F.col("html").alias("body"))


@query("page_vars", f"""
    SELECT page_id, {_UNESCAPE.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
           regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
           regexp_extract(html, '<nav>.*?<a href="([^"]*)"', 1) AS first_link, '' AS missing, 'k' AS fixed
    FROM pages""")
def page_variables(spark, sf):
    return page_vars(_pages(spark, sf), {
        "title": {"selector": "head > title"}, "lang": {"selector": "html", "attr": "lang"},
        "first_link": {"selector": "nav li a", "attr": "href"}, "missing": {"selector": "table.none td"}, "fixed": "k",
    }).select("page_id", "title", "lang", "first_link", "missing", "fixed")


# ------------------------------------------------------------------- JSON rows

def order_payloads(spark, sf) -> DataFrame:
    """Orders as API answers: a list, a single object, no path, broken text, a scalar, mixed values."""
    record = F.struct(F.col("o_orderkey").alias("k"), F.concat(F.lit(" "), F.col("o_orderpriority")).alias("p"),
                      F.struct(F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("ids")).alias("c"))
    short = F.struct((F.col("o_orderkey") + 1).alias("k"), F.lit(None).cast("string").alias("p"))
    key = F.pmod("o_orderkey", F.lit(6))
    one, two = F.to_json(record), F.to_json(short)
    def wrap(inner):
        return F.concat(F.lit('{"data":{"items":'), inner, F.lit("}}"))
    body = (F.when(key == 0, wrap(F.concat(F.lit("["), one, F.lit(","), two, F.lit("]"))))
            .when(key == 1, wrap(one)).when(key == 2, F.lit('{"data":{}}'))
            .when(key == 3, F.concat(F.lit('{"data":{"items":['), one))
            .when(key == 4, wrap(F.lit("7")))
            .otherwise(wrap(F.concat(F.lit("[3,"), two, F.lit(',"s",null]')))))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("/o/"), F.col("o_orderkey")).alias("url"), body.alias("body"))


_ORDER_ROWS = """
    SELECT o_orderkey AS doc_id, 0 AS ordinal, o_orderkey::VARCHAR AS k, ' ' || o_orderpriority AS p, (o_custkey + 1)::VARCHAR AS last_id
      FROM orders WHERE o_orderkey % 6 IN (0, 1)
    UNION ALL SELECT o_orderkey, 1, (o_orderkey + 1)::VARCHAR, NULL, NULL FROM orders WHERE o_orderkey % 6 IN (0, 5)
    UNION ALL SELECT o_orderkey, i, NULL, NULL, NULL FROM orders, (SELECT unnest([0, 2, 3]) AS i) WHERE o_orderkey % 6 = 5"""


@query("json_rows", _ORDER_ROWS)
def json_row_query(spark, sf):
    fields = [{"name": "k", "path": "k"}, {"name": "p", "path": "p"}, {"name": "last_id", "path": "c.ids.-1"}]
    rows = json_rows(order_payloads(spark, sf), {"root_path": "data.items", "fields": fields})
    return rows.select("doc_id", F.col(ORDINAL).alias("ordinal"), *[json_field(f).alias(f["name"]) for f in fields])


@query("json_path", """
    SELECT event_id, json_extract_string(props, '$.k') AS k, user_id::VARCHAR AS second, event_type AS deep,
           NULL::VARCHAR AS missing FROM events""")
def json_path(spark, sf):
    events = table(spark, sf, "events")
    nested = F.to_json(F.struct(
        F.from_json("props", "struct<k:bigint>").alias("props"),
        F.array(F.col("event_id"), F.col("user_id")).alias("ids"),
        F.array(F.struct(F.struct(F.col("event_type").alias("t")).alias("in"))).alias("list")))
    fields = [{"name": "k", "path": "props.k"}, {"name": "second", "path": "ids.1"},
              {"name": "deep", "path": "list.0.in.t"}, {"name": "missing", "path": "list.4.in.t"}]
    rows = json_rows(events.select("event_id", nested.alias("body")), {"fields": fields})
    return rows.select("event_id", *[json_field(f).alias(f["name"]) for f in fields])


@query("json_positions", """
    SELECT event_id, i AS ordinal, CASE i WHEN 0 THEN (epoch_us(ts) // 1000) ELSE event_id END::BIGINT AS stat_ts,
           CASE i WHEN 0 THEN value END AS value, NULL::VARCHAR AS beyond
    FROM events, (SELECT unnest([0, 1]) AS i)""")
def json_positions(spark, sf):
    events = table(spark, sf, "events")
    body = F.concat(F.lit('{"points":[['), F.unix_millis(F.col("ts").cast("timestamp")), F.lit(","), F.col("value"),
                    F.lit("],["), F.col("event_id"), F.lit("]]}"))
    fields = [{"name": "stat_ts", "position": 0, "type": "INTEGER", "to_number": True},
              {"name": "value", "position": 1, "type": "REAL", "to_number": True}, {"name": "beyond", "position": 9}]
    rows = json_rows(events.select("event_id", body.alias("body")),
                     {"root_path": "points", "array_index_mapping": True, "fields": fields})
    raw = rows.select("event_id", F.col(ORDINAL).alias("ordinal"),
                      *[json_field(f, positional=True).alias(f["name"]) for f in fields])
    return Cleaner().clean(raw, fields, keep=["event_id", "ordinal"])


# ------------------------------------------------------------------- HTML rows

@query("html_rows", f"""
    SELECT page_id, ordinal - 1 AS ordinal, trim({_UNESCAPE.format("regexp_extract(m, '>([^<]*)</a>', 1)")}, '{WHITESPACE}') AS label
    FROM (SELECT page_id, unnest(ms) AS m, generate_subscripts(ms, 1)::INTEGER AS ordinal
          FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a>') AS ms FROM pages))""")
def html_row_query(spark, sf):
    rows = html_rows(_pages(spark, sf), {"row_selector": "nav li a", "fields": [{"name": "label"}]})
    return rows.select("page_id", F.col(ORDINAL).alias("ordinal"), f"{ROW}.label")


@query("html_attr", f"""
    SELECT page_id, ordinal - 1 AS ordinal, trim({_UNESCAPE.format("regexp_extract(m, 'href=\"([^\"]*)\"', 1)")}, '{WHITESPACE}') AS href, '' AS rel
    FROM (SELECT page_id, unnest(ms) AS m, generate_subscripts(ms, 1)::INTEGER AS ordinal
          FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a>') AS ms FROM pages))""")
def html_attr(spark, sf):
    rows = html_rows(_pages(spark, sf), {"row_selector": "nav li", "fields": [
        {"name": "href", "selector": "a[href^='/']", "attr": "href"}, {"name": "rel", "selector": "a", "attr": "rel"}]})
    return rows.select("page_id", F.col(ORDINAL).alias("ordinal"), f"{ROW}.href", f"{ROW}.rel")


@query("html_multi", f"""
    SELECT page_id, len(ps) AS n, array_to_string(list_transform(ps, lambda p: trim({_UNESCAPE.format("regexp_replace(p, '<[^>]*>', '', 'g')")}, '{WHITESPACE}')), chr(10) || '--' || chr(10)) AS texts
    FROM (SELECT page_id, list_transform(string_split(split_part(split_part(html, '<article>', 2), '</article>', 1), '<p>')[2:],
            lambda p: split_part(p, '</p>', 1)) AS ps FROM pages)""")
def html_multi(spark, sf):
    rows = html_rows(_pages(spark, sf), {"row_selector": "body > article",
                                         "fields": [{"name": "p", "selector": "p", "multiple": True}]})
    return rows.select("page_id", F.size(f"{ROW}.p").cast("bigint").alias("n"), F.array_join(f"{ROW}.p", "\n--\n").alias("texts"))


def order_pages(spark, sf) -> DataFrame:
    """Orders as pages with one table: end tags left out, entities, a link inside a cell."""
    key = F.col("o_orderkey")
    html = F.concat(
        F.lit("<p>Orders<p><table class='grid wide' id=t><tr><th>Key<th>Status<th>Customer<tr class=row><td>"), key,
        F.lit("<td> "), F.col("o_orderstatus"), F.lit(" &amp; co<td><b>No.</b> <a href='/c/"), F.col("o_custkey"),
        F.lit("?a=1&amp;b=2'>Customer <i>"), F.col("o_custkey"), F.lit("</i></a></table>after"))
    return table(spark, sf, "orders").select(key.alias("doc_id"), F.lit("u").alias("url"), html.alias("body"))


@query("html_cells", """
    SELECT o_orderkey AS doc_id, 0 AS ordinal, 'Key' AS key, 'Status' AS status, 'Customer' AS customer, NULL AS link, NULL AS label,
           NULL::VARCHAR AS beyond, 'KeyStatusCustomer' AS whole FROM orders
    UNION ALL SELECT o_orderkey, 1, o_orderkey::VARCHAR, o_orderstatus || ' & co', 'No. Customer ' || o_custkey,
           '/c/' || o_custkey || '?a=1&b=2', 'Customer ' || o_custkey, NULL,
           o_orderkey || ' ' || o_orderstatus || ' & coNo. Customer ' || o_custkey FROM orders""")
def html_cells(spark, sf):
    rows = html_rows(order_pages(spark, sf), {"row_selector": "table.grid#t tr", "fields": [
        {"name": "key", "column": 0}, {"name": "status", "column": 1}, {"name": "customer", "column": 2},
        {"name": "link", "column": 2, "selector": "a", "attr": "href"}, {"name": "label", "column": 2, "selector": "td > a"},
        {"name": "beyond", "column": 9}, {"name": "whole"}]})
    return rows.select("doc_id", F.col(ORDINAL).alias("ordinal"), f"{ROW}.*")


# -------------------------------------------------------------- record mapping

@query("map_fields", """
    SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, NULL::VARCHAR AS nothing FROM customer""")
def map_field_query(spark, sf):
    df = table(spark, sf, "customer").withColumn("home", F.struct(F.col("c_nationkey").alias("n")))
    return map_fields(df, [
        {"name": "id", "source": "c_custkey"}, {"name": "name", "source": "no such", "path": "c_name"},
        {"name": "nation", "path": "home.n"}, {"name": "segment", "selector": "c_mktsegment"},
        {"name": "nothing", "source": "no such"}])


@query("const_field", """
    SELECT c_custkey, 'batch-7' AS tag, c_mktsegment AS region, '{nobody}' AS unknown, 3 AS n FROM customer""")
def const_field(spark, sf):
    df = table(spark, sf, "customer").withColumn("region", F.col("c_mktsegment"))
    return map_fields(df, [
        {"name": "tag", "value": "batch-7", "source": "c_name"}, {"name": "region", "value": "{region}"},
        {"name": "unknown", "value": "{nobody}"}, {"name": "n", "value": 3}], keep=["c_custkey"])


@query("field_chain", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS label,
           CASE WHEN c_custkey % 2 = 0 THEN 'pinned' ELSE c_name END AS pinned FROM customer""")
def field_chain(spark, sf):
    kit = Toolkit()
    # a user strategy ahead of the chain and one behind it
    kit.register_field_first(lambda f, _p, _d: F.when(F.pmod("c_custkey", F.lit(2)) == 0, f["pin"]) if "pin" in f else None)
    kit.register_field_last(lambda f, _p, _d: F.col(f["fallback"]) if "fallback" in f else None)
    df = table(spark, sf, "customer").withColumns({
        "hidden": F.when(F.pmod("c_custkey", F.lit(3)) != 0, F.col("c_mktsegment")), "doc_id": F.col("c_custkey"),
        ORDINAL: F.lit(0)})
    out = OutputSpec.from_dict({"target_table": "t", "parser": {"type": "records", "fields": [
        {"name": "c_custkey", "source": "c_custkey"}, {"name": "label", "source": "hidden", "fallback": "c_name"},
        {"name": "pinned", "source": "c_name", "pin": "pinned"}]}})
    return extract_rows(df, out, kit)[0].drop("_doc", ORDINAL)


@query("first_row", """
    SELECT conv_id, arg_min(turn, turn) AS turn, arg_min(role, turn) AS role, arg_min(text, turn) AS text
    FROM conversations GROUP BY conv_id""")
def first_row_query(spark, sf):
    return first_row(table(spark, sf, "conversations"), ["conv_id"], "turn")


# ------------------------------------------------------------- payload filters

@query("rows_skip", "SELECT conv_id, turn, role FROM conversations WHERE turn >= 2")
def rows_skip(spark, sf):
    return skip_head(table(spark, sf, "conversations"), "turn", skip=2).select("conv_id", "turn", "role")


@query("rows_head", "SELECT conv_id, turn, role FROM conversations WHERE turn >= 1 AND turn < 3")
def rows_head(spark, sf):
    return skip_head(table(spark, sf, "conversations"), "turn", skip=1, head=2).select("conv_id", "turn", "role")


@query("rows_tail", """
    SELECT conv_id, turn, role FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2""")
def rows_tail(spark, sf):
    return tail(table(spark, sf, "conversations"), ["conv_id"], "turn", 2).select("conv_id", "turn", "role")


@query("rows_all_filters", """
    SELECT conv_id, turn FROM conversations WHERE turn >= 1 AND turn < 5
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def rows_all_filters(spark, sf):
    return filter_rows(table(spark, sf, "conversations"), ["conv_id"], "turn",
                       {"skip_lines": 1, "head": 4, "tail": 3}).select("conv_id", "turn")


@query("rows_sliced", """
    SELECT o_orderkey AS doc_id, i - 2 AS ordinal, (o_orderkey + i)::VARCHAR AS k FROM orders, (SELECT unnest([2, 3]) AS i)""")
def rows_sliced(spark, sf):
    """The same filters on a list inside the payload: cut before it becomes rows."""
    items = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct((F.col("o_orderkey") + i).alias("k")))
    payloads = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.to_json(items).alias("body"))
    field = {"name": "k", "path": "k"}
    rows = json_rows(payloads, {"fields": [field], "filters": {"skip_lines": 1, "head": 3, "tail": 2}})
    return rows.select("doc_id", F.col(ORDINAL).alias("ordinal"), json_field(field).alias("k"))


# ------------------------------------------------------------------ extensions

@query("ext_rows", """
    SELECT doc_id, ordinal - 1 AS ordinal, line FROM (
      SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INTEGER AS ordinal
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE ordinal % 2 = 1""")
def ext_rows(spark, sf):
    """A user's row extractor (text lines) and payload filter (every n-th row)."""
    kit = Toolkit()
    kit.register_rows("lines", lambda df, _cfg, body: df.select(
        "doc_id", F.posexplode(F.split(body, "\n", -1)).alias(ORDINAL, "line")).select(
        "doc_id", ORDINAL, F.struct("line").alias(ROW)))
    kit.register_filter("every", lambda df, n: df.where(F.pmod(ORDINAL, F.lit(n)) == 0))
    out = OutputSpec.from_dict({"target_table": "t", "parser": {
        "type": "lines", "filters": {"every": 2}, "fields": [{"name": "line", "source": "line"}]}})
    payloads = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    raw, _ = extract_rows(payloads, out, kit)
    return raw.select(F.col("_doc").alias("doc_id"), F.col(ORDINAL).alias("ordinal"), "line")


@query("multi_output", """
    SELECT 'rows' AS output, event_id, k, NULL::BIGINT AS hour FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
    UNION ALL SELECT 'hours', event_id, NULL, (epoch_us(ts) // 1000) // 3600000 * 3600000 FROM events""")
def multi_output(spark, sf):
    """One payload frame, two outputs with their own parsers."""
    events = table(spark, sf, "events")
    body = F.to_json(F.struct(F.from_json("props", "struct<k:bigint>").alias("row"),
                              F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("t")).alias("clock")))
    payloads = events.select(F.col("event_id").alias("doc_id"), body.alias("body"))
    outputs = [
        {"target_table": "rows", "parser": {"type": "json", "root_path": "row", "fields": [
            {"name": "k", "path": "k", "type": "INTEGER", "to_number": True}]}},
        {"target_table": "hours", "parser": {"type": "json", "root_path": "clock", "fields": [
            {"name": "hour", "path": "t", "type": "INTEGER", "to_number": True, "ts_floor_to_hour": True}]}},
    ]
    parts = []
    for spec in map(OutputSpec.from_dict, outputs):
        raw, _ = extract_rows(payloads, spec, Toolkit())
        rows = Cleaner().clean(raw, [dict(f, type="INTEGER") for f in spec.parser["fields"]], keep=["_doc"])
        parts.append(rows.withColumn("output", F.lit(spec.table.name)))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.select("output", F.col("_doc").alias("event_id"), "k", "hour")


@query("json_kinds", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN user_id END::VARCHAR AS a, CASE event_id % 4 WHEN 0 THEN user_id END::VARCHAR AS b
    FROM events WHERE event_id % 4 <> 2""")
def json_kinds(spark, sf):
    """Keys that differ in case, an object for a list, a text that holds JSON (no rows), a list of other things."""
    fields = [{"name": "a", "path": "id"}, {"name": "b", "path": "ID"}]
    return json_rows(kind_payloads(spark, sf), {"root_path": "data", "fields": fields}).select("event_id", *[json_field(f).alias(f["name"]) for f in fields])


def kind_payloads(spark, sf):
    e = table(spark, sf, "events")
    kind, both = F.pmod("event_id", F.lit(4)), F.to_json(F.array(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("ID"))))
    data = (F.when(kind == 0, both).when(kind == 1, F.to_json(F.struct(F.col("user_id").alias("id"))))
            .when(kind == 2, F.concat(F.lit('"'), F.replace(both, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.lit("[5]")))
    return e.select("event_id", F.concat(F.lit('{"data": '), data, F.lit("}")).alias("body"))


@query("json_variant", _ORDER_ROWS)
def json_variant(spark, sf):
    """``json_rows`` by Variant: one parse, then typed reads."""
    fields = [{"name": "k", "path": "k"}, {"name": "p", "path": "p"}, {"name": "last_id", "path": "c.ids.-1"}]
    rows = variant_rows(order_payloads(spark, sf), {"root_path": "data.items", "fields": fields})
    return rows.select("doc_id", F.col(ORDINAL).alias("ordinal"), *[variant_field(f).alias(f["name"]) for f in fields])


@query("json_variant_kinds", ORACLES["json_kinds"])
def json_variant_kinds(spark, sf):
    fields = [{"name": "a", "path": "id"}, {"name": "b", "path": "ID"}]
    return variant_rows(kind_payloads(spark, sf), {"root_path": "data", "fields": fields}).select("event_id", *[variant_field(f).alias(f["name"]) for f in fields])


@query("ext_rows_udtf", """
    SELECT c_nationkey AS doc_id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS ordinal, c_custkey AS id, c_name AS name,
           CASE WHEN c_custkey % 3 = 0 THEN 'a < b' END AS remark FROM customer""")
def ext_rows_udtf(spark, sf):
    """XML payloads, read by a Python table function whose columns follow the fields asked for."""
    kit = Toolkit()
    kit.register_table_function("xml", xml_rows)
    remark = F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.lit("<remark>a &lt; b</remark>")).otherwise(F.lit(""))
    row = F.concat(F.lit('<row id="'), F.col("c_custkey").cast("string"), F.lit('"><name>'), F.col("c_name"), F.lit("</name>"), remark, F.lit("</row>"))
    bodies = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("x")))).alias("rows"))
    payloads = bodies.select("doc_id", F.concat(F.lit("<rows>"), F.array_join(F.transform("rows", lambda r: r["x"]), ""), F.lit("</rows>")).alias("body"))
    out = OutputSpec.from_dict({"target_table": "t", "parser": {"type": "xml", "arguments": ["row"], "fields": [
        {"name": "id", "source": "id"}, {"name": "name", "source": "name"}, {"name": "remark", "source": "remark"}]}})
    raw, _ = extract_rows(payloads, out, kit)
    return raw.select(F.col("_doc").alias("doc_id"), F.col(ORDINAL).alias("ordinal"), F.col("id").cast("bigint").alias("id"), "name", "remark")


@query("src_payload_html", """
    SELECT c_custkey AS k, '漢字 ' || c_name AS name FROM customer""")
def src_payload_html(spark, sf):
    """Pages land as files in another charset; they are read as bytes, decoded and taken apart by selectors."""
    path = f"{shared_dir(spark)}/html-{uuid.uuid4().hex}"
    line = F.concat(F.lit("<tr><td class=k>"), F.col("c_custkey").cast("string"), F.lit("</td><td class=n>漢字 "), F.col("c_name"), F.lit("</td></tr>"))
    rows = table(spark, sf, "customer").select(line.alias("line"), F.pmod("c_custkey", F.lit(4)).alias("page"))
    with setting(spark, "spark.sql.legacy.javaCharsets", "true"):
        rows.repartition(4, "page").write.partitionBy("page").option("encoding", "big5-hkscs").option("sep", "\x01").option("quote", "\x00").csv(path)
    pages = read_payload_files(spark, f"{path}/*", "big5-hkscs").select("url", F.concat(F.lit("<table>"), "body", F.lit("</table>")).alias("body"))
    fields = [{"name": "k", "selector": "td.k"}, {"name": "name", "selector": "td.n"}]
    found = html_rows(pages.withColumn("doc_id", F.lit(0)), {"type": "html", "row_selector": "tr", "fields": fields}, "body")
    return found.select(html_field(fields[0]).cast("bigint").alias("k"), html_field(fields[1]).alias("name"))
