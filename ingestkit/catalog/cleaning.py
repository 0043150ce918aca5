"""Cleaning rules, predicates and their extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ingestkit.catalog.base import query, table
from ingestkit.functions.cleaning import WHITESPACE, Cleaner, clean_column
from ingestkit.functions.predicates import Predicates

_WS_CLASS = "[" + WHITESPACE + "]+"


@query("clean_default", """
    SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'N/A' ELSE c_mktsegment END AS segment,
           CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END::BIGINT AS nation
    FROM customer""")
def clean_default(spark, sf):
    hidden = F.pmod("c_custkey", F.lit(7)) == 0
    df = table(spark, sf, "customer").select(
        "c_custkey", F.when(~hidden, F.col("c_mktsegment")).alias("segment"),
        F.when(~hidden, F.col("c_nationkey").cast("string")).alias("nation"))
    return Cleaner().clean(df, [{"name": "segment", "default": "N/A"},
                                {"name": "nation", "type": "INTEGER", "to_number": True, "default": -1}],
                           keep=["c_custkey"])


@query("clean_strip", f"SELECT doc_id, trim(text, '{WHITESPACE}') AS text FROM documents")
def clean_strip(spark, sf):
    df = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("　\t "), F.col("text"), F.lit(" \n\xa0")).alias("text"))
    return Cleaner().clean(df, [{"name": "text"}], keep=["doc_id"])


@query("clean_truncate", f"""
    SELECT doc_id, substr(s, 1, 40) AS head, CASE WHEN length(s) > 25 THEN left(s, length(s) - 25) ELSE s END AS body
    FROM (SELECT doc_id, trim(text, '{WHITESPACE}') AS s FROM documents)""")
def clean_truncate(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("text").alias("head"), F.col("text").alias("body"))
    return Cleaner().clean(df, [{"name": "head", "truncate_left": 40}, {"name": "body", "truncate_right": 25}],
                           keep=["doc_id"])


@query("clean_ws", f"""
    SELECT doc_id, regexp_replace(trim(text, '{WHITESPACE}'), '{_WS_CLASS}', ' ', 'g') AS text FROM documents""")
def clean_ws(spark, sf):
    return Cleaner().clean(table(spark, sf, "documents"), [{"name": "text", "trim_whitespace": True}], keep=["doc_id"])


@query("clean_html", f"""
    SELECT page_id, replace(replace(replace(replace(replace(replace(
             regexp_replace(trim(html, '{WHITESPACE}'), '<[^>]+>', '', 'g'),
             '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text
    FROM pages""")
def clean_html(spark, sf):
    df = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    return Cleaner().clean(df, [{"name": "text", "remove_html": True}], keep=["page_id"])


@query("clean_regex_extract", r"""
    SELECT page_id, CASE WHEN regexp_matches(url, 'page=(\d+)') THEN regexp_extract(url, 'page=(\d+)', 1) ELSE 'none' END AS page,
           regexp_extract(url, '^https?://([^/]+)/([a-z]+)', 2) AS lang,
           regexp_extract(url, '[a-z]+\.example\.[a-z]+', 0) AS host
    FROM pages""")
def clean_regex_extract(spark, sf):
    url = F.col("url")
    df = table(spark, sf, "pages").select("page_id", url.alias("page"), url.alias("lang"), url.alias("host"))
    return Cleaner().clean(df, [
        {"name": "page", "regex_extract": r"page=(\d+)", "default": "none"},
        {"name": "lang", "regex_extract": r"^https?://([^/]+)/(?P<lang>[a-z]+)", "group": 2},
        {"name": "host", "regex_extract": r"[a-z]+\.example\.[a-z]+"},
    ], keep=["page_id"])


@query("clean_regex_replace", f"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(trim(text, '{WHITESPACE}'),
             '[0-9]+', '#', 'g'), '([a-z]+)@([a-z]+)', '\\2 at \\1', 'g'), '[.]{{2,}}', '$', 'g') AS text
    FROM documents""")
def clean_regex_replace(spark, sf):
    return Cleaner().clean(table(spark, sf, "documents"), [{"name": "text", "regex_replace": [
        {"pattern": "[0-9]+", "replacement": "#"},
        {"pattern": r"(?P<user>[a-z]+)@([a-z]+)", "replacement": r"\2 at \g<user>"},
        {"pattern": "[.]{2,}", "replacement": "$"},
    ]}], keep=["doc_id"])


@query("clean_number_expr", """
    SELECT c_custkey, trunc(round(abs(c_acctbal), 2) * CASE c_custkey % 5 WHEN 0 THEN 10000 WHEN 1 THEN 100000000
             WHEN 2 THEN 1000000 ELSE 1 END)::BIGINT AS amount,
           CASE WHEN c_acctbal < 0 THEN NULL ELSE trunc(round(c_acctbal, 2))::BIGINT END AS signed_amount
    FROM customer""")
def clean_number_expr(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("万", " 亿", "M", "", "万人")]),
                        (F.pmod("c_custkey", F.lit(5)) + 1).cast("int"))
    df = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.round(F.abs("c_acctbal"), 2).cast("string"), unit).alias("amount"),
        F.round("c_acctbal", 2).cast("string").alias("signed_amount"))
    return Cleaner().clean(df, [{"name": "amount", "type": "INTEGER", "number_expr_to_int": True},
                                {"name": "signed_amount", "type": "INTEGER", "number_expr_to_int": True}],
                           keep=["c_custkey"])


@query("clean_to_number", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_totalprice END AS price,
           (o_custkey * 1000)::BIGINT AS cust,
           CASE WHEN o_orderkey % 5 = 4 THEN ['_errors', 'price'] ELSE ['_errors'] END[2] AS bad_field
    FROM orders""")
def clean_to_number(spark, sf):
    key = F.pmod("o_orderkey", F.lit(5))
    text = F.format_number("o_totalprice", 2)
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key == 0, text).when(key == 1, F.replace(text, F.lit(","), F.lit("，")))
        .when(key == 2, F.translate(text, "0123456789", "０１２３４５６７８９"))
        .when(key == 3, F.concat(F.lit(" "), text, F.lit("　"))).otherwise("n/a").alias("price"),
        F.format_number(F.col("o_custkey") * 1000, 0).alias("cust"))
    out = Cleaner().clean(df, [{"name": "price", "type": "REAL", "to_number": True},
                               {"name": "cust", "type": "INTEGER", "to_number": True}], "collect", keep=["o_orderkey"])
    return out.select("o_orderkey", "price", "cust", F.get("_errors", F.lit(0)).alias("bad_field"))


@query("clean_datetime", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN 'on request'
             WHEN o_orderkey % 8 = 5 THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S')
             ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS at,
           CASE WHEN o_orderkey % 8 = 7 THEN 'on request'
             WHEN o_orderkey % 8 = 5 THEN strftime(date_trunc('month', o_orderdate), '%Y/%m/%d')
             ELSE strftime(o_orderdate, '%Y/%m/%d') END AS day
    FROM orders""")
def clean_datetime(spark, sf):
    key, d = F.pmod("o_orderkey", F.lit(8)), F.col("o_orderdate")
    text = (F.when(key == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
            .when(key == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'+08:00'"))
            .when(key == 2, F.date_format(d, "yyyy年M月d日"))
            .when(key == 3, F.date_format(d, "MMM d, yyyy"))
            .when(key == 4, F.date_format(d, "yyyy/M/d"))
            .when(key == 5, F.date_format(d, "MMMM yyyy"))
            .when(key == 6, F.date_format(d, " dd.MM.yyyy "))
            .otherwise("on request"))
    df = table(spark, sf, "orders").select("o_orderkey", text.alias("at"), text.alias("day"))
    rule = {"to_datetime": True, "date_format": "%d.%m.%Y"}
    return Cleaner().clean(df, [{"name": "at", **rule}, {"name": "day", **rule, "date_output_format": "%Y/%m/%d"}],
                           keep=["o_orderkey"])


@query("clean_ts_floor", """
    SELECT event_id, ms - ((ms % 3600000) + 3600000) % 3600000 AS hour, ms - ((ms % 86400000) + 86400000) % 86400000 AS day,
           -ms - ((-ms % 86400000) + 86400000) % 86400000 AS mirrored
    FROM (SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events)""")
def clean_ts_floor(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    df = table(spark, sf, "events").select(
        "event_id", ms.cast("string").alias("hour"), ms.cast("string").alias("day"), (-ms).cast("string").alias("mirrored"))
    return Cleaner().clean(df, [
        {"name": "hour", "type": "INTEGER", "to_number": True, "ts_floor_to_hour": True},
        {"name": "day", "type": "INTEGER", "to_number": True, "ts_floor_to_day": True},
        {"name": "mirrored", "type": "INTEGER", "to_number": True, "ts_floor_to_day": True},
    ], keep=["event_id"])


@query("clean_row", f"""
    SELECT doc_id, regexp_replace(trim(text, '{WHITESPACE}'), '{_WS_CLASS}', ' ', 'g') AS text, upper(lang) AS lang,
           source, n_chars AS n_chars
    FROM (SELECT doc_id, text, lang, source, n_chars FROM documents)""")
def clean_row(spark, sf):
    df = table(spark, sf, "documents").select(
        "doc_id", "text", F.upper("lang").alias("lang"), F.concat(F.col("source"), F.lit("\t")).alias("source"),
        F.format_number("n_chars", 0).alias("n_chars"))
    return Cleaner().clean(df, [{"name": "text", "trim_whitespace": True}, {"name": "lang"}, {"name": "source"},
                                {"name": "n_chars", "type": "INTEGER", "to_number": True}], keep=["doc_id"])


# ------------------------------------------------------------------ predicates

_LINE = "l_orderkey, l_linenumber, l_partkey, l_quantity"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.pmod("l_partkey", F.lit(7)) != 0, F.col("l_quantity")).alias("l_quantity"))


_LINES_SQL = ("(SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS l_quantity "
              "FROM lineitem)")


def _register_comparison(name, op, sql_op, value):
    @query(name, f"SELECT {_LINE} FROM {_LINES_SQL} WHERE {sql_op}")
    def run(spark, sf):
        return Predicates().keep(_lines(spark, sf), [{"name": "l_quantity", "where": {"op": op, "value": value}}])


_register_comparison("where_gt", ">", "l_quantity > 25", 25)
_register_comparison("where_lt", "<", "l_quantity < 25", 25)
_register_comparison("where_gte", ">=", "l_quantity >= 25", 25)
_register_comparison("where_lte", "<=", "l_quantity <= 25", 25)
_register_comparison("where_eq", "==", "l_quantity = 25", 25)
_register_comparison("where_ne", "!=", "l_quantity IS DISTINCT FROM 25", 25)
_register_comparison("where_in", "in", "l_quantity IN (1, 2, 3, 49)", [1, 2, 3, 49])
_register_comparison("where_not_in", "not_in", "(l_quantity NOT IN (1, 2, 3, 49) OR l_quantity IS NULL)", [1, 2, 3, 49])


@query("where_contains", "SELECT doc_id, lang FROM documents WHERE contains(text, 'tion')")
def where_contains(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return Predicates().keep(df, [{"name": "text", "where": {"op": "contains", "value": "tion"}}]).drop("text")


@query("where_all", f"""
    SELECT {_LINE} FROM {_LINES_SQL} WHERE l_quantity >= 10 AND l_linenumber IN (1, 2) AND l_partkey <> 15""")
def where_all(spark, sf):
    return Predicates().keep(_lines(spark, sf), [
        {"name": "l_quantity", "where": {"op": ">=", "value": 10}},
        {"name": "l_linenumber", "where": {"op": "in", "value": [1, 2]}},
        {"name": "l_partkey", "where": {"op": "!=", "value": 15}},
        {"name": "l_orderkey", "where": {"op": "no such operator", "value": 1}},
    ])


# ------------------------------------------------------------------ extensions

@query("ext_rule", "SELECT c_custkey, upper(c_mktsegment) || '!' AS segment FROM customer")
def ext_rule(spark, sf):
    cleaner = Cleaner()
    cleaner.register_rule("shout", 0, lambda c, cfg: F.concat(F.upper(c), F.lit(cfg["shout"])))
    df = table(spark, sf, "customer").select("c_custkey", F.concat(F.col("c_mktsegment"), F.lit("  ")).alias("segment"))
    return cleaner.clean(df, [{"name": "segment", "shout": "!"}], keep=["c_custkey"])


@query("ext_op", f"SELECT {_LINE} FROM {_LINES_SQL} WHERE l_quantity BETWEEN 10 AND 12")
def ext_op(spark, sf):
    predicates = Predicates()
    predicates.register_op("between", lambda c, v: F.coalesce(c.between(*v), F.lit(False)))
    return predicates.keep(_lines(spark, sf), [{"name": "l_quantity", "where": {"op": "between", "value": [10, 12]}}])


@query("ext_date_fmt", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def ext_date_fmt(spark, sf):
    cleaner = Cleaner()
    cleaner.register_date_format("%dd%mm%Yy")
    df = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "d'd'M'm'yyyy'y'").alias("day"))
    return cleaner.clean(df, [{"name": "day", "to_datetime": True, "date_output_format": "%Y-%m-%d"}], keep=["o_orderkey"])


def typed_k(props):
    """``props`` JSON member ``k`` as a number, by the cleaning chain."""
    return clean_column(F.get_json_object(props, "$.k"), {"name": "k", "to_number": True}, "bigint")
