"""Keyed tables: upsert, updates, dedup, change detection and their incremental forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ingestkit.catalog.base import RUN_TS, query, table
from ingestkit.catalog.cleaning import typed_k
from ingestkit.functions.cleaning import HOUR_MS, floor_to
from ingestkit.operators.mutations import delete_where, truncate, update_where
from ingestkit.operators.seen import (change_against, change_against_saved, content_change, content_hash, merge_saved, merge_seen, save_seen,
                                      seen_log, url_hash)
from ingestkit.operators.ttl import ttl_dedup
from ingestkit.operators.unique import upsert_unique
from ingestkit.operators.upsert import not_null_violations, run_totals, upsert
from ingestkit.session import shared_dir
from ingestkit.sources.tables import delete_from_table, read_partitions, read_table, update_table, upsert_partitions, upsert_table
from ingestkit.spec import TableSpec
from ingestkit.streaming.landing import bucket_latest, read_landed, stream_bucket_latest, stream_upsert
from ingestkit.streaming.ttl import stream_ttl_dedup, stream_ttl_state

# --------------------------------------------------------------------- upsert


@query("sink_defaults", """
    SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-01 00:00:00' ELSE '2024-01-31 00:00:00' END AS crawled_at,
           CASE WHEN c_custkey % 2 = 0 THEN '2024-01-01' ELSE '2024-01-31' END AS crawled_day,
           CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 0 END::BIGINT AS hits FROM customer""")
def sink_defaults(spark, sf):
    spec = TableSpec.from_dict("customers", {
        "columns": [
            {"name": "id", "type": "INTEGER", "constraint": "PRIMARY KEY AUTOINCREMENT"},
            {"name": "c_custkey", "type": "INTEGER NOT NULL"}, {"name": "c_name", "type": "TEXT"},
            {"name": "crawled_at", "type": "TEXT NOT NULL DEFAULT (datetime('now', 'localtime'))"},
            {"name": "crawled_day", "type": "TEXT", "constraint": "DEFAULT (strftime('%Y-%m-%d', 'now', 'localtime'))"},
            {"name": "hits", "type": "INTEGER", "constraint": "NOT NULL DEFAULT 0"}],
        "indexes": [{"name": "uk", "columns": ["c_custkey"], "unique": True}]})
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    old = customers.where(F.pmod("c_custkey", F.lit(2)) == 0).select(
        "c_custkey", F.lit("old").alias("c_name"), F.lit("2024-01-01 00:00:00").alias("crawled_at"),
        F.lit("2024-01-01").alias("crawled_day"), F.lit(5).cast("bigint").alias("hits"))
    return upsert(old, customers, spec.keys, "c_name", spec.defaults(RUN_TS, customers.columns)).table


@query("sink_not_null", """
    SELECT 'c_name' AS column_name, count(*) FILTER (c_custkey % 7 = 0) AS nulls FROM customer
    UNION ALL SELECT 'c_nationkey', count(*) FILTER (c_nationkey IS NULL) FROM customer""")
def sink_not_null(spark, sf):
    df = table(spark, sf, "customer").withColumn("c_name", F.when(F.pmod("c_custkey", F.lit(7)) != 0, F.col("c_name")))
    return not_null_violations(df, ["c_name", "c_nationkey"])


def order_table(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def order_delta(spark, sf):
    """Even keys with a new price, new keys, second rows for some keys, rows without a key."""
    o = order_table(spark, sf)
    key, price = F.col("o_orderkey"), F.col("o_totalprice")

    def part(n, new_key, new_price, seq):
        return o.where(F.pmod(key, F.lit(n)) == 0).select(
            new_key.cast("bigint").alias("o_orderkey"), "o_custkey", new_price.alias("o_totalprice"), F.lit(seq).alias("seq"))

    return (part(2, key, price + 1, 1)
            .unionByName(part(10, key + 10_000_000_000, price, 1))
            .unionByName(part(20, key, price + 2, 2))
            .unionByName(part(20, key + 10_000_000_000, price + 3, 2))
            .unionByName(part(50, F.lit(None), price, 1)))


_DELTA_SQL = """
    delta AS (
      SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, 1 AS seq FROM orders WHERE o_orderkey % 2 = 0
      UNION ALL SELECT o_orderkey + 10000000000, o_custkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 10 = 0
      UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 2, 2 FROM orders WHERE o_orderkey % 20 = 0
      UNION ALL SELECT o_orderkey + 10000000000, o_custkey, o_totalprice + 3, 2 FROM orders WHERE o_orderkey % 20 = 0
      UNION ALL SELECT NULL, o_custkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 50 = 0),
    newest AS (SELECT * FROM delta WHERE o_orderkey IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1)"""
_UPSERT_SQL = f"""
    WITH {_DELTA_SQL}
    SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey,
           coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, o.o_orderstatus
    FROM orders o FULL OUTER JOIN newest n ON o.o_orderkey = n.o_orderkey
    UNION ALL SELECT NULL, o_custkey, o_totalprice, NULL FROM delta WHERE o_orderkey IS NULL"""
_COUNT_SQL = f"""
    WITH {_DELTA_SQL}, c AS (
      SELECT (SELECT count(*) FROM newest WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders))
             + (SELECT count(*) FROM delta WHERE o_orderkey IS NULL) AS inserted, (SELECT count(*) FROM delta) AS total)"""


@query("upsert", _UPSERT_SQL)
def upsert_orders(spark, sf):
    return upsert(order_table(spark, sf), order_delta(spark, sf), ["o_orderkey"], "seq").table


@query("upsert_small_batch", _UPSERT_SQL)
def upsert_small(spark, sf):
    """Into a written table, in buckets of the key: only those the batch falls into are read and replaced."""
    path = f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}"
    spec = TableSpec.from_dict("orders", {
        "columns": [{"name": "o_orderkey", "type": "INTEGER"}, {"name": "o_custkey", "type": "INTEGER"},
                    {"name": "o_totalprice", "type": "REAL"}, {"name": "o_orderstatus", "type": "TEXT"}],
        "indexes": [{"name": "uk", "columns": ["o_orderkey"], "unique": True}]})
    upsert_partitions(spark, path, spec, order_table(spark, sf), RUN_TS, order_by="o_custkey", buckets=16)
    upsert_partitions(spark, path, spec, order_delta(spark, sf), RUN_TS, order_by="seq", buckets=16)
    return read_partitions(spark, path, spec)


@query("upsert_counts", f"{_COUNT_SQL} SELECT inserted, total - inserted AS updated, total FROM c")
def upsert_count_query(spark, sf):
    return upsert(order_table(spark, sf), order_delta(spark, sf), ["o_orderkey"], "seq").metrics


@query("run_totals", f"""
    {_COUNT_SQL} SELECT inserted + (SELECT count(*) FROM customer) AS new, total - inserted AS updated, 0::BIGINT AS skipped,
      total + (SELECT count(*) FROM customer) AS total FROM c""")
def run_total_query(spark, sf):
    first = upsert(order_table(spark, sf), order_delta(spark, sf), ["o_orderkey"], "seq").metrics
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    second = upsert(customers.where(F.lit(False)), customers, ["c_custkey"], "c_name").metrics
    return run_totals(first.unionByName(second))


def _customers_twice_keyed(spark, sf):
    return TableSpec.from_dict("customers", {
        "columns": [{"name": "c_custkey", "type": "INTEGER UNIQUE"}, {"name": "c_name", "type": "TEXT"}, {"name": "c_acctbal", "type": "REAL"},
                    {"name": "c_mktsegment", "type": "TEXT"}],
        "indexes": [{"name": "n", "columns": ["c_name"], "unique": True}]})


def two_key_delta(spark, sf):
    """Rows that meet the table by either key, rename it, take what was freed, follow one another, or meet nothing."""
    c = table(spark, sf, "customer")
    key, name, bal = F.col("c_custkey").cast("bigint"), F.col("c_name"), F.col("c_acctbal").cast("double")

    def part(rest, new_key, new_name, more, seq):
        return c.where(F.pmod("c_custkey", F.lit(10)) == rest).select(
            new_key.cast("bigint").alias("c_custkey"), new_name.cast("string").alias("c_name"), (bal + more).alias("c_acctbal"), F.lit(seq).cast("bigint").alias("seq"))

    none, named = F.lit(None), lambda text: F.concat(F.lit(text), name)
    parts = [part(0, key, name, 1, 1), part(1, key, named("new "), 2, 1), part(1, key + 1_000_000_000, name, 3, 2), part(2, key + 2_000_000_000, name, 4, 1),
             part(3, none, name, 5, 1), part(3, key, named("third "), 6, 2), part(4, key, named("x "), 0, 1), part(4, key + 3_000_000_000, named("x "), 7, 2),
             part(5, key, none, 8, 1), part(7, none, none, 0, 1), part(8, key + 4_000_000_000, named("n8 "), 0, 1), part(8, key + 4_000_000_000, named("n8 "), 9, 2)]
    hot = c.where(F.pmod("c_custkey", F.lit(10)) == 9).select(F.lit(-1).cast("bigint").alias("c_custkey"), F.lit("hot").alias("c_name"), bal.alias("c_acctbal"), key.alias("seq"))
    out = parts[0]
    for more in [*parts[1:], hot]:
        out = out.unionByName(more)
    return out


_TWO_KEYS_SQL = """
    WITH c AS (SELECT c_custkey::BIGINT AS k, c_name AS n, c_acctbal::DOUBLE AS b, c_mktsegment AS s, c_custkey % 10 AS r FROM customer)
    SELECT CASE r WHEN 2 THEN k + 2000000000 WHEN 3 THEN NULL WHEN 4 THEN k + 3000000000 ELSE k END AS c_custkey,
           CASE r WHEN 1 THEN 'new ' || n WHEN 4 THEN 'x ' || n WHEN 5 THEN NULL ELSE n END AS c_name,
           b + CASE r WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 7 WHEN 5 THEN 8 ELSE 0 END AS c_acctbal, s AS c_mktsegment FROM c
    UNION ALL SELECT k + 1000000000, n, b + 3, NULL FROM c WHERE r = 1
    UNION ALL SELECT k, 'third ' || n, b + 6, NULL FROM c WHERE r = 3
    UNION ALL SELECT NULL, NULL, b, NULL FROM c WHERE r = 7
    UNION ALL SELECT k + 4000000000, 'n8 ' || n, b + 9, NULL FROM c WHERE r = 8
    UNION ALL SELECT -1, 'hot', arg_max(b, k), NULL FROM c WHERE r = 9 HAVING count(*) > 0"""


@query("upsert_two_keys", _TWO_KEYS_SQL)
def upsert_two_keys(spark, sf):
    """Either key names the row that is replaced; what the batch frees and writes counts for its later rows."""
    spec = _customers_twice_keyed(spark, sf)
    old = table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")
    return upsert_unique(old, two_key_delta(spark, sf), spec.unique, "seq").table


@query("upsert_two_keys_stored", _TWO_KEYS_SQL)
def upsert_two_keys_stored(spark, sf):
    """The same into a written table: rows that get another key move to its partition."""
    spec = _customers_twice_keyed(spark, sf)
    path = f"{shared_dir(spark)}/customers-{uuid.uuid4().hex}"
    old = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    upsert_partitions(spark, path, spec, old, RUN_TS, order_by="c_name", buckets=8)
    upsert_partitions(spark, path, spec, two_key_delta(spark, sf), RUN_TS, order_by="seq")
    return read_partitions(spark, path, spec)


@query("upsert_partitions", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, CASE WHEN day(ts) <= 5 THEN value + 1 ELSE value END AS value FROM events""")
def upsert_partition_query(spark, sf):
    """A written table partitioned by day: the second upsert touches five days only."""
    spec = TableSpec.from_dict("events", {
        "columns": [{"name": "day", "type": "TEXT NOT NULL"}, {"name": "event_id", "type": "INTEGER"}, {"name": "value", "type": "REAL"}],
        "indexes": [{"name": "uk", "columns": ["day", "event_id"], "unique": True}]})
    path = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    rows = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "value", "ts")
    upsert_partitions(spark, path, spec, rows.drop("ts"), RUN_TS, ["day"], "event_id")
    again = rows.where(F.dayofmonth("ts") <= 5).withColumn("value", F.col("value") + 1).drop("ts")
    upsert_partitions(spark, path, spec, again, RUN_TS, ["day"], "event_id")
    return read_partitions(spark, path, spec)


@query("upsert_null_partition", """
    SELECT CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END AS kind, event_id, CASE WHEN event_id % 2 = 0 THEN value + 1 ELSE value END AS value
    FROM events WHERE event_id % 3 <> 0
    UNION ALL SELECT NULL, event_id, value FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT NULL, event_id, value + 1 FROM events WHERE event_id % 6 = 0""")
def upsert_null_partition(spark, sf):
    """NULL and empty partition values stay apart and survive a second batch; rows without a key are all kept."""
    spec = TableSpec.from_dict("kinds", {
        "columns": [{"name": "kind", "type": "TEXT"}, {"name": "event_id", "type": "INTEGER"}, {"name": "value", "type": "REAL"}],
        "indexes": [{"name": "uk", "columns": ["kind", "event_id"], "unique": True}]})
    path = f"{shared_dir(spark)}/kinds-{uuid.uuid4().hex}"
    third = F.pmod("event_id", F.lit(3))
    rows = table(spark, sf, "events").select(F.when(third == 1, "").when(third == 2, F.col("event_type")).alias("kind"), "event_id", "value")
    upsert_partitions(spark, path, spec, rows, RUN_TS, ["kind"], "event_id")
    again = rows.where(F.pmod("event_id", F.lit(2)) == 0).withColumn("value", F.col("value") + 1)
    upsert_partitions(spark, path, spec, again, RUN_TS, ["kind"], "event_id")
    return read_partitions(spark, path, spec)


# ------------------------------------------------------------------- mutations

@query("update_rows", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'renamed' ELSE c_name END AS c_name,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer""")
def update_rows(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return update_where(df, "c_mktsegment", "BUILDING", {"c_name": "renamed", "c_acctbal": 0})


@query("delete_rows", "SELECT * FROM customer WHERE c_nationkey <> 7 OR c_nationkey IS NULL")
def delete_rows(spark, sf):
    return delete_where(table(spark, sf, "customer"), "c_nationkey", "7")[0]


@query("delete_count", "SELECT count(*) AS deleted FROM customer WHERE c_nationkey = 7")
def delete_count(spark, sf):
    return delete_where(table(spark, sf, "customer"), "c_nationkey", 7)[1]


_STORED_SQL = """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'renamed' ELSE c_name END AS c_name, c_mktsegment
    FROM customer WHERE c_nationkey <> 7 OR c_nationkey IS NULL"""


@query("update_delete_stored", _STORED_SQL)
def update_delete_stored(spark, sf):
    """Update and delete on a written table: each rewrites the partitions that hold such rows."""
    path = f"{shared_dir(spark)}/customers-{uuid.uuid4().hex}"
    spec = TableSpec.from_dict("customers", {
        "columns": [{"name": "c_custkey", "type": "INTEGER"}, {"name": "c_name", "type": "TEXT"}, {"name": "c_mktsegment", "type": "TEXT"},
                    {"name": "c_nationkey", "type": "INTEGER"}],
        "indexes": [{"name": "uk", "columns": ["c_custkey"], "unique": True}]})
    upsert_table(spark, path, spec, table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), RUN_TS, "c_name")
    update_table(spark, path, "c_mktsegment", "BUILDING", {"c_name": "renamed"})
    delete_from_table(spark, path, "c_nationkey", 7)
    return read_table(spark, path).select("c_custkey", "c_name", "c_mktsegment")


@query("update_delete_partitions", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, CASE WHEN event_type = 'click' AND day(ts) = 9 THEN 'nine' ELSE event_type END AS event_type,
           CASE WHEN day(ts) = 3 THEN -1.0 ELSE value END AS value
    FROM events WHERE day(ts) <> 7""")
def update_delete_partitions(spark, sf):
    """A table partitioned by day: one day is changed, one is emptied, one renames a kind; all others keep their files."""
    spec = TableSpec.from_dict("events", {
        "columns": [{"name": "day", "type": "TEXT NOT NULL"}, {"name": "event_id", "type": "INTEGER"}, {"name": "event_type", "type": "TEXT"}, {"name": "value", "type": "REAL"},
                    {"name": "tag", "type": "TEXT"}],
        "indexes": [{"name": "uk", "columns": ["day", "event_id"], "unique": True}]})
    path = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = table(spark, sf, "events").select(day.alias("day"), "event_id", "event_type", "value",
                                             F.when((F.dayofmonth("ts") == 9) & (F.col("event_type") == "click"), "nine").alias("tag"))
    upsert_partitions(spark, path, spec, rows, RUN_TS, ["day"], "event_id")
    for d in [r[0] for r in rows.select("day").distinct().collect()]:  # the days of the table
        if d.endswith("-03"):
            update_table(spark, path, "day", d, {"value": -1.0})
        elif d.endswith("-07"):
            delete_from_table(spark, path, "day", d)
    update_table(spark, path, "tag", "nine", {"event_type": "nine"})
    return read_table(spark, path).drop("tag")


@query("truncate_count", "SELECT count(*) AS deleted FROM lineitem")
def truncate_count(spark, sf):
    return truncate(table(spark, sf, "lineitem"))[1]


# ------------------------------------------------------------ dedup and changes

@query("url_hash", "SELECT page_id, sha256(url) AS url_hash FROM pages")
def url_hash_query(spark, sf):
    return table(spark, sf, "pages").select("page_id", url_hash(F.col("url")).alias("url_hash"))


_TTL_SQL = """
    WITH RECURSIVE kept(user_id, ts) AS (
      SELECT user_id, min(ts) FROM events GROUP BY user_id
      UNION ALL
      SELECT e.user_id, min(e.ts) FROM kept k JOIN events e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 18000 SECOND
      GROUP BY e.user_id)
    SELECT min(e.event_id) AS event_id, e.user_id, e.event_type FROM kept k JOIN events e ON e.user_id = k.user_id AND e.ts = k.ts
    GROUP BY e.user_id, e.ts, e.event_type"""


@query("ttl_dedup", _TTL_SQL)
def ttl_dedup_query(spark, sf):
    return ttl_dedup(table(spark, sf, "events"), "user_id", "ts", 18_000, "event_id").select("event_id", "user_id", "event_type")


def _requests(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("https://h.example/u/"), F.col("user_id")).alias("url"), "ts", "event_id",
        F.sha2("props", 256).alias("content"))


_SEEN = """
    SELECT sha256('https://h.example/u/' || user_id) AS url_hash, 'https://h.example/u/' || user_id AS url,
           strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
           count(*) AS hit_count, sha256(arg_max(props, (ts, event_id))) AS content_hash
    FROM events GROUP BY user_id"""


def _seen_text(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


@query("seen_log", _SEEN)
def seen_log_query(spark, sf):
    return _seen_text(seen_log(_requests(spark, sf), "url", "ts", "content", "event_id"))


@query("seen_log_merged", _SEEN)
def seen_log_merged(spark, sf):
    """Two periods logged apart and merged equal one log of both."""
    r = _requests(spark, sf)
    cut = F.lit("2024-01-12").cast("timestamp_ntz")
    logs = [seen_log(r.where(c), "url", "ts", "content", "event_id") for c in (F.col("ts") < cut, F.col("ts") >= cut)]
    return _seen_text(merge_seen(*logs))


@query("seen_log_bucketed", _SEEN)
def seen_log_bucketed(spark, sf):
    """The log of a first period lies in buckets; that of a second one is folded in without moving it."""
    r = _requests(spark, sf)
    cut = F.lit("2024-01-12").cast("timestamp_ntz")
    names = [f"seen_{uuid.uuid4().hex}" for _ in range(2)]
    save_seen(seen_log(r.where(F.col("ts") < cut), "url", "ts", "content", "event_id"), names[0], 16)
    merge_saved(names[0], seen_log(r.where(F.col("ts") >= cut), "url", "ts", "content", "event_id"), names[1], 16)
    return _seen_text(spark.table(names[1])).select("url_hash", "url", "first_seen", "last_seen", "hit_count", "content_hash")


@query("content_hash", """
    SELECT c_custkey, sha256('{"c_custkey": ' || c_custkey || ', "c_mktsegment": ' || CASE WHEN c_custkey % 7 = 0 THEN 'null'
      ELSE '"' || c_mktsegment || '"' END || ', "c_name": "é\\"' || c_name || '", "c_nationkey": ' || c_nationkey || '}') AS content_hash
    FROM customer""")
def content_hash_query(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_name", "c_custkey", "c_nationkey",
        F.when(F.pmod("c_custkey", F.lit(7)) != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    df = df.withColumn("c_name", F.concat(F.lit('é"'), F.col("c_name")))
    return df.select("c_custkey", content_hash(df).alias("content_hash"))


@query("content_change", """
    SELECT doc_id, copy, CASE WHEN p IS NULL THEN 'new' WHEN p = h THEN 'unchanged' ELSE 'changed' END AS status
    FROM (SELECT doc_id, copy, h, lag(h) OVER (PARTITION BY lang, source ORDER BY 2 * doc_id + copy) AS p
          FROM (SELECT doc_id, lang, source, copy, sha256(text) AS h FROM documents, (VALUES (0), (1)) c(copy)))""")
def content_change_query(spark, sf):
    """Whole texts, each fetched twice in a row."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("/", "lang", "source").alias("url"), F.sha2("text", 256).alias("h"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    placed = docs.withColumn("at", 2 * F.col("doc_id") + F.col("copy"))
    return content_change(placed, "url", "at", "h", span=10_000).select("doc_id", "copy", "status")


@query("content_change_seen", """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'new' WHEN page_id % 3 = 1 THEN 'unchanged' ELSE 'changed' END AS status FROM pages""")
def content_change_seen(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.sha2("html", 256).alias("h"))
    third = F.pmod("page_id", F.lit(3))
    seen = pages.where(third != 0).select(
        url_hash(F.col("url")).alias("url_hash"), F.when(third == 1, F.col("h")).otherwise("old").alias("content_hash"))
    return change_against(pages, seen, "url", "h").select("page_id", "status")


@query("content_change_bucketed", """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'new' WHEN page_id % 3 = 1 THEN 'unchanged' ELSE 'changed' END AS status FROM pages""")
def content_change_bucketed(spark, sf):
    """Against a log in buckets: only the batch is exchanged."""
    pages = table(spark, sf, "pages").select("page_id", "url", F.sha2("html", 256).alias("h"))
    third, name = F.pmod("page_id", F.lit(3)), f"seen_{uuid.uuid4().hex}"
    save_seen(pages.where(third != 0).select(url_hash(F.col("url")).alias("url_hash"), F.when(third == 1, F.col("h")).otherwise("old").alias("content_hash")), name, 16)
    return change_against_saved(pages, name, "url", "h").select("page_id", "status")


# ----------------------------------------------------------------- incremental

@query("bucket_latest", """
    SELECT user_id, (epoch_us(ts) // 1000) // 3600000 * 3600000 AS bucket, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def bucket_latest_query(spark, sf):
    events = table(spark, sf, "events")
    hour = floor_to(F.unix_millis(F.col("ts").cast("timestamp")), HOUR_MS)
    return bucket_latest(events, ["user_id"], hour, "value", F.struct("ts", "event_id"))


@query("stream_upsert", """
    SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS k, '2024-01-31 00:00:00' AS crawled_at FROM events""")
def stream_upsert_query(spark, sf):
    """Event files land, some of them twice; the keyed table ends up equal to the batch result."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", "user_id", "props")
    spec = TableSpec.from_dict("events", {
        "columns": [{"name": "event_id", "type": "INTEGER NOT NULL"}, {"name": "user_id", "type": "INTEGER"}, {"name": "k", "type": "INTEGER"},
                    {"name": "crawled_at", "type": "TEXT NOT NULL DEFAULT (datetime('now', 'localtime'))"}],
        "indexes": [{"name": "uk", "columns": ["event_id"], "unique": True}]})

    def land(rows):
        rows.write.mode("append").parquet(f"{base}/landed")
        stream_upsert(read_landed(spark, f"{base}/landed", events.schema), f"{base}/table", spec, RUN_TS, f"{base}/checkpoint",
                      "event_id", lambda df: df.select("event_id", "user_id", typed_k("props").alias("k")), buckets=8)

    land(events.where(F.pmod("event_id", F.lit(2)) == 0))
    land(events)
    return read_partitions(spark, f"{base}/table", spec)


@query("stream_ttl_dedup", _TTL_SQL)
def stream_ttl_query(spark, sf):
    """Events land in three periods; state between the runs is the last kept row per key."""
    base = f"{shared_dir(spark)}/ttl-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    cuts = [F.lit(d).cast("timestamp_ntz") for d in ("2024-01-11", "2024-01-21")]
    ts = F.col("ts")
    for part in (ts < cuts[0], (ts >= cuts[0]) & (ts < cuts[1]), ts >= cuts[1]):
        events.where(part).write.mode("append").parquet(f"{base}/landed")
        stream_ttl_dedup(read_landed(spark, f"{base}/landed", events.schema), "user_id", "ts", 18_000, "event_id",
                         f"{base}/kept", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/kept").select("event_id", "user_id", "event_type")


@query("stream_ttl_state", _TTL_SQL)
def stream_ttl_state_query(spark, sf):
    """Events land in three periods; keys and the moments they are free again are state between the runs."""
    base = f"{shared_dir(spark)}/ttl-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    cuts = [F.lit(d).cast("timestamp_ntz") for d in ("2024-01-11", "2024-01-21")]
    ts = F.col("ts")
    for part in (ts < cuts[0], (ts >= cuts[0]) & (ts < cuts[1]), ts >= cuts[1]):
        events.where(part).write.mode("append").parquet(f"{base}/landed")
        stream_ttl_state(read_landed(spark, f"{base}/landed", events.schema), "user_id", "ts", 18_000, "event_id", f"{base}/kept", f"{base}/checkpoint")
    return spark.read.schema(events.schema).parquet(f"{base}/kept").select("event_id", "user_id", "event_type")


@query("stream_bucket_latest", """
    WITH landed AS (SELECT *, event_id % 10 = 0 AND ts < '2024-01-05' AS too_late FROM events)
    SELECT * FROM (SELECT user_id, (epoch_us(ts) // 1000) // 3600000 * 3600000 AS bucket, arg_max(value, (ts, event_id)) AS value FROM landed
                   WHERE NOT too_late GROUP BY 1, 2)
    WHERE bucket + 3600000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 86400000""")
def stream_bucket_latest_query(spark, sf):
    """Three landings. A tenth of a day comes one landing late and within the watermark of a day; a tenth of the first days
    comes behind it and is dropped. Windows the watermark has not passed at the end are not written yet."""
    base = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", "user_id", "value", "ts")
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp_ntz")
    ts, tenth = F.col("ts"), F.pmod("event_id", F.lit(10)) == 0
    held = tenth & (((ts >= day("10 01:00:00")) & (ts < day("11"))) | (ts < day("05")))
    for part in ((ts < day("11")) & ~held, held | ((ts >= day("11")) & (ts < day("21"))), ts >= day("21")):
        events.where(part).write.mode("append").parquet(f"{base}/landed")
        stream_bucket_latest(read_landed(spark, f"{base}/landed", events.schema), ["user_id"], "ts", "1 hour", "value", ["ts", "event_id"], "1 day",
                             f"{base}/table", f"{base}/checkpoint")
    return spark.read.schema("user_id bigint, bucket bigint, value double").parquet(f"{base}/table")
