import random

import pytest
from pyspark.sql import functions as F

from ingestkit.operators.mutations import delete_where, truncate, update_where
from ingestkit.operators.seen import content_change, content_hash, row_json
from ingestkit.operators.ttl import ttl_dedup
from ingestkit.operators.upsert import assert_not_null, upsert
from tests.conftest import plan_of


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def upsert_by_hand(target, batch):
    """(k, v, w) table, (k, v, o) batch in order: what a row-by-row upsert on k does."""
    table, inserted = [list(r) for r in target], 0
    for k, v, _ in sorted(batch, key=lambda r: r[2]):
        hit = next((r for r in table if k is not None and r[0] == k), None)
        if hit:
            hit[1] = v
        else:
            table.append([k, v, None])
            inserted += 1
    return sorted(map(tuple, table), key=repr), inserted


@pytest.mark.parametrize("seed", range(4))
def test_upsert_against_row_by_row(spark, seed):
    rnd = random.Random(seed)
    keys = list(range(8)) + [None]
    target = [(k, rnd.choice("abc"), rnd.randrange(5)) for k in rnd.sample(range(8), 4)] + [(None, "n", 1), (None, "n", 1)]
    batch = [(rnd.choice(keys), rnd.choice(["x", "y", None]), i) for i in range(rnd.randrange(1, 14))]
    t = spark.createDataFrame(target, "k int, v string, w int")
    b = spark.createDataFrame(batch, "k int, v string, o int")
    once = upsert(t, b, ["k"], "o")
    want, inserted = upsert_by_hand(target, batch)
    assert rows(once.table) == want
    assert tuple(once.metrics.first()) == (inserted, len(batch) - inserted, len(batch))
    # a second time only the rows without a key are new
    keyed = b.where("k IS NOT NULL")
    again = upsert(once.table, keyed, ["k"], "o")
    assert rows(again.table) == want
    assert again.metrics.first().inserted == 0


def test_equal_rows_without_key_all_stay(spark):
    t = spark.createDataFrame([], "a int, b int, v string")
    b = spark.createDataFrame([(1, None, "x", 0)] * 3 + [(None, None, "x", 0), (1, 2, "k", 0)], "a int, b int, v string, o int")
    out = upsert(t, b, ["a", "b"], "o")
    assert rows(out.table) == rows(b.drop("o"))
    assert tuple(out.metrics.first()) == (5, 0, 5)


def test_upsert_without_unique_key_appends(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    out = upsert(t, t, [], None)
    assert out.table.count() == 2 and tuple(out.metrics.first()) == (1, 0, 1)


def test_upsert_refuses_bad_columns(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError):
        upsert(t, spark.createDataFrame([(1, 2)], "k int, zzz int"), ["k"])
    with pytest.raises(ValueError):
        upsert(t, spark.createDataFrame([("a",)], "v string"), ["k"])


def test_upsert_forces_no_broadcast_and_reads_the_batch_once(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    batch = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS o_orderkey", "l_extendedprice AS o_totalprice")
    plan = plan_of(upsert(o, batch, ["o_orderkey"], "o_totalprice").table)
    assert plan.count("FileScan") == 2 and "Broadcast" not in plan


def test_a_null_order_is_the_lowest(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b", None), (2, "late", 5), (2, "b", None)], "k int, v string, o int")
    assert rows(upsert(t, b, ["k"], "o").table) == [(1, "b"), (2, "late")]


def test_keyed_upsert_needs_an_order(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError, match="order_by"):
        upsert(t, t, ["k"])


def test_many_equal_rows_without_key(spark):
    t = spark.createDataFrame([], "k int, v string")
    b = spark.range(1_000_000).selectExpr("CAST(NULL AS INT) AS k", "'x' AS v", "1 AS o")
    assert upsert(t, b, ["k"], "o").table.count() == 1_000_000


def test_not_null_stops_the_batch(spark):
    df = spark.createDataFrame([(1,), (None,)], "k int")
    with pytest.raises(Exception, match="NOT NULL constraint failed: k"):
        assert_not_null(df, ["k"]).collect()
    assert assert_not_null(df, []).count() == 2


def test_mutations(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert rows(update_where(df, "k", "2", {"v": 7})) == [(1, "a"), (2, "7"), (None, "c")]
    left, deleted = delete_where(df, "k", 1)
    assert rows(left) == [(2, "b"), (None, "c")] and deleted.first()[0] == 1
    left, deleted = delete_where(df, "k", "no number")
    assert left.count() == 3 and deleted.first()[0] == 0
    left, deleted = truncate(df)
    assert left.count() == 0 and deleted.first()[0] == 3
    with pytest.raises(ValueError):
        update_where(df, "k", 1, {})
    with pytest.raises(ValueError):
        update_where(df, "k", 1, {"nope": 1})


def greedy(data, ttl):
    free, kept = {}, []
    for key, sec, i in sorted(data, key=lambda r: (r[1], r[2])):
        if sec >= free.get(key, -10**9):
            kept.append(i)
            free[key] = sec + ttl
    return sorted(kept)


@pytest.mark.parametrize("seed", range(6))
def test_ttl_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    reach = rnd.choice([60, 400, 3000])
    data = [(rnd.choice(["hot", "hot", "a", None]), rnd.randrange(-reach, reach), i) for i in range(400)]
    ttl, windows = rnd.choice([1, 7, 30, 90]), rnd.choice([1, 2, 3, 50])
    df = spark.createDataFrame(data, "k string, s long, i long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(r.i for r in ttl_dedup(df, "k", "ts", ttl, "i", windows).select("i").collect())
    assert got == greedy(data, ttl)


def test_ttl_regular_grid_and_rows_without_time(spark):
    data = [("k", s, s) for s in range(0, 500, 5)] + [("k", 3, 1000), ("k", 3, 1001)]
    df = spark.createDataFrame(data, "k string, s long, i long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(r.i for r in ttl_dedup(df, "k", "ts", 17, "i", 4).collect())
    assert got == greedy(data, 17)
    none = spark.createDataFrame([("k", None, 1), ("k", None, 2)], "k string, ts timestamp, i long")
    assert ttl_dedup(none, "k", "ts", 10, "i").count() == 2


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_content_change_spans(spark, span):
    rnd = random.Random(span)
    data = [(rnd.choice("ab"), i, rnd.choice("xy")) for i in range(60)]
    last, want = {}, []
    for k, i, h in data:
        want.append((i, "new" if k not in last else "unchanged" if last[k] == h else "changed"))
        last[k] = h
    df = spark.createDataFrame(data, "k string, i long, h string")
    got = [(r.i, r.status) for r in content_change(df, "k", "i", "h", span).orderBy("i").collect()]
    assert got == want


def test_row_json_is_sorted_json(spark):
    import json

    row = {"b": 'x"\\\n é', "a": 3, "c": None, "d": 1.5}
    df = spark.createDataFrame([(row["b"], 3, None, 1.5)], "b string, a int, c string, d double")
    assert df.select(row_json(df)).first()[0] == json.dumps(row, sort_keys=True, ensure_ascii=False)
    assert len(df.select(content_hash(df)).first()[0]) == 64




def test_late_rows_on_a_stream(spark, tmp_path):
    from ingestkit.streaming.landing import read_landed
    from ingestkit.streaming.ttl import stream_ttl_dedup

    schema = "k string, ts timestamp_ntz, id int"
    for batch in ([(0, 1), (1000, 2)], [(100, 3), (700, 4)], [(1299, 5), (1300, 6)]):
        rows_ = spark.createDataFrame([("a", s, i) for s, i in batch], "k string, s int, id int")
        (rows_.selectExpr("k", "CAST(timestamp_seconds(s) AS timestamp_ntz) AS ts", "id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in"))
        stream_ttl_dedup(read_landed(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), "k", "ts", 300, "id", f"{tmp_path}/kept", f"{tmp_path}/cp")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == [1, 2, 4, 6]


def test_ttl_keeps_a_row_without_tie(spark):
    rows_ = [("k", 0, None), ("k", 0, 5), ("k", 3, 6), ("k", 20, None), (None, 1, None)]
    df = spark.createDataFrame(rows_, "k string, s long, i long").withColumn("ts", F.timestamp_seconds("s"))
    got = [(r.k, r.s, r.i) for r in ttl_dedup(df, "k", "ts", 10, "i").collect()]
    assert sorted(got, key=str) == sorted([("k", 0, None), ("k", 20, None), (None, 1, None)], key=str)


@pytest.mark.parametrize("span", [2, 1000])
def test_content_change_loses_no_row(spark, span):
    """NULL keys are one key, rows without an order come first, ties are ordered, NULL hashes count as none."""
    data = [("a", None, "x", 1), ("a", None, "x", 2), ("a", 1, "x", 3), ("a", 5, "y", 4), ("a", 5, "z", 5), ("a", 9, "z", 6), (None, 1, "q", 7), (None, 4, "q", 8),
            ("b", 1, None, 9), ("b", 2, "x", 10), ("k", 1, "x", 11), ("", 1, "x", 12)]
    df = spark.createDataFrame(data, "k string, o long, h string, i long")
    got = {r.i: r.status for r in content_change(df, "k", "o", "h", span, tie="i").collect()}
    assert got == {1: "new", 2: "unchanged", 3: "unchanged", 4: "changed", 5: "changed", 6: "unchanged", 7: "new", 8: "unchanged", 9: "new", 10: "new", 11: "new", 12: "new"}
    assert content_change(df, "k", "o", "h", span).count() == len(data)
