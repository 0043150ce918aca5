"""Upsert with several unique keys, against the statement run row by row by a database in this process."""

import random
import sqlite3

import pytest

from ingestkit.operators.groups import connected
from ingestkit.operators.unique import UniqueError, upsert_unique

COLUMNS = "a long, b string, c long, v long, w string"


def by_statement(stored, batch, supplied, keys=(("a",), ("b",), ("c",))):
    """What the statement leaves, and how much the table grew; None if it fails."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (a, b, c, v, w DEFAULT 'new')")
    for n, key in enumerate(keys):
        con.execute(f"CREATE UNIQUE INDEX i{n} ON t ({', '.join(key)})")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", stored)
    sets = ", ".join(f"{c} = excluded.{c}" for c in supplied)
    try:
        with con:
            for row in batch:
                con.execute(f"INSERT INTO t ({', '.join(supplied)}) VALUES ({', '.join('?' * len(supplied))}) ON CONFLICT DO UPDATE SET {sets}", row)
    except sqlite3.IntegrityError:
        return None
    rows = con.execute("SELECT * FROM t").fetchall()
    return sorted(map(str, rows)), len(rows) - len(stored)


def by_spark(spark, stored, batch, supplied, keys=(("a",), ("b",), ("c",)), **more):
    from pyspark.sql import functions as F

    kinds = dict(x.split() for x in COLUMNS.split(", "))
    target = spark.createDataFrame(stored, COLUMNS).repartition(2)
    rows = spark.createDataFrame([(*r, n) for n, r in enumerate(batch)], ", ".join(f"{c} {kinds[c]}" for c in supplied) + ", seq long").repartition(3)
    result = upsert_unique(target, rows, keys, "seq", {"w": F.lit("new")}, **more)
    counts = result.metrics.first()
    assert counts.total == len(batch) and counts.inserted + counts.updated == counts.total
    return sorted(str(tuple(r)) for r in result.table.collect()), counts.inserted


def agree(spark, stored, batch, supplied=("a", "b", "c", "v"), **more):
    want = by_statement(stored, batch, supplied, **more)
    if want is None:
        with pytest.raises(UniqueError):
            by_spark(spark, stored, batch, supplied, **more)
    else:
        assert by_spark(spark, stored, batch, supplied, **more) == want
    return want is not None


STORED = [(1, "x1", 10, 0, "old"), (2, "x2", 20, 0, "old"), (3, "x3", None, 0, "old"), (None, "x4", 40, 0, None), (None, None, None, 0, "lone"), (None, None, None, 0, "lone")]


@pytest.mark.parametrize("batch, works", [
    ([(1, "x1", 10, 1), (2, "x2", 21, 2), (9, "y9", 90, 3)], True),
    ([(1, "y1", 11, 1), (7, "x1", 70, 2)], True),               # a value that is free again is taken by a new row
    ([(1, "y1", 10, 1), (5, "y1", 50, 2), (5, "y5", 51, 3)], True),   # a chain over what the batch wrote
    ([(1, "x2", 99, 1)], False),                                # two rows met
    ([(8, "z8", 80, 1), (9, "z9", 90, 2), (8, "z9", 88, 3)], False),  # two rows of the batch met
    ([(1, None, None, 1), (4, "x1", 10, 2)], True),             # NULL frees the values
    ([(None, None, None, 1), (None, None, None, 1), (None, "x4", None, 5)], True),
    ([(1, "x1", 10, k) for k in range(50)] + [(1, "q", 10, 99)], True),
    ([], True),
])
def test_cases(spark, batch, works):
    assert agree(spark, STORED, batch) == works


def test_random_batches(spark):
    done = 0
    for seed in range(7):
        rng = random.Random(seed)
        values = list(range(rng.choice([8, 30, 60])))

        def key(share):
            return None if rng.random() < share else rng.choice(values)
        stored = []
        taken = [set(), set(), set()]
        for _ in range(15):
            row = [key(0.2), key(0.2), key(0.3)]
            if all(v is None or v not in t for v, t in zip(row, taken)):
                for v, t in zip(row, taken):
                    t.add(v)
                stored.append((row[0], row[1] if row[1] is None else f"t{row[1]}", row[2], 0, "old"))
        nulls = rng.choice([0.3, 0.8])
        batch = []
        for n in range(rng.choice([4, 10, 25])):
            a, b, c = key(nulls), key(nulls), key(nulls)
            batch.append((a, b if b is None else f"t{b}", c, n))
        done += agree(spark, stored, batch)
    assert 1 <= done <= 6


def test_keys_of_two_columns_and_partly_supplied(spark):
    keys = (("a", "b"), ("c",))
    batch = [(1, "x1", 77, 1), (1, None, 10, 2), (1, None, 20, 3), (4, "x1", 78, 4)]
    assert agree(spark, STORED[:2], batch, keys=keys)
    assert agree(spark, STORED[:3], [(1, 5), (6, 6)], ("a", "v"), keys=(("a",), ("c",)))
    with pytest.raises(ValueError, match="whole key"):
        by_spark(spark, STORED, [(1, 1)], ("a", "v"), keys=keys)
    with pytest.raises(ValueError, match="every unique key"):
        by_spark(spark, STORED, [(1,)], ("v",))
    with pytest.raises(ValueError, match="depend on one another"):
        by_spark(spark, STORED, [(1, "x1", 10, 1), (1, "y", 10, 1)], ("a", "b", "c", "v"), replay_rows=1)


def test_a_hot_key_is_settled_without_replay(spark, monkeypatch):
    """Many rows of one combination never depend on one another."""
    batch = [(1, "x1", 10, k) for k in range(400)] + [(2, "x2", 22, 7)]
    got, grown = by_spark(spark, STORED, batch, ("a", "b", "c", "v"), replay_rows=0)
    assert grown == 0 and (got, grown) == by_statement(STORED, batch, ("a", "b", "c", "v"))


@pytest.mark.parametrize("seed", range(4))
def test_connected(spark, seed):
    rng = random.Random(seed)
    n = 60
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([10, 30, 60]))] + [(k, k + 1) for k in range(100, 140)]
    leader = {k: k for p in pairs for k in p}
    for _ in range(n):
        for x, y in pairs:
            leader[x] = leader[y] = min(leader[x], leader[y])
    linked = {k for x, y in pairs if x != y for k in (x, y)}
    got = {r.node: r.leader for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in leader.items() if k in linked}
    assert connected(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
