"""Stored tables: one layout for ever, and only touched partitions are replaced."""

import pytest
from pyspark.sql import functions as F

from ingestkit.operators.unique import UniqueError
from ingestkit.sources import tables as T
from ingestkit.spec import TableSpec

RUN = "2026-08-03 14:30:00"


def spec_of(*unique, columns=("day TEXT", "k INTEGER", "v REAL")):
    return TableSpec.from_dict("t", {"columns": [dict(zip(("name", "type"), c.split(" ", 1))) for c in columns],
                                     "indexes": [{"columns": list(k), "unique": True} for k in unique]})


def stored(spark, path, spec):
    return sorted(map(str, (tuple(r) for r in T.read_partitions(spark, path, spec).collect())))


def files(path):
    return {f"{f.parent.name}/{f.name}" for f in path.glob("_part=*/*.parquet")}


def days(spark, rows):
    return spark.createDataFrame(rows, "day string, k long, v double")


@pytest.fixture
def table(spark, tmp_path):
    spec = spec_of(("day", "k"))
    path = str(tmp_path / "t")
    T.upsert_partitions(spark, path, spec, days(spark, [(d, k, float(k)) for d in "abc" for k in range(3)] + [(None, 1, 9.0)]), RUN, ["day"], "v")
    return path, spec


def test_another_number_of_buckets_is_refused(spark, tmp_path):
    spec, path = spec_of(("k",)), str(tmp_path / "b")
    rows = days(spark, [("x", k, 0.0) for k in range(40)])
    T.upsert_partitions(spark, path, spec, rows, RUN, order_by="v", buckets=4)
    more = days(spark, [("x", 3, 1.0), ("x", 4, 1.0)])
    for other in (8, 16):
        with pytest.raises(T.TableError, match="4 buckets"):
            T.upsert_partitions(spark, path, spec, more, RUN, order_by="v", buckets=other)
    with pytest.raises(T.TableError, match="4 buckets"):
        T.upsert_partitions(spark, path, spec_of(("day", "k")), more, RUN, ["day"], "v")
    assert T.upsert_table(spark, path, spec, more, RUN, "v") == {"inserted": 0, "updated": 2, "total": 2}  # keeps to the table's own
    assert T.upsert_partitions(spark, path, spec, more, RUN, order_by="v", buckets=4)["inserted"] == 0
    assert T.read_table(spark, path).count() == 40
    with pytest.raises(T.TableError, match="other columns or unique keys"):
        T.upsert_table(spark, path, spec_of(("k",), ("day",)), more, RUN, "v")


def test_update_rewrites_its_partition_only(spark, tmp_path, table):
    path, spec = table
    before = files(tmp_path / "t")
    assert T.update_table(spark, path, "day", "b", {"v": 7}) == 3
    changed = before ^ files(tmp_path / "t")
    assert changed and all(f.startswith("_part=%3Db/") for f in changed)
    assert T.update_table(spark, path, "day", "nowhere", {"v": 7}) == 0 and T.update_table(spark, path, "k", "x", {"v": 7}) == 0
    assert stored(spark, path, spec) == sorted(map(str, [(d, k, 7.0 if d == "b" else float(k)) for d in "abc" for k in range(3)] + [(None, 1, 9.0)]))


def test_delete_empties_and_truncate(spark, tmp_path, table):
    path, spec = table
    before = files(tmp_path / "t")
    assert T.delete_from_table(spark, path, "day", "a") == 3
    assert not (tmp_path / "t" / "_part=%3Da").exists()
    assert files(tmp_path / "t") == {f for f in before if not f.startswith("_part=%3Da/")}
    assert T.delete_from_table(spark, path, "k", 1) == 3  # in every partition, NULL's own goes
    assert stored(spark, path, spec) == sorted(map(str, [(d, k, float(k)) for d in "bc" for k in (0, 2)]))
    assert T.truncate_table(spark, path) == 4 and T.read_table(spark, path).count() == 0
    assert T.upsert_table(spark, path, spec, days(spark, [("z", 1, 1.0)]), RUN, "v")["inserted"] == 1


def test_a_changed_key_moves_its_rows_and_stays_unique(spark, table):
    path, spec = table
    assert T.delete_from_table(spark, path, "k", 0) == 3
    with pytest.raises(UniqueError):
        T.update_table(spark, path, "day", "a", {"day": "b"})
    assert T.delete_from_table(spark, path, "v", 1) == 3 and T.delete_from_table(spark, path, "day", "b") == 1
    assert T.update_table(spark, path, "day", "a", {"day": "c", "k": 5}) == 1
    assert stored(spark, path, spec) == sorted(map(str, [("c", 2, 2.0), ("c", 5, 2.0), (None, 1, 9.0)]))


def test_failed_writes_leave_nothing_behind(spark, tmp_path, table):
    path, spec = table
    before = files(tmp_path / "t")
    bad = days(spark, [("a", 1, 1.0)]).withColumn("v", F.when(F.col("k") == 1, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        T.upsert_table(spark, path, spec, bad, RUN, "k")
    assert files(tmp_path / "t") == before and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_rows_without_a_key_are_added(spark, tmp_path):
    spec, path = spec_of(), str(tmp_path / "n")
    for _ in range(2):
        assert T.upsert_table(spark, path, spec, days(spark, [("a", 1, 1.0), ("a", 1, 1.0)]), RUN) == {"inserted": 2, "updated": 0, "total": 2}
    assert T.read_table(spark, path).count() == 4 and T.delete_from_table(spark, path, "k", 1) == 4


def test_two_unique_keys_across_partitions(spark, tmp_path):
    spec, path = spec_of(("k",), ("day",)), str(tmp_path / "u")
    T.upsert_partitions(spark, path, spec, days(spark, [(f"d{k}", k, 0.0) for k in range(30)]), RUN, order_by="v", buckets=8)
    counts = T.upsert_table(spark, path, spec, days(spark, [("d3", 103, 1.0), ("d4", 4, 2.0), (None, 5, 3.0), ("d5", 105, 4.0), ("d50", 50, 5.0)]), RUN, "v")
    assert counts == {"inserted": 2, "updated": 3, "total": 5}
    want = [(f"d{k}", k, 0.0) for k in range(30) if k not in (3, 4, 5)] + [("d3", 103, 1.0), ("d4", 4, 2.0), (None, 5, 3.0), ("d5", 105, 4.0), ("d50", 50, 5.0)]
    assert stored(spark, path, spec) == sorted(map(str, want))
    with pytest.raises(UniqueError):
        T.upsert_table(spark, path, spec, days(spark, [("d7", 8, 1.0)]), RUN, "v")
    assert stored(spark, path, spec) == sorted(map(str, want))


def test_a_folder_that_is_no_table(spark, tmp_path):
    days(spark, [("a", 1, 1.0)]).write.parquet(str(tmp_path / "x"))
    with pytest.raises(T.TableError, match="layout"):
        T.ensure_table(spark, str(tmp_path / "x"), spec_of(("k",)))
    with pytest.raises(FileNotFoundError):
        T.read_table(spark, str(tmp_path / "none"))


def test_too_many_partitions_are_refused(spark, table, monkeypatch):
    path, spec = table
    monkeypatch.setattr(T, "MOST_TOUCHED", 2)
    with pytest.raises(T.TableError, match="buckets"):
        T.upsert_table(spark, path, spec, days(spark, [(d, 1, 0.0) for d in "xyz"]), RUN, "v")
