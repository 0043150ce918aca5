"""Upsert into a table with several unique keys: any of them may name the row that is replaced.

Batch rows take effect in their order. A row that meets a table row by one of its keys replaces the supplied columns of
that row, the other keys among them; so it may free a key value and take another, and later rows of the batch meet what
earlier ones left. A row that meets two different rows cannot be written under both keys: the whole batch fails.

Only rows that share a key value can influence each other. The batch is reduced to its distinct combinations of keys in
the map tasks; the table gives, per key, the keys of the rows that are met (one exchange of key columns). Combinations and
met rows are linked through the values they share, and the links are grouped. A group of one combination and at most one
row of the table is settled by the last row of that combination, which is what happens to nearly all of them and to a hot
key. The rows of the other groups are replayed in order, group by group, with nothing but their keys and numbers. One
group is replayed by one task, as every step depends on the one before; its rows are counted first, and more than
``REPLAY_ROWS`` are refused, never dropped. What is replaced then meets the table in one join.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestkit.operators.groups import connected
from ingestkit.operators.upsert import Upsert
from ingestkit.session import cut_lineage

# Executors need no copy of this package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REPLAY_ROWS = 5_000_000
_ROW, _ORDER, _NODE = "_row", "_order", "_node"


class UniqueError(ValueError):
    """A batch row meets two rows of the table; nothing is written."""


def _complete(key: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"`{c}`").isNotNull() for c in key])


def _any_key(keys: Sequence[Sequence[str]]) -> Column:
    return reduce(or_, [_complete(k) for k in keys])


def _text(key: Sequence[str]) -> Column:
    """A complete key as text that no other key has; NULL if a part of it is."""
    return F.when(_complete(key), F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in key])))


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, table rows before batch rows in their order → ``origin, last, clash`` of the rows that remain.

    Only the index of the current group is held.
    """
    group, slots, index, clash = None, [], [], None

    def ended() -> list[tuple]:
        if clash is not None:
            return [(None, None, clash)]
        return [(origin, last, None) for origin, last, _ in slots if last is not None]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["origin", "last", "clash"])

    for batch in batches:
        out: list[tuple] = []
        for now, stored, number, *values in zip(*(c.to_pylist() for c in batch.columns)):
            if now != group:
                if group is not None:
                    out += ended()
                group, slots, index, clash = now, [], [{} for _ in values], None
            if clash is not None:
                continue
            own = tuple(values)
            met = {index[i][v] for i, v in enumerate(own) if v is not None and v in index[i]}
            if len(met) > 1:
                clash = number
                continue
            if met:
                at = met.pop()
                for i, v in enumerate(slots[at][2]):
                    if v is not None:
                        del index[i][v]
                slots[at] = (slots[at][0], number, own)
            else:
                at = len(slots)
                slots.append((number, None, own) if stored else (None, number, own))
            for i, v in enumerate(own):
                if v is not None:
                    index[i][v] = at
        yield packed(out)
    if group is not None:
        yield packed(ended())


def upsert_unique(target: DataFrame, batch: DataFrame, unique: Sequence[Sequence[str]], order_by: str | Sequence[str],
                  defaults: Mapping[str, Column] | None = None, replay_rows: int = REPLAY_ROWS) -> Upsert:
    """Merge ``batch`` into ``target``, whose ``unique`` keys are lists of columns.

    ``order_by`` names the batch columns that order it; rows that tie in them stay in the order they are read. A key with a
    NULL in it meets nothing, and a row all of whose keys hold one is inserted. A key none of whose columns is supplied
    takes part in nothing, so its columns must have no default. Counts as in ``upsert``: ``inserted`` is what the table
    grows by, every other batch row counts as updated.
    """
    order_cols = [order_by] if isinstance(order_by, str) else list(order_by)
    defaults = dict(defaults or {})
    supplied = [c for c in batch.columns if c in target.columns]
    extra = [c for c in batch.columns if c not in target.columns and c not in order_cols]
    if extra:
        raise ValueError(f"columns not in the table: {extra}")
    for key in unique:
        held = [c for c in key if c in supplied]
        if held and len(held) < len(key) or not held and any(c in defaults for c in key):
            raise ValueError(f"batch must supply the whole key {list(key)}, or nothing of it and no default")
    keys = [list(k) for k in unique if k[0] in supplied]
    if not keys:
        raise ValueError("batch lacks every unique key")
    named = list(dict.fromkeys(c for k in keys for c in k))
    kinds = {f.name: f.dataType for f in target.schema.fields}
    typed = batch.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in batch.columns])
    # from here on key columns have names of our own
    columns = [f"_c{i}" for i in range(len(named))]
    keys = [[columns[named.index(c)] for c in k] for k in keys]
    own = [F.col(f"`{c}`").alias(mine) for c, mine in zip(named, columns)]
    rows = cut_lineage(typed.select(*own, F.struct(*[F.col(f"`{c}`") for c in supplied]).alias("_new"),
                                    F.struct(*[F.col(f"`{c}`") for c in order_cols], F.monotonically_increasing_id().alias(_ROW)).alias(_ORDER)))
    rows = rows.withColumn(_ROW, F.col(_ORDER).getField(_ROW))  # checkpointed, so numbers stay what they are
    keyed, lone = rows.where(_any_key(keys)), rows.where(~_any_key(keys))

    # combinations of keys in the batch, and the keys of the table rows they meet
    combined = cut_lineage(keyed.groupBy(*columns).agg(F.max_by(_ROW, _ORDER).alias("last"), F.count(F.lit(1)).alias("n"))
                           .withColumn(_NODE, 2 * F.monotonically_increasing_id()))
    stored = target.select(*own)
    met = None
    for key in keys:
        asked = combined.where(_complete(key)).select(*key).distinct()
        some = stored.join(asked, key, "left_semi")
        met = some if met is None else met.unionByName(some)
    met = cut_lineage(met.distinct().withColumn(_NODE, 2 * F.monotonically_increasing_id() + 1))

    # links through shared values, each to the first that has the value
    nodes = combined.select(_NODE, *columns).unionByName(met.select(_NODE, *columns))
    links = None
    for key in keys:
        holding = nodes.where(_complete(key)).select(_NODE, *key)
        first = holding.groupBy(*key).agg(F.min(_NODE).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        some = holding.join(first, key).select(F.col(_NODE).alias("a"), F.col("_first").alias("b"))
        links = some if links is None else links.unionByName(some)
    leaders = cut_lineage(connected(links).select(F.col("node").alias(_NODE), "leader"))
    in_batch = F.pmod(F.col(_NODE), F.lit(2)) == 0
    sizes = leaders.groupBy("leader").agg(F.count_if(in_batch).alias("combinations"), F.count_if(~in_batch).alias("stored"))
    plain = (F.col("combinations") == 1) & (F.col("stored") == 1)

    # a combination that meets nothing, or one row and nothing else: its last row decides
    alone = combined.join(leaders.select(_NODE), _NODE, "left_anti").select(F.lit(None).cast("bigint").alias("origin"), "last")
    pairs = leaders.join(sizes.where(plain).select("leader"), "leader")
    simple = (pairs.join(combined.select(_NODE, "last"), _NODE, "left").groupBy("leader")
              .agg(F.max(F.when(~in_batch, F.col(_NODE))).alias("origin"), F.max("last").alias("last")).select("origin", "last"))

    # the others are replayed
    tangled = leaders.join(sizes.where(~plain).select("leader"), "leader")
    numbered = combined.join(tangled, _NODE).select("leader", "n", *columns)
    largest = numbered.groupBy("leader").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > replay_rows:
        raise ValueError(f"{largest} rows of the batch depend on one another through shared keys; at most {replay_rows} are replayed")
    texts = [_text(k).alias(f"k{i}") for i, k in enumerate(keys)]
    equal = reduce(and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in columns])
    ordered = keyed.alias("r").join(numbered.alias("c"), equal).select("r.*", F.col("leader").alias("group"))
    steps = ordered.select("group", F.lit(False).alias("stored"), F.col(_ROW).alias("number"), _ORDER, *texts).unionByName(
        met.join(tangled, _NODE).select(F.col("leader").alias("group"), F.lit(True).alias("stored"), F.col(_NODE).alias("number"),
                                        F.lit(None).cast(ordered.schema[_ORDER].dataType).alias(_ORDER), *texts))
    # by a hash: an exchange by the bare column may be left out where both inputs are placed by it already, and then a join
    # below that turns into a broadcast at run time takes the placement away
    replayed = (steps.repartition(F.xxhash64("group")).sortWithinPartitions("group", F.desc("stored"), _ORDER).drop(_ORDER)
                .mapInArrow(_replay, "origin bigint, last bigint, clash bigint"))
    nothing = F.lit(None).cast("bigint").alias("clash")
    settled = cut_lineage(alone.unionByName(simple).select("*", nothing).unionByName(replayed))
    clash = settled.agg(F.min("clash")).first()[0]
    if clash is not None:
        row = rows.where(F.col(_ROW) == clash).select("_new").first()[0]
        raise UniqueError(f"UNIQUE constraint failed: {({c: row[c] for c in named})} meets two rows")

    decided = settled.join(rows.select(F.col(_ROW).alias("last"), "_new"), "last")
    replaced = decided.where("origin IS NOT NULL").join(met.select(F.col(_NODE).alias("origin"), *columns), "origin").select(*columns, "_new")
    same = reduce(and_, [F.col(f"t.`{c}`").eqNullSafe(F.col(f"n.{mine}")) for c, mine in zip(named, columns)])
    hit = F.col("n._new").isNotNull()
    kept = target.alias("t").join(replaced.alias("n"), same, "left").select(*[
        (F.when(hit, F.col("n._new").getField(c)).otherwise(F.col(f"t.`{c}`")) if c in supplied else F.col(f"t.`{c}`")).alias(c) for c in target.columns])
    fresh = decided.where("origin IS NULL").select("_new").unionByName(lone.select("_new"))
    added = fresh.select(*[(F.col("_new").getField(c) if c in supplied else defaults.get(c, F.lit(None)).cast(kinds[c])).alias(c) for c in target.columns])
    grown = settled.agg(F.count_if(F.col("origin").isNull()).alias("_new")).crossJoin(lone.agg(F.count(F.lit(1)).alias("_lone")))  # one row each
    counted = grown.crossJoin(rows.agg(F.count(F.lit(1)).alias("total"))).select((F.col("_new") + F.col("_lone")).alias("inserted"), "total")
    return Upsert(kept.unionByName(added), counted.select("inserted", (F.col("total") - F.col("inserted")).alias("updated"), "total"))
