"""Greedy time-to-live dedup: keep a row unless the same key was *kept* less than ``seconds`` ago.

A dropped row does not extend the window, so the rule is a chain along the key's timeline and no
fixed window function expresses it. One key may hold a third of all rows, so the timeline is cut
into spans and solved in three steps, none of which holds a whole key:

1. ``(key, span)`` partitions, in time order: for every possible moment at which the key becomes
   free again during the span, when would it be free after the span? Chains that meet stay
   together, so the answer is a short step function.
2. Per key, over these step functions only: walk the spans in order and fix, for each, the moment
   at which the key really becomes free.
3. ``(key, span)`` partitions again, each with its known start: keep or drop every row.

All three scans read sorted partitions as a stream, see only key and time, and hold a few numbers,
never a group. The full rows move once, in the semi-join with the kept (key, time) pairs.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestkit.functions.cleaning import floor_to

# Executors need no copy of this package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_KEY, _TIME, _SPAN, _TIE = "_key", "_us", "_span", "_tie"
DAY_US = 86_400_000_000


def span_length(ttl_us: int) -> int:
    """About a day: short enough to split a hot key, but 16 to 256 TTLs, so that step two stays small."""
    return max(16 * ttl_us, min(256 * ttl_us, DAY_US))


_STEPS = T.StructType([
    T.StructField(_KEY, T.StringType()), T.StructField(_SPAN, T.LongType()),
    T.StructField("after", T.LongType()), T.StructField("upto", T.LongType()), T.StructField("leave", T.LongType()),
])
_STARTS = T.StructType([
    T.StructField(_KEY, T.StringType()), T.StructField(_SPAN, T.LongType()), T.StructField("free_at", T.LongType()),
])


def _values(pdf: pd.DataFrame, *columns: str):
    # plain Python values iterate several times faster than a Series does
    return zip(*(pdf[c].tolist() for c in columns))


def _joined(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(intervals):
        if out and out[-1][1] == low:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def _span_steps(batches: Iterator[pd.DataFrame], ttl: int) -> Iterator[pd.DataFrame]:
    """Rows ``(after, upto] → leave``: a key free at such a moment is free again at ``leave``.

    ``chains`` holds (next free moment, the start intervals that lead there), ordered by the
    former. An event takes over all chains that are free by then; they continue as one.
    """
    out: list[tuple] = []
    current, chains, entered = None, deque(), 0

    def flush():
        for leave, intervals in chains:
            out.extend((*current, low, high, leave) for low, high in intervals)

    for pdf in batches:
        for key, begin, us in _values(pdf, _KEY, _SPAN, _TIME):
            if (key, begin) != current:
                if current is not None:
                    flush()
                current, chains, entered = (key, begin), deque(), begin - 1
            taken: list[tuple[int, int]] = []
            while chains and chains[0][0] <= us:
                taken += chains.popleft()[1]
            # moments up to this event at which a key may become free in the span; a keep in the
            # span before ends at most one TTL after the span begins
            limit = min(us, begin + ttl)
            if limit > entered:
                taken.append((entered, limit))
                entered = limit
            if taken:
                chains.append((us + ttl, _joined(taken) if len(taken) > 1 else taken))
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=_STEPS.fieldNames())
            out = []
    if current is not None:
        flush()
    if out:
        yield pd.DataFrame(out, columns=_STEPS.fieldNames())


def _walk_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step functions in (key, span) order → the moment each key is free in each span."""
    key, begin, free, leave = None, None, None, None
    for pdf in batches:
        out = []
        for k, b, low, high, then in _values(pdf, _KEY, _SPAN, "after", "upto", "leave"):
            if k != key:
                key, begin, free = k, None, None
            if b != begin:
                begin = b
                free = b if free is None else max(free, b)
                start, done = free, False
                out.append((k, b, free))
            if not done and low < start <= high:
                free, done = then, True
        yield pd.DataFrame(out, columns=_STARTS.fieldNames())


def _mark(batches: Iterator[pd.DataFrame], ttl: int) -> Iterator[pd.DataFrame]:
    current, free = None, 0
    for pdf in batches:
        keep = []
        for key, begin, us, start in _values(pdf, _KEY, _SPAN, _TIME, "free_at"):
            if (key, begin) != current:
                current, free = (key, begin), start
            kept = us >= free
            if kept:
                free = us + ttl
            keep.append(kept)
        yield pdf.loc[keep, [_KEY, _TIME, _TIE]]


def ttl_dedup(df: DataFrame, key: str | Column, ts: str | Column, seconds: int, tie: str | Column,
              span_windows: int | None = None) -> DataFrame:
    """Rows of ``df`` that the greedy rule keeps. ``tie`` (unique) orders rows of one key and instant, a NULL first.

    Of such rows only the first can be kept; they are reduced before anything else by a map-side
    aggregate, so copies of one request never travel. A row without a time is kept.
    """
    if seconds <= 0:
        return df
    ttl = seconds * 1_000_000
    span = ttl * span_windows if span_windows else span_length(ttl)
    key = F.col(key) if isinstance(key, str) else key
    ts = F.col(ts) if isinstance(ts, str) else ts
    tie = F.col(tie) if isinstance(tie, str) else tie
    marked = df.withColumns({
        # NULL keys share one chain like any other value
        _KEY: F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("")),
        _TIME: F.unix_micros(ts.cast("timestamp")),
        _TIE: tie,
    })
    slim = (
        # in a struct a NULL is the least; bare it would be left out of account
        marked.where(F.col(_TIME).isNotNull()).groupBy(_KEY, _TIME).agg(F.min(F.struct(F.col(_TIE))).alias("_least"))
        .select(_KEY, _TIME, F.col("_least")[_TIE].alias(_TIE))
        # never NULL here; said so, both uses below keep one and the same exchange
        .withColumn(_SPAN, F.coalesce(floor_to(F.col(_TIME), span), F.lit(0).cast("bigint")))
        .repartition(_KEY, _SPAN)
    )
    steps = (
        slim.sortWithinPartitions(_KEY, _SPAN, _TIME)
        .mapInPandas(lambda b: _span_steps(b, ttl), _STEPS)
    )
    starts = (
        steps.repartition(_KEY).sortWithinPartitions(_KEY, _SPAN, "after")
        .mapInPandas(_walk_spans, _STARTS)
    )
    pairs = T.StructType([f for f in slim.schema.fields if f.name in (_KEY, _TIME)]
                         + [T.StructField(_TIE, slim.schema[_TIE].dataType)])
    kept = (
        slim.join(starts, [_KEY, _SPAN]).sortWithinPartitions(_KEY, _SPAN, _TIME)
        .mapInPandas(lambda b: _mark(b, ttl), pairs)
    )
    kept = kept.select(F.col(_KEY).alias("_k"), F.col(_TIME).alias("_t"), F.col(_TIE).alias("_i"))
    same = (F.col(_KEY) == F.col("_k")) & (F.col(_TIME) == F.col("_t")) & F.col(_TIE).eqNullSafe(F.col("_i"))
    result = marked.join(kept, same, "left_semi").select(*df.columns)
    return result.unionByName(marked.where(F.col(_TIME).isNull()).select(*df.columns))
