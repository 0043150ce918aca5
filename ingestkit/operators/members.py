"""Long lists of values as a table: a semi or anti join instead of a literal list in the plan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: Lists up to this length stay literals of the plan; a table of more than ``BROADCAST`` values is not broadcast.
LONG, BROADCAST = 1_000, 1_000_000

_VALUE = "_member"


def is_long(values: Any) -> bool:
    return isinstance(values, (list, tuple, set, frozenset)) and len(values) > LONG


def _kind(values: Sequence):
    if not values:
        return None
    if all(isinstance(v, bool) for v in values):
        return BooleanType()
    if all(isinstance(v, int) and -(1 << 63) <= v < 1 << 63 for v in values):
        return LongType()
    if all(isinstance(v, (int, float)) for v in values):
        return DoubleType()
    if all(isinstance(v, str) for v in values):
        return StringType()
    return None


def keep_members(df: DataFrame, column: str, values: Sequence, among: bool, null_equal: bool) -> DataFrame:
    """Rows whose ``column`` is (``among``) or is not one of ``values``.

    ``null_equal``: a NULL equals a None in the list and nothing else, so without one ``not in`` keeps it. Otherwise SQL
    counts: a NULL is neither in nor not in a list, and nothing is known to be not in a list that holds one.
    """
    plain = list(dict.fromkeys(v for v in values if v is not None))
    has_null, cell = len(plain) < len(set(values)), F.col(f"`{column}`")
    if not null_equal:
        if has_null and not among:
            return df.where(F.lit(False))
        has_null = False
    kind = _kind(plain)
    if kind is None:  # times, structures and mixed lists are compared as Spark reads the literals
        hit = F.coalesce(cell.isin(plain), F.lit(False)) | (cell.isNull() if has_null else F.lit(False))
        return df.where(hit if among else ~hit & (F.lit(True) if null_equal else cell.isNotNull()))
    typed = {LongType: int, DoubleType: float}.get(type(kind), lambda v: v)
    listed = df.sparkSession.createDataFrame([(typed(v),) for v in plain], StructType([StructField(_VALUE, kind)]))
    if has_null:
        listed = listed.unionByName(df.sparkSession.range(1).select(F.lit(None).cast(kind).alias(_VALUE)))
    if len(plain) <= BROADCAST:
        listed = F.broadcast(listed)
    same = cell.eqNullSafe(F.col(_VALUE)) if has_null else cell == F.col(_VALUE)
    if among:
        return df.join(listed, same, "left_semi")
    rest = df if null_equal else df.where(cell.isNotNull())
    return rest.join(listed, same, "left_anti")
