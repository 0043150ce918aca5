"""Row predicates used after cleaning. NULL follows Python's comparison rules, not SQL's."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestkit.operators.members import is_long, keep_members

Predicate = Callable[[Column, Any], Column]


def _or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _in(c: Column, values: Sequence) -> Column:
    members = [v for v in values if v is not None]
    hit = _or_false(c.isin(members)) if members else F.lit(False)
    return hit | c.isNull() if len(members) < len(values) else hit


_BUILT_IN: dict[str, Predicate] = {
    ">": lambda c, v: _or_false(c > F.lit(v)),
    "<": lambda c, v: _or_false(c < F.lit(v)),
    ">=": lambda c, v: _or_false(c >= F.lit(v)),
    "<=": lambda c, v: _or_false(c <= F.lit(v)),
    "==": lambda c, v: c.eqNullSafe(F.lit(v)),
    "!=": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "in": _in,
    "not_in": lambda c, v: ~_in(c, v),
    "contains": lambda c, v: _or_false(c.cast("string").contains(v)),
}


class Predicates:
    def __init__(self) -> None:
        self._ops = dict(_BUILT_IN)

    def register_op(self, name: str, fn: Predicate) -> None:
        self._ops[name] = fn

    def condition(self, c: Column, where: Mapping) -> Column:
        fn = self._ops.get(where.get("op", "=="))
        return fn(c, where.get("value")) if fn else F.lit(True)  # an unknown operator keeps the row

    def keep(self, df: DataFrame, fields: Sequence[Mapping]) -> DataFrame:
        """One filter: the AND of every field's ``where``; a long list of values is a join of its own.

        Values of another kind than the column (text, number, truth) never equal it, and ordering by them drops the row;
        that is decided here, on the literals, so nothing is cast at run time.
        """
        tests, lists = [], []
        for field in fields:
            where = field.get("where")
            if where:
                kind, op = df.schema[field["name"]].dataType.simpleString(), where.get("op")
                if op in ("in", "not_in") and self._ops[op] is _BUILT_IN[op] and is_long(where.get("value")):
                    lists.append((field["name"], [v for v in where["value"] if _alike(kind, v)], op == "in"))
                else:
                    tests.append(self._by_kind(kind, F.col(f"`{field['name']}`"), where))
        kept = df.filter(reduce(and_, tests)) if tests else df
        for name, values, among in lists:
            kept = keep_members(kept, name, values, among, null_equal=True)
        return kept

    def _by_kind(self, kind: str, c: Column, where: Mapping) -> Column:
        op, value = where.get("op", "=="), where.get("value")
        if self._ops.get(op) is not _BUILT_IN.get(op):
            return self.condition(c, where)
        if op in (">", "<", ">=", "<="):
            return self.condition(c, where) if _alike(kind, value) and value is not None else F.lit(False)
        if op in ("==", "!="):
            return self.condition(c, where) if _alike(kind, value) else F.lit(op == "!=")
        if op in ("in", "not_in"):
            return self.condition(c, {"op": op, "value": [v for v in value if _alike(kind, v)]})
        return self.condition(c, where)


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _alike(kind: str, value: Any) -> bool:
    """Whether a literal can equal a value of the column's type at all; NULL equals NULL in any."""
    if value is None:
        return True
    if kind == "string":
        return isinstance(value, str)
    if kind.startswith(_NUMBERS):
        return isinstance(value, (int, float))
    if kind == "boolean":
        return isinstance(value, bool)
    return True  # times and structures are compared as Spark reads the literal


DEFAULT_PREDICATES = Predicates()


def condition(c: Column, op: str, value: Any) -> Column:
    return DEFAULT_PREDICATES.condition(c, {"op": op, "value": value})
