"""The table query surface: projection, predicates, grouping, aggregates, order, page and total.

Every name is checked against the schema and every value becomes a literal; no caller text is
ever parsed as SQL.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ingestkit.operators.members import is_long, keep_members
from ingestkit.session import cut_lineage

MAX_LIMIT = 9999
DEFAULT_LIMIT = 100
# A page that ends within this many rows is one top-k; a deeper one is cut out of a sorted table.
TOP_K_ROWS = 100_000

_COMPARE = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v,
}
OPERATORS = (*_COMPARE, "IN", "NOT IN", "LIKE", "NOT LIKE", "IS NULL", "IS NOT NULL", "BETWEEN")
_AGGREGATE = re.compile(r"(SUM|COUNT|AVG|MAX|MIN)\s*\(\s*([^()]+?)\s*\)(?:\s+(?:AS\s+)?([A-Za-z_]\w*))?\s*\Z", re.IGNORECASE)


class QueryError(ValueError):
    """A bad column, operator or expression in a query."""


def require_columns(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise QueryError(f"unknown column: {name}")


def _names(text: str | Sequence[str] | None) -> list[str]:
    if not text:
        return []
    items = text.split(",") if isinstance(text, str) else text
    return [i.strip() for i in items if i.strip()]


_NUMBER = re.compile(r"[+-]?(?:[0-9]+(\.[0-9]*)?|(\.[0-9]+))([eE][+-]?[0-9]+)?")


def _literal(df: DataFrame, column: str, value: Any) -> Any:
    """The value in the column's own kind, as column affinity does: '42' for a number column is 42."""
    kind = df.schema[column].dataType
    if isinstance(value, bool):
        value = int(value)
    if isinstance(kind, StringType):
        return value if value is None or isinstance(value, str) else str(value)
    if isinstance(kind, NumericType) and isinstance(value, str):
        number = _NUMBER.fullmatch(value.strip())
        if number:
            return float(value) if any(g is not None for g in number.groups()) else int(value)
    return value


def comparison(df: DataFrame, column: str, op: str, value: Any) -> Column:
    require_columns(df, column)
    c, v = F.col(f"`{column}`"), _literal(df, column, value)
    if isinstance(df.schema[column].dataType, NumericType) and isinstance(v, str):
        # text that is no number sorts after every number
        return F.when(c.isNotNull(), F.lit(op in ("<", "<=", "!=", "<>")))
    return _COMPARE[op](c, F.lit(v))


def _like(c: Column, pattern: str) -> Column:
    # matches without regard to case; a backslash has no special meaning
    return c.cast("string").ilike(str(pattern).replace("\\", "\\\\"))


def where_condition(df: DataFrame, cond: Mapping) -> Column:
    column, op, value = cond.get("col", ""), str(cond.get("op", "=")).upper(), cond.get("value")
    require_columns(df, column)
    if op not in OPERATORS:
        raise QueryError(f"unsupported operator: {op}")
    c = F.col(f"`{column}`")
    if op == "IS NULL":
        return c.isNull()
    if op == "IS NOT NULL":
        return c.isNotNull()
    if op in ("IN", "NOT IN"):
        if not isinstance(value, list):
            raise QueryError(f"{op}: a list of values is needed")
        numeric = isinstance(df.schema[column].dataType, NumericType)
        values = [v for v in (_literal(df, column, x) for x in value) if not (numeric and isinstance(v, str))]
        if not values:
            hit = F.lit(False) if not value else F.when(c.isNotNull(), F.lit(False))
        else:
            hit = c.isin(values)
        return hit if op == "IN" else ~hit
    if op == "BETWEEN":
        if not isinstance(value, list) or len(value) != 2:
            raise QueryError("BETWEEN: two bounds in a list are needed")
        return comparison(df, column, ">=", value[0]) & comparison(df, column, "<=", value[1])
    if op in ("LIKE", "NOT LIKE"):
        hit = _like(c, value) if value is not None else F.lit(None).cast("boolean")
        return hit if op == "LIKE" else ~hit
    return comparison(df, column, op, value)


def filter_table(df: DataFrame, where: str | Sequence[Mapping] | None) -> DataFrame:
    """``[{"col": …, "op": …, "value": …}]``, all conditions joined by AND, in one filter; a long list is a join of its own."""
    if not where:
        return df
    if isinstance(where, str):
        try:
            where = json.loads(where)
        except json.JSONDecodeError as e:
            raise QueryError("invalid JSON in 'where'") from e
    if not isinstance(where, list):
        raise QueryError("'where' must be a list")
    long = [c for c in where if str(c.get("op", "")).upper() in ("IN", "NOT IN") and is_long(c.get("value")) and isinstance(c["value"], list)]
    short = [where_condition(df, c) for c in where if c not in long] if long else [where_condition(df, c) for c in where]
    kept = df.where(reduce(and_, short)) if short else df
    for cond in long:
        require_columns(df, cond.get("col", ""))
        numeric = isinstance(df.schema[cond["col"]].dataType, NumericType)
        values = [v for v in (_literal(df, cond["col"], x) for x in cond["value"]) if not (numeric and isinstance(v, str))]
        kept = keep_members(kept, cond["col"], values, str(cond["op"]).upper() == "IN", null_equal=False)
    return kept


def parse_aggregates(df: DataFrame, text: str) -> list[tuple[str, Column]]:
    out = []
    for part in text.split(","):
        match = _AGGREGATE.match(part.strip())
        if not match:
            raise QueryError(f"invalid aggregate expression: {part.strip()}")
        name, column, alias = match.group(1).lower(), match.group(2).strip("`\"' "), match.group(3)
        if column == "*":
            if name != "count":
                raise QueryError(f"{name.upper()}(*) has no meaning")
            value = F.count(F.lit(1))
        else:
            require_columns(df, column)
            value = getattr(F, name)(F.col(f"`{column}`"))
        out.append((alias or part.strip(), value.alias(alias or part.strip())))
    return out


def order_columns(df: DataFrame, order_by: str | Sequence[str] | None) -> list[Column]:
    """NULL sorts lowest: first when ascending, last when descending."""
    columns = []
    for item in _names(order_by):
        name, *rest = item.split()
        if name not in df.columns:
            raise QueryError(f"cannot order by {name}: no such column")
        c = F.col(f"`{name}`")
        descending = bool(rest) and rest[0].upper() == "DESC"
        columns.append(c.desc_nulls_last() if descending else c.asc_nulls_first())
    return columns


def count_where(df: DataFrame, where: str | Sequence[Mapping] | None = None, name: str = "total") -> DataFrame:
    return filter_table(df, where).agg(F.count(F.lit(1)).alias(name))


def shape_table(
    df: DataFrame,
    fields: str | Sequence[str] | None = None,
    where: str | Sequence[Mapping] | None = None,
    group_by: str | Sequence[str] | None = None,
    aggregate: str | None = None,
) -> DataFrame:
    """The result before ordering and paging."""
    rows = filter_table(df, where)
    groups, chosen = _names(group_by), _names(fields)
    require_columns(df, *groups, *chosen)
    if aggregate:
        values = [c for _, c in parse_aggregates(df, aggregate)]
        return rows.groupBy(*groups).agg(*values) if groups else rows.agg(*values)
    if groups:
        loose = [c for c in chosen or df.columns if c not in groups]
        if loose:
            raise QueryError(f"columns neither grouped nor aggregated: {loose}")
        return rows.select(*groups).distinct().select(*(chosen or groups))
    return rows.select(*chosen) if chosen else rows


def page(df: DataFrame, order_by: str | Sequence[str] | None, limit: int, offset: int = 0) -> DataFrame:
    """``ORDER BY … LIMIT … OFFSET``: a top-k near the start, a range of a sorted table far from it."""
    ordering = order_columns(df, order_by)
    if not ordering:
        return df.offset(offset).limit(limit) if offset else df.limit(limit)
    if offset + limit <= TOP_K_ROWS:
        ordered = df.orderBy(*ordering)
        return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)
    return _deep_page(df, ordering, limit, offset)


def positions(df: DataFrame, order_by: str | Sequence[str]) -> DataFrame:
    """``df`` with ``_position``, each row's place (from 1) in the whole order: rows in earlier sorted partitions and the
    place inside its own.

    The sort is checkpointed once: its range boundaries are sampled, so they must not be drawn twice.
    """
    return _numbered(df, order_columns(df, order_by))


def _numbered(df: DataFrame, ordering: Sequence[Column]) -> DataFrame:
    sorted_rows = cut_lineage(df.orderBy(*ordering))
    numbered = sorted_rows.withColumn("_id", F.monotonically_increasing_id())
    place = numbered.withColumns({
        "_part": F.shiftright("_id", 33), "_pos": F.col("_id").bitwiseAND((1 << 33) - 1)})
    counts = place.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition of the sort, whatever the table holds
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    joined = place.join(F.broadcast(before), "_part")
    return joined.select(*df.columns, (F.col("_before") + F.col("_pos") + 1).alias("_position"))


def _deep_page(df: DataFrame, ordering: Sequence[Column], limit: int, offset: int) -> DataFrame:
    """A range of global positions; what is written is the sorted table."""
    chosen = _numbered(df, ordering).where((F.col("_position") > offset) & (F.col("_position") <= offset + limit))
    return chosen.orderBy("_position").select(*df.columns)


def query_table(
    df: DataFrame,
    fields: str | Sequence[str] | None = None,
    where: str | Sequence[Mapping] | None = None,
    group_by: str | Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
    limit: int | None = DEFAULT_LIMIT,
    offset: int = 0,
    aggregate: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page, one-row ``total``). The total counts rows under ``where`` and ignores grouping.

    Without a limit this is the first page of ``DEFAULT_LIMIT`` rows; ``limit=None`` asks for the whole result.
    """
    if limit is not None and not 1 <= limit <= MAX_LIMIT:
        raise QueryError(f"limit must be between 1 and {MAX_LIMIT}")
    if offset < 0:
        raise QueryError("offset must not be negative")
    total = count_where(df, where)
    if order_by is None and not (aggregate or group_by) and "crawled_at" in df.columns:
        order_by = "crawled_at DESC"
    shaped = shape_table(df, None, where, group_by, aggregate) if not fields or aggregate else filter_table(df, where)
    chosen = _names(fields)
    if chosen and not aggregate:
        require_columns(df, *chosen)
        if group_by:
            shaped = shape_table(df, fields, where, group_by)
            chosen = []
    else:
        chosen = []
    # a row may be ordered by a column it does not show
    if limit is not None:
        result = page(shaped, order_by, limit, offset)
    else:
        ordering = order_columns(shaped, order_by)
        result = shaped.orderBy(*ordering) if ordering else shaped
    return (result.select(*chosen) if chosen else result), total


def page_count(total: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return total.select("total", F.ceil(F.col("total") / F.lit(limit)).cast("bigint").alias("pages"))
