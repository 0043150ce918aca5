"""Row updates, deletes and truncation on a table frame (SQL meaning: NULL matches nothing)."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingestkit.operators.query import comparison, require_columns


def equals(df: DataFrame, column: str, value: Any) -> Column:
    return F.coalesce(comparison(df, column, "=", value), F.lit(False))


def update_where(df: DataFrame, column: str, value: Any, data: Mapping[str, Any]) -> DataFrame:
    """Set the given columns in every row where ``column = value``."""
    if not data:
        raise ValueError("no data provided")
    require_columns(df, column, *data)
    hit = equals(df, column, value)
    return df.withColumns({
        c: F.when(hit, (v if isinstance(v, Column) else F.lit(v)).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`"))
        for c, v in data.items()})


def delete_where(df: DataFrame, column: str, value: Any) -> tuple[DataFrame, DataFrame]:
    """(rows left, one-row frame ``deleted``)"""
    require_columns(df, column)
    hit = equals(df, column, value)
    return df.where(~hit), df.where(hit).agg(F.count(F.lit(1)).alias("deleted"))


def truncate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.lit(False)), df.agg(F.count(F.lit(1)).alias("deleted"))
