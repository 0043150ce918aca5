"""Per-payload row filters for rows that already are rows: skip → head → tail, by ordinal."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RowFilter = Callable[[DataFrame, int], DataFrame]


def skip_head(df: DataFrame, ordinal: str, skip: int = 0, head: int = 0) -> DataFrame:
    """``ordinal`` counts 0, 1, 2 … inside each payload, so both filters are plain comparisons."""
    pos = F.col(f"`{ordinal}`")
    test = None
    if skip > 0:
        test = pos >= skip
    if head > 0:
        upper = pos < max(skip, 0) + head
        test = upper if test is None else test & upper
    return df if test is None else df.where(test)


def tail(df: DataFrame, payload: Sequence[str], ordinal: str, n: int) -> DataFrame:
    """Last ``n`` rows per payload.

    The rank is filtered by a constant, so Spark keeps only ``n`` rows per payload in every map
    task before the exchange: a payload of any size costs a task ``n`` rows per upstream task.
    """
    if n <= 0:
        return df
    w = Window.partitionBy(*payload).orderBy(F.col(f"`{ordinal}`").desc())
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def filter_rows(df: DataFrame, payload: Sequence[str], ordinal: str, filters: Mapping | None) -> DataFrame:
    filters = filters or {}
    skip, head, last = (int(filters.get(k) or 0) for k in ("skip_lines", "head", "tail"))
    return tail(skip_head(df, ordinal, skip, head), payload, ordinal, last)


def first_row(df: DataFrame, payload: Sequence[str], ordinal: str) -> DataFrame:
    """First row of each payload, kept by ``min_by`` so that map tasks pre-aggregate."""
    rest = [c for c in df.columns if c not in payload]
    return (
        df.groupBy(*payload)
        .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(f"`{ordinal}`")).alias("_first"))
        .select(*payload, "_first.*")
    )
