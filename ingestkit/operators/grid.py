"""Parameter grid: every combination of the listed values, as columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestkit.functions.templates import has_variables, render


def _value_list(iterate: Mapping | Sequence[Mapping] | None) -> list[Mapping]:
    if not iterate:
        return []
    return [iterate] if isinstance(iterate, Mapping) else list(iterate)


def expand_grid(df: DataFrame, iterate: Mapping | Sequence[Mapping] | None,
                params: Mapping[str, Any] | None = None) -> DataFrame:
    """Each row of ``df`` once per combination; values become text. No join: one explode per variable.

    Run ``params`` join every context and override columns of the same name.
    """
    out = df.withColumns({k: F.lit(v) for k, v in params.items()}) if params else df
    for item in _value_list(iterate):
        values = F.array(*[F.lit(str(v)) for v in item["values"]]).cast("array<string>")
        others = [F.col(f"`{c}`") for c in out.columns if c != item["var_name"]]
        out = out.select(*others, F.explode(values).alias(item["var_name"]))
    return out


def contexts(
    spark: SparkSession,
    iterate: Mapping | Sequence[Mapping] | None,
    run_ts: dt.datetime | str | Column,
    url: str = "",
    task_name: str = "",
    params: Mapping[str, Any] | None = None,
) -> DataFrame:
    """One row per request: parameters, ``task_name`` and the rendered ``url``.

    Without a grid there is exactly one context. Template variables inside parameter values are
    rendered too.
    """
    base = spark.range(1).select(F.lit(task_name).alias("task_name"))
    grid = expand_grid(base, iterate, params)
    columns = {c: F.col(f"`{c}`") for c in grid.columns}
    templated: dict[str, set[str]] = {}
    for name, value in (params or {}).items():
        if isinstance(value, str) and has_variables(value):
            templated.setdefault(name, set()).add(value)
    for item in _value_list(iterate):
        for value in map(str, item["values"]):
            if has_variables(value):
                templated.setdefault(item["var_name"], set()).add(value)
    rendered = {}
    for name, texts in templated.items():
        value = columns[name]
        for text in sorted(texts):
            value = F.when(columns[name] == text, render(text, run_ts, columns)).otherwise(value)
        rendered[name] = value
    raw_url = str((params or {}).get("url", url))
    # the address sees the values as given first, then is rendered like every other value
    with_url = grid.withColumn("url", render(raw_url, run_ts, columns)) if "url" not in rendered else grid
    return with_url.withColumns(rendered) if rendered else with_url
