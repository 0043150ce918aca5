"""Small helpers on Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to an expression that names it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
