"""Aggregates that do not fail on groups without variance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corr(a: str | Column, b: str | Column) -> Column:
    """Pearson's correlation over rows where both have a value; null without variance, where the built-in one raises."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
