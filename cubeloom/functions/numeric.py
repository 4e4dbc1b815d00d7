"""Guarded arithmetic: what plain division would give as an infinity or not-a-number is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def digitize(value: Column, edges: list[float]) -> Column:
    """The number of edges at or below the value; null stays null."""
    return F.when(value.isNotNull(), reduce(lambda a, b: a + b, [(value >= F.lit(e)).cast("int") for e in edges]))


def not_nan(value: Column) -> Column:
    """Missing values as null."""
    return F.when(~F.isnan(value), value)


def cube_root(value: Column) -> Column:
    """The real third root, of negative values too."""
    return F.signum(value) * F.pow(F.abs(value), F.lit(1.0 / 3.0))
