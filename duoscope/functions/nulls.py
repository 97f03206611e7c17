"""Null, NaN and zero handling with one meaning everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum0(x) -> Column:
    """Sum that is 0 over nothing."""
    return F.coalesce(F.sum(x), F.lit(0))


def any0(x) -> Column:
    return F.coalesce(F.bool_or(x), F.lit(False))


def all1(x) -> Column:
    return F.coalesce(F.bool_and(x), F.lit(True))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def clip(x: Column, low=None, high=None) -> Column:
    """Null stays null, unlike in greatest() and least()."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(low))
    if high is not None:
        y = F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def safe_ratio(a: Column, b: Column, epsilon: float = 1e-6) -> Column:
    return a / (b + F.lit(epsilon))


def mapped(x: Column, values: dict, strict: bool = True, default=None) -> Column:
    """Dictionary lookup; a missing key is an error or gives the default."""
    table = F.create_map(*[F.lit(v) for kv in values.items() for v in kv])
    found = F.try_element_at(table, x)
    if strict:
        return F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("unmapped value: "), x.cast("string")))))
    return F.coalesce(found, F.lit(default))
