"""Scalar functions over columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_odds(p: Column, epsilon: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))
    return F.ln(q / (1 - q))


def log_sum_exp(columns: Sequence[Column]) -> Column:
    m = F.greatest(*columns)
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.exp(c - m), F.lit(0.0))
    return m + F.ln(total)


def arg_max(columns: dict[str, Column]) -> Column:
    """Name of the greatest; the first of equal ones."""
    values = F.array(*columns.values())
    return F.element_at(F.array(*[F.lit(k) for k in columns]), F.array_position(values, F.array_max(values)).cast("int"))


def digitize(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are at or below x."""
    return F.when(x.isNotNull(), F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def rescale_odds(p: Column, factor: float) -> Column:
    return factor * p / (1 - p + factor * p)


def one_decimal(x: Column) -> Column:
    """Half-even to one decimal, without a trailing .0."""
    return F.regexp_replace(F.bround(x.cast("decimal(20,6)"), 1).cast("decimal(20,1)").cast("string"), r"\.0$", "")


def english_list(items: Column) -> Column:
    """a / a and b / a, b, and c."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.get(items, n - 1)
    return F.when(n == 0, "").when(n == 1, last).when(n == 2, F.concat(head, F.lit(" and "), last)).otherwise(F.concat(head, F.lit(", and "), last))


def entropy(p: Column) -> Column:
    """In nats, over an array of probabilities."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def hash_unit(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that only depends on the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
