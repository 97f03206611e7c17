"""An actor's behaviour with a partner against the same actor's behaviour with everybody else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIANCE_FLOOR = 1e-6


def moments(metrics: Sequence[str], prefix: str) -> list[Column]:
    return [e for m in metrics for e in (F.sum(F.col(m).cast("double")).alias(f"{prefix}_s_{m}"), F.sum(F.col(m).cast("double") * F.col(m)).alias(f"{prefix}_ss_{m}"))]


def complement(seats: DataFrame, presence: DataFrame, group: str, actor: str, partner: str, metrics: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(actor, partner, n1, n0 and sums): events with the partner present, and all of the actor's events minus these.

    Two sums and a subtraction; an anti join of absent events is never made.
    """
    keys = [actor, *extra]
    total = seats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all"), *moments(metrics, "all"))
    here = seats.join(presence, [group, actor]).groupBy(*keys, partner).agg(F.count(F.lit(1)).alias("n1"), *moments(metrics, "in"))
    both = here.join(total, keys)
    out = [F.col(k) for k in (*keys, partner)] + [F.col("n1"), (F.col("n_all") - F.col("n1")).alias("n0")]
    for m in metrics:
        out += [F.col(f"in_s_{m}").alias(f"s1_{m}"), F.col(f"in_ss_{m}").alias(f"ss1_{m}"), (F.col(f"all_s_{m}") - F.col(f"in_s_{m}")).alias(f"s0_{m}"), (F.col(f"all_ss_{m}") - F.col(f"in_ss_{m}")).alias(f"ss0_{m}")]
    return both.select(*out)


def welch(n1: Column, s1: Column, ss1: Column, n0: Column, s0: Column, ss0: Column) -> tuple[Column, Column]:
    """Difference of means and Welch's t, with floors; null where a side has fewer than two events."""
    m1, m0 = F.try_divide(s1, n1), F.try_divide(s0, n0)
    v1 = F.greatest(F.try_divide(ss1 - n1 * m1 * m1, n1 - 1), F.lit(VARIANCE_FLOOR))
    v0 = F.greatest(F.try_divide(ss0 - n0 * m0 * m0, n0 - 1), F.lit(VARIANCE_FLOOR))
    enough = (n1 > 1) & (n0 > 1)
    return F.when(enough, m1 - m0), F.when(enough, (m1 - m0) / F.sqrt(v1 / n1 + v0 / n0))


def leave_one_out(df: DataFrame, group: Sequence[str], member: str, total: str, count: str, name: str) -> DataFrame:
    """The mean over the group's other members: (group total - own) / (group count - own), null where there are no others."""
    sums = df.groupBy(*group).agg(F.sum(total).alias("t_"), F.sum(count).alias("c_"))
    return df.join(sums, list(group)).withColumn(name, F.try_divide(F.col("t_") - F.col(total), F.col("c_") - F.col(count))).drop("t_", "c_")
