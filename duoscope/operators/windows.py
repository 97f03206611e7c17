"""Ordered scans within groups. Each takes a total order, so results do not depend on how rows arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def ordered(group: Sequence[str], order: Sequence) -> Window:
    return Window.partitionBy(*group).orderBy(*order)


def before(group: Sequence[str], order: Sequence) -> Window:
    """The rows strictly before."""
    return ordered(group, order).rowsBetween(Window.unboundedPreceding, -1)


def position(group, order) -> Column:
    return F.row_number().over(ordered(group, order)) - 1


def exclusive_sum(x: Column, group, order) -> Column:
    return F.coalesce(F.sum(x).over(before(group, order)), F.lit(0))


def last_before(x: Column, group, order) -> Column:
    """The last non-null value strictly before: a shift and a forward fill in one frame."""
    return F.last(x, ignorenulls=True).over(before(group, order))


def session(gap: Column, limit: float, group, order) -> Column:
    """Number of the session: a new one starts where there is no gap or one over the limit."""
    return F.sum(F.when(gap.isNull() | (gap > limit), 1).otherwise(0)).over(ordered(group, order))


def average_rank(x: Column, group: Sequence[str]) -> Column:
    """Rank with ties averaged; null for null. Null values do not take ranks."""
    w = Window.partitionBy(*group, x.isNull()).orderBy(x)
    ties = Window.partitionBy(*group, x)
    return F.when(x.isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def percentile_rank(x: Column, group: Sequence[str]) -> Column:
    """Average rank over the group's size, nulls counted in the size."""
    return average_rank(x, group) / F.count(F.lit(1)).over(Window.partitionBy(*group))


def shrunk_percentile(x: Column, inner: Sequence[str], outer: Sequence[str], weight: float) -> Column:
    """(rank in the inner group + weight * percentile in the outer one) / (non-null size + weight)."""
    n = F.count(x).over(Window.partitionBy(*inner))
    outer_n = F.count(x).over(Window.partitionBy(*outer))
    return (average_rank(x, inner) + weight * average_rank(x, outer) / outer_n) / (n + weight)


def quintile(group, order, parts: int = 5) -> Column:
    """Equal parts by integer division of the position, so that remainders fall as they do there."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return F.floor(position(group, order) * parts / n).cast("int")


def rolling_mean(x: Column, width: int, least: int, group, order) -> Column:
    w = ordered(group, order).rowsBetween(-(width - 1), 0)
    return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))


def z_in_group(x: Column, group) -> Column:
    w = Window.partitionBy(*group)
    return (x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + 1e-6)


#: Groups of more rows on average are narrowed before their values are counted; so many rows of a group on average are looked at for that, and a group with fewer than LEAST_SEEN of them is not narrowed.
LARGE_GROUP, LEAST_SEEN, MARGIN = 60_000, 20_000, 0.015
#: Groups whose places are sent to all tasks at most; places of more are joined by group.
MOST_GROUPS = 100_000


def group_quantiles(df: DataFrame, x: str, quantiles: Sequence[float], group: Sequence[str] = (), name: str = "q_") -> DataFrame:
    """Per group an array of linear quantiles of x, by rank selection: equal values are counted, counts are summed along range-sorted partitions, and the values
    that hold a group's places q * (n - 1) are picked. No buffer or task holds a group. Nulls do not count; a group of nulls has no row.

    Of large groups only the values near a quantile are told apart (narrowed()); the others count as the gap that they lie in. Where a place falls into a gap all values are told apart.
    """
    from duoscope.runtime import materialize

    rows = df.filter(F.col(x).isNotNull()).select(*group, F.col(x).cast("double").alias("x_"))
    places = materialize(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_")), "places")
    groups, n = places.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_"), F.lit(0))).first()
    large = n > groups * LARGE_GROUP
    picked = materialize(_picked(narrowed(rows, quantiles, group, groups * LARGE_GROUP / n) if large else rows.withColumn("told_", F.lit(True)), places, groups, quantiles, group), "picked")
    if large and not picked.filter("not told_").isEmpty():
        picked = _picked(rows.withColumn("told_", F.lit(True)), places, groups, quantiles, group)
    end = lambda k: F.max(F.when(F.col("end_") == k, F.col("x_")))
    each = picked.groupBy(*group, "i_").agg((end(0) + (end(1) - end(0)) * F.max("part_")).alias("v_"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("i_", "v_"))), lambda s: s["v_"]).alias(name)
    return each.groupBy(*group).agg(listed) if group else each.agg(listed)


def narrowed(rows: DataFrame, quantiles: Sequence[float], group: Sequence[str], share: float) -> DataFrame:
    """rows with told_: whether x_ lies near a quantile of its group, as seen in a share of the rows. Others get the upper end of what is told apart below them."""
    from duoscope.runtime import materialize

    ends = [F.lit(float(p)) for q in quantiles for p in (max(q - MARGIN, 0.0), min(q + MARGIN, 1.0))]
    seen = rows.sample(share, seed=7).groupBy(*group).agg(F.count(F.lit(1)).alias("seen_"), F.percentile("x_", F.array(*ends)).alias("near_"))
    seen = materialize(seen.filter(F.col("seen_") >= LEAST_SEEN).drop("seen_").withColumnsRenamed({g: f"{g}_" for g in group}), "near")
    t = rows.join(F.broadcast(seen), [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in group] or F.lit(True), "left").drop(*[f"{g}_" for g in group])
    x, low, high = F.col("x_"), lambda k: F.get("near_", F.lit(2 * k)), lambda k: F.get("near_", F.lit(2 * k + 1))
    told, below = F.col("near_").isNull(), F.lit(float("-inf"))
    for k, q in enumerate(quantiles):
        inside = (x >= low(k)) if q + MARGIN >= 1 else (x <= high(k)) if q - MARGIN <= 0 else (x >= low(k)) & (x <= high(k))
        told, below = told | inside, F.when(x > high(k), F.greatest(below, high(k))).otherwise(below)
    return t.select(*group, F.when(told, x).otherwise(below).alias("x_"), told.alias("told_"))


def _picked(rows: DataFrame, places: DataFrame, groups: int, quantiles: Sequence[float], group: Sequence[str]) -> DataFrame:
    """(group, i_, part_, end_, x_, told_): the values at the lower (end_ 0) and upper place of the i_th quantile, and how far it lies between them."""
    counts = rows.groupBy(*group, "x_", "told_").agg(F.count(F.lit(1)).alias("c_"))
    upto = running_total(counts, "c_", [*[F.asc(g) for g in group], F.asc("x_"), F.desc("told_")], "upto_")
    first = upto.groupBy(*group).agg(F.min(F.col("upto_") - F.col("c_")).alias("first_"))
    same = lambda t: [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in group] or F.lit(True)
    named = {g: f"{g}_" for g in group}
    known = places.join(first.withColumnsRenamed(named), same(first)).drop(*named.values()).withColumnsRenamed(named)
    t = upto.join(F.broadcast(known) if groups <= MOST_GROUPS else known, same(known)).drop(*named.values())
    at = [(F.col("n_") - 1) * F.lit(float(q)) for q in quantiles]
    want = F.array(*[F.struct(F.lit(i).alias("i_"), (p - F.floor(p)).alias("part_"), F.lit(e).alias("end_"), f(p).alias("at_")) for i, p in enumerate(at) for e, f in enumerate((F.floor, F.ceil))])
    upper = F.col("upto_") - F.col("first_")
    mine = F.filter(want, lambda s: (s["at_"] < upper) & (s["at_"] >= upper - F.col("c_")))
    return t.withColumn("mine_", mine).filter(F.size("mine_") > 0).select(*group, "x_", "told_", F.explode("mine_").alias("m_")).select(*group, "x_", "told_", "m_.i_", "m_.part_", "m_.end_")


def robust_z(df: DataFrame, x: str, group: Sequence[str], name: str, epsilon: float = 1e-6) -> DataFrame:
    """(x - median) / (interquartile range + epsilon); quartiles are selected by rank and joined."""
    q = group_quantiles(df, x, (0.25, 0.5, 0.75), group)
    return df.join(q, list(group), "left").withColumn(name, (F.col(x) - F.col("q_")[1]) / (F.col("q_")[2] - F.col("q_")[0] + epsilon)).drop("q_")


def top_k(df: DataFrame, k: int, group, order) -> DataFrame:
    return df.withColumn("rn_", F.row_number().over(ordered(group, order))).filter(F.col("rn_") <= k).drop("rn_")


def running_total(df: DataFrame, x: str, order: Sequence[Column], name: str) -> DataFrame:
    """The sum of x (whole numbers) over all rows up to this one, in a total order."""
    return running_totals(df, {x: name}, order)


def running_totals(df: DataFrame, names: dict[str, str], order: Sequence[Column]) -> DataFrame:
    """Of several columns of whole numbers, under the names given: sums within range-sorted partitions and the partitions' offsets, a row each."""
    from duoscope.runtime import materialize

    parts = materialize(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("part_").agg(*[F.sum(x).alias(f"{n}_n_") for x, n in names.items()])
    offsets = sums.select("part_", *[F.coalesce(F.sum(f"{n}_n_").over(upto), F.lit(0)).alias(f"{n}_offset_") for n in names.values()])
    within = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = parts.withColumns({f"{n}_in_": F.sum(x).over(within) for x, n in names.items()}).join(F.broadcast(offsets), "part_")
    return inside.withColumns({n: F.col(f"{n}_in_") + F.col(f"{n}_offset_") for n in names.values()}).drop("part_", *[f"{n}_{k}_" for n in names.values() for k in ("in", "offset")])


def counted_rank(df: DataFrame, x: str, group: Sequence[str]) -> DataFrame:
    """df with rank_ (average rank of x in its group, null for null), n_ (values that are not null) and rows_ of the group, for groups larger than a task.

    Equal values are counted, counts are summed along range-sorted partitions, and rows meet their value's rank.
    """
    counts = df.groupBy(*group, x).agg(F.count(F.lit(1)).alias("c_"))
    upto = running_total(counts, "c_", [*[F.asc(g) for g in group], F.asc_nulls_last(x)], "upto_")
    sizes = upto.groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col(x).isNotNull(), F.col("c_"))), F.lit(0)).alias("n_"), F.sum("c_").alias("rows_"), F.min(F.col("upto_") - F.col("c_")).alias("first_"))
    rank = F.col("upto_") - F.col("first_") - (F.col("c_") - 1) / 2
    same = [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in group]
    named = sizes.withColumnsRenamed({g: f"{g}_" for g in group})
    ranks = upto.join(named, same).select(*[f"{g}_" for g in group], F.col(x).alias("x_"), F.when(F.col(x).isNotNull(), rank).alias("rank_"), "n_", "rows_")
    return df.join(ranks, [*same, F.col(x).eqNullSafe(F.col("x_"))]).drop("x_", *[f"{g}_" for g in group])


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "global_rank") -> DataFrame:
    """Rank from 1 over all rows without one task that sees them all: range-sorted partitions, then their offsets.

    The order must be total. The sizes of partitions are one row each.
    """
    parts = df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id())
    from duoscope.runtime import materialize

    parts = materialize(parts, "ranges")
    sizes = parts.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    offsets = sizes.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset_"))
    ranked = parts.withColumn("in_", F.row_number().over(Window.partitionBy("part_").orderBy(*order)))
    return ranked.join(F.broadcast(offsets), "part_").withColumn(name, F.col("in_") + F.col("offset_")).drop("part_", "in_", "offset_")


