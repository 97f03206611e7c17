"""Ranking metrics. Orders are total: score descending, then id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscope.operators.windows import global_rank, running_total, running_totals


def average_precision(df: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """One row: ap, the mean over positives of precision at their rank. Ranks come from range-sorted partitions, twice: of all rows and of positives."""
    ranked = global_rank(df.select(key, F.col(score).alias("s_"), F.col(label).alias("y_")), [F.col("s_").desc(), F.col(key).asc()], "rank")
    hits = global_rank(ranked.filter("y_ = 1"), [F.col("rank").asc()], "hit")
    return hits.agg(F.coalesce(F.avg(F.col("hit") / F.col("rank")), F.lit(0.0)).alias("ap"))


def rank_sums(df: DataFrame, score: str) -> DataFrame:
    """(score, k rows, average rank): ranks of distinct values from running counts over range-sorted values."""
    values = df.groupBy(F.col(score).alias("v_")).agg(F.count(F.lit(1)).alias("k_"))
    return running_total(values, "k_", [F.col("v_").asc()], "upto_").select("v_", "k_", (F.col("upto_") - (F.col("k_") - 1) / 2).alias("rank_"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by average ranks (Mann and Whitney); null without both classes."""
    r = df.join(rank_sums(df, score), df[score] == F.col("v_"))
    y, n1 = F.col(label) == 1, F.count_if(F.col(label) == 1)
    n0 = F.count_if(F.col(label) == 0)
    return r.agg(F.try_divide(F.sum(F.when(y, F.col("rank_"))) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ra, rb = (rank_sums(df, c).select(F.col("v_").alias(f"{c}_v"), F.col("rank_").alias(f"{c}_r")) for c in (a, b))
    both = df.join(ra, df[a] == F.col(f"{a}_v")).join(rb, df[b] == F.col(f"{b}_v"))
    return both.agg(F.corr(f"{a}_r", f"{b}_r").alias("rho"))


def group_auc(df: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """AUC within each group that has both classes, by average ranks."""
    from duoscope.operators.windows import average_rank

    r = df.withColumn("r_", average_rank(F.col(score), [group]))
    n1, n0 = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return r.groupBy(group).agg(F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("r_"))) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc")).filter("auc is not null")


def map_at(df: DataFrame, k: int, group: str, order: list, label: str) -> DataFrame:
    """Per group with positives: sum of precision at hits among the first k over min(positives, k)."""
    w = Window.partitionBy(group).orderBy(*order)
    r = df.withColumns({"r_": F.row_number().over(w), "h_": F.sum(label).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    hit = F.when((F.col("r_") <= k) & (F.col(label) == 1), F.col("h_") / F.col("r_"))
    return r.groupBy(group).agg(F.try_divide(F.coalesce(F.sum(hit), F.lit(0.0)), F.least(F.sum(label), F.lit(k)).cast("double")).alias("ap")).filter("ap is not null")


def composite(risk: Column, behaviour: Column, evidence: Column) -> Column:
    return 0.70 * risk + 0.20 * behaviour + 0.10 * evidence


def table_bootstrap(sums: DataFrame, table: str, total: str, count: str, resamples: int) -> DataFrame:
    """One row: delta (the mean), low and high (its 5 and 95 % points over resampled tables). sums has one row a table; draws follow a rule on their numbers."""
    t = global_rank(sums.select(table, total, count), [F.col(table).asc()], "k_").withColumn("k_", F.col("k_") - 1)
    n = sums.count()
    b, i = F.col("b"), F.col("i")
    spark = sums.sparkSession
    draws = spark.range(resamples).select(F.col("id").alias("b")).select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long"))).alias("i"))
    place = (b * 7919 + i * 104729 + b * i * 31 + (b * b) % 97) % 10007 % max(n, 1)
    means = draws.select("b", place.alias("k_")).join(t, "k_").groupBy("b").agg((F.sum(total) / F.sum(count)).alias("mean"))  # a number a resample
    points = means.agg(F.percentile("mean", F.array(F.lit(0.05), F.lit(0.95))).alias("p"))
    return sums.agg((F.sum(total) / F.sum(count)).alias("delta")).crossJoin(F.broadcast(points)).select("delta", F.get("p", 0).alias("low"), F.get("p", 1).alias("high"))


def touching(pairs: DataFrame, label: str) -> DataFrame:
    """pairs (a, b and what else) with touch: whether a player of theirs is in a positive pair."""
    players = pairs.filter(F.col(label) == 1).select(F.explode(F.array("a", "b")).alias("p")).distinct()
    side = lambda c: players.select(F.col("p").alias(c), F.lit(1).alias(f"t{c}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("touch", F.col("ta").isNotNull() | F.col("tb").isNotNull()).drop("ta", "tb")


def mirror(pairs: DataFrame, score: str, label: str, key: str, top: int, wide: int) -> DataFrame:
    """One row: ap, ap_mirror (without pairs that share a player with a positive one), how many are left out, and ranks of positives; pairs is touching() with label (below 0: unknown).

    One range sort ranks the pairs and, by running counts, those that are not left out; only positives are ranked again, for their hits.
    """
    y = F.col("y_") == 1
    t = pairs.select(key, score, F.col(label).alias("y_"), "label", "touch").withColumns({"one_": F.lit(1).cast("long"), "in_world_": (y | ~F.col("touch")).cast("long")})
    rows = running_totals(t, {"one_": "r", "in_world_": "wr"}, [F.col(score).desc(), F.col(key).asc()])
    whole = rows.agg(
        F.count_if((F.col("y_") == 0) & F.col("touch")).alias("excluded"), F.count_if(y & (F.col("r") > top)).alias(f"over_{top}"),
        F.count_if((F.col("r") <= wide) & (F.col("label") < 0)).alias(f"unknown_{wide}"),
    )
    hits = global_rank(rows.filter(y).select("r", "wr"), [F.col("r").asc()], "hit")  # positives are all in both, in the same order
    mean = lambda c: F.round(F.coalesce(F.avg(F.col("hit") / F.col(c)), F.lit(0.0)), 8)
    odd = 2 * F.col("hit") - F.col("n_")
    middle = lambda c: F.avg(F.when(odd.between(0, 2), F.col(c)))  # noqa: E731  no buffer holds the positives
    counted = hits.crossJoin(F.broadcast(hits.agg(F.count(F.lit(1)).alias("n_"))))
    ap = counted.agg(mean("r").alias("ap"), mean("wr").alias("ap_mirror"), middle("r").alias("median_rank"), middle("wr").alias("mirror_median_rank"))
    out = ap.crossJoin(F.broadcast(whole))
    return out.select("ap", "ap_mirror", "excluded", "median_rank", f"over_{top}", f"unknown_{wide}", "mirror_median_rank")
