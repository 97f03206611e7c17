"""Decisions with all that was public or the decider's own before them, and what is left of a raise's size when that is known.

A hand's acts stay in one partitioning; a decision meets no other act, since all state before it is a frame over its hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duoscope.operators import boosting as B
from duoscope.operators import windows as W
from duoscope.plans import lens
from duoscope.plans.pairhands import MONEY, exact_mean, flag
from duoscope.plans.pairtable import exact_mean as exact_mean_sql
from duoscope.plans.pairtable import nearest
from duoscope.plans.profiles import _strength_sql, seats, strength
from duoscope.plans.registry import query

Spark = SparkSession
HABITS = ("b_vpip", "b_agg_rate", "b_fold_facing", "b_call_facing", "b_raise_facing", "b_contrib")
FEATURES = ("street", "place", "players_active", "to_call", "pot_before", "pot_odds", "stack", "spr", "invested", "raises_before", "facing", "chen", "strength", *HABITS)
_DEPTH = 5


def states(spark: Spark, sf: str) -> DataFrame:
    """hand, no, actor, act, amount and FEATURES. The stack before an act is five times the hand's whole amount less what the actor has put in; strengths are null on the first street."""
    whole, own = Window.partitionBy("hand"), W.before(["hand", "actor"], ["no"])
    money, zero, act = F.col("amount").cast(MONEY), F.lit(0).cast(MONEY), F.col("act")
    raiser = F.when(act == "raise", F.col("actor"))
    before = W.before(["hand"], ["no"])
    t = lens.acts(spark, sf).withColumns({
        "no": F.col("no").cast("long"), "money": money, "street": F.least("no", F.lit(3)), "held": F.first("part").over(W.ordered(["hand", "actor"], ["no"])), "last_": F.last(raiser, ignorenulls=True).over(before),
        "pot_": F.coalesce(F.sum(money).over(before), zero), "in_": F.coalesce(F.sum(money).over(own), zero), "all_": F.sum(money).over(whole), "raises_before": F.coalesce(F.sum(flag(act == "raise")).over(before), F.lit(0)),
        "first_fold": F.coalesce(F.max(flag(act == "fold")).over(own), F.lit(0)), "place": F.min("no").over(Window.partitionBy("hand", "actor")), "entry": flag(F.row_number().over(W.ordered(["hand", "actor"], ["no"])) == 1),
    })
    t = t.withColumns({"gone": F.coalesce(F.sum(F.when((F.col("first_fold") == 0) & (act == "fold"), 1)).over(before), F.lit(0)), "seats": F.sum("entry").over(whole), "facing": flag(F.col("last_") != F.col("actor"))})
    pot, stack = F.col("pot_").cast("double"), (F.col("all_") * _DEPTH - F.col("in_")).cast("double")
    t = t.select(
        "hand", "no", "actor", "act", "amount", F.col("street").cast("long").alias("street"), F.col("place").cast("long").alias("place"), (F.col("seats") - F.col("gone")).cast("long").alias("players_active"), F.col("amount").alias("to_call"), pot.alias("pot_before"),
        (F.col("amount") / (pot + F.col("amount") + 1e-3)).alias("pot_odds"), stack.alias("stack"), F.least(stack / (pot + 1e-3), F.lit(200.0)).alias("spr"), F.col("in_").cast("double").alias("invested"), "raises_before", "facing",
        (F.col("held") % 21 - 1).alias("chen"), F.when(F.col("street") > 0, strength(F.col("street"), F.col("held"), F.col("actor"))).alias("strength"),
    )
    return t.join(habits(t), "actor")


def habits(t: DataFrame) -> DataFrame:
    """An actor's means over all its hands: how often it enters, raises, and answers raises each way, and what it puts in."""
    met = lambda k: F.count_if((F.col("facing") == 1) & (F.col("act") == k)) / F.greatest(F.sum("facing"), F.lit(1))
    hand = t.groupBy("hand", "actor").agg(F.max(flag(F.col("act") != "fold")).alias("vpip"), F.sum(F.col("amount").cast(MONEY)).cast("double").alias("contrib"))
    rates = t.groupBy("actor").agg((F.count_if(F.col("act") == "raise") / F.count(F.lit(1))).alias("b_agg_rate"), met("fold").alias("b_fold_facing"), met("call").alias("b_call_facing"), met("raise").alias("b_raise_facing"))
    return rates.join(hand.groupBy("actor").agg((F.sum("vpip") / F.count(F.lit(1))).alias("b_vpip"), exact_mean(F.col("contrib"), 2).alias("b_contrib")), "actor")


_W = "OVER (PARTITION BY hand ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_OWN = _W.replace("PARTITION BY hand", "PARTITION BY hand, actor")
_MET = "count(*) FILTER (facing = 1 AND act = '{0}') / greatest(sum(facing), 1) AS b_{0}_facing"
_STATES = (
    "WITH " + lens.ACTS_SQL + f""", m AS (SELECT *, CAST(amount AS DECIMAL(18, 2)) AS money FROM acts), si AS (SELECT hand, actor, min(no) AS place, min_by(part, no) AS held, min(CASE WHEN act = 'fold' THEN no END) AS fold_no, sum(money) AS put, max(CASE WHEN act <> 'fold' THEN 1 ELSE 0 END) AS vpip FROM m GROUP BY hand, actor),
 ac AS (SELECT m.hand, m.no, count(*) AS players_active FROM m JOIN si ON si.hand = m.hand AND (fold_no IS NULL OR fold_no >= m.no) GROUP BY m.hand, m.no), al AS (SELECT hand, sum(money) AS total FROM m GROUP BY hand),
 b1 AS (SELECT *, least(no, 3) AS street, {nearest(f'coalesce(sum(money) {_W}, 0)')} AS pot, coalesce(sum(money) {_OWN}, 0) AS inv, count(*) FILTER (act = 'raise') {_W} AS raises_before, last_value(CASE WHEN act = 'raise' THEN actor END IGNORE NULLS) {_W} AS raiser FROM m),
 b2 AS (SELECT b1.hand, b1.no, b1.actor, act, amount, CAST(street AS BIGINT) AS street, CAST(place AS BIGINT) AS place, coalesce(players_active, 0) AS players_active, pot, inv, {nearest(f'total * {_DEPTH} - inv')} AS stack, raises_before, CASE WHEN raiser <> b1.actor THEN 1 ELSE 0 END AS facing, held
  FROM b1 JOIN si ON si.hand = b1.hand AND si.actor = b1.actor LEFT JOIN ac ON ac.hand = b1.hand AND ac.no = b1.no JOIN al ON al.hand = b1.hand),
 h1 AS (SELECT actor, count(*) FILTER (act = 'raise') / count(*) AS b_agg_rate, {', '.join(_MET.format(k) for k in ('fold', 'call', 'raise'))} FROM b2 GROUP BY actor), h2 AS (SELECT actor, sum(vpip) / count(*) AS b_vpip, {exact_mean_sql(nearest('put'), 2)} AS b_contrib FROM si GROUP BY actor)"""
)


@query(
    _STATES + " SELECT b2.hand, b2.no, b2.actor, act, street, place, players_active, amount AS to_call, pot AS pot_before, amount / (pot + amount + 1e-3) AS pot_odds, stack, least(stack / (pot + 1e-3), 200.0) AS spr, " + nearest("inv") + " AS invested, raises_before, facing, held % 21 - 1 AS chen, CASE WHEN street > 0 THEN "
    + _strength_sql("held", "b2.actor") + " END AS strength, " + ", ".join(HABITS) + ", CASE act WHEN 'fold' THEN 0 WHEN 'call' THEN 2 ELSE 3 END AS y FROM b2 JOIN h1 ON h1.actor = b2.actor JOIN h2 ON h2.actor = b2.actor"
)
def q07_decision_features(spark: Spark, sf: str) -> DataFrame:
    """All a policy is fitted on: the public state before a decision, the decider's own cards and stake, its habits, and the class taken."""
    y = F.when(F.col("act") == "fold", 0).when(F.col("act") == "call", 2).otherwise(3)
    return states(spark, sf).select("hand", "no", "actor", "act", *FEATURES, y.alias("y"))


# sizes of raises by who else is in


def presence_residual(residuals: DataFrame, who: DataFrame) -> DataFrame:
    """(phase, a, b): what is left of each side's sizes (residual, in millionths) when the other is in against when it is out, both ways folded into one row.

    A raise meets the other seats of its hand. Directions are two rows of the pair's aggregate, not a join; a pair counts if both of its sides raised before the other.
    """
    other = who.select("hand", F.col("actor").alias("other"), "phase", "vpip")
    in_ = F.col("vpip") == 1
    total = lambda c: F.sum(F.when(c, F.col("residual")))
    d = residuals.join(other, "hand").filter("actor <> other").groupBy("phase", "actor", "other").agg(
        (total(in_) / 1e6 / F.count_if(in_)).alias("with_"), (total(~in_) / 1e6 / F.count_if(~in_)).alias("out_"), F.count_if(in_).alias("n_"), (F.max(F.when(in_, F.col("residual"))) / 1e6).alias("most_"))
    d = d.withColumn("d_", F.coalesce("with_", F.lit(0.0)) - F.coalesce("out_", F.lit(0.0)))
    ends = lambda c: (F.min(c).alias(f"{c}min"), F.max(c).alias(f"{c}max"))
    low = F.col("actor") < F.col("other")
    t = d.groupBy("phase", F.least("actor", "other").alias("a"), F.greatest("actor", "other").alias("b")).agg(
        F.count(F.lit(1)).alias("ways"), *ends("d_"), *ends("with_"), F.max("most_").alias("most"), F.min("n_").alias("n"), F.max(F.when(low, F.col("d_"))).alias("x"), F.max(F.when(~low, F.col("d_"))).alias("y"))
    return t.filter("ways = 2").select(
        "phase", "a", "b", F.col("d_min").alias("bs_d_min"), F.col("d_max").alias("bs_d_max"), (F.col("x") + F.col("y")).alias("bs_d_sum"), F.abs(F.col("x") - F.col("y")).alias("bs_d_asym"),
        *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in (("with_min", "bs_with_min"), ("with_max", "bs_with_max"), ("most", "bs_with_peak"))], F.col("n").alias("bs_n_min"))


def sizes(t: DataFrame) -> DataFrame:
    """Raises before a pot with size_: the log of one plus the raise over the pot."""
    return t.filter("act = 'raise' and pot_before > 0").withColumn("size_", F.log1p(F.col("amount") / F.col("pot_before")))


_D = "CAST(sum(residual) FILTER ({0}) AS BIGINT) / 1e6 / count(*) FILTER ({0})"


@query(
    _STATES + """, sz AS (SELECT b2.*, ln(1 + amount / pot) AS size_ FROM b2 WHERE act = 'raise' AND pot > 0), mn AS (SELECT actor, CAST(sum(CAST(round(size_ * 1e6) AS BIGINT)) AS BIGINT) / count(*) AS mean FROM sz GROUP BY actor),
 rs AS (SELECT hand, sz.actor, CAST(round(round(size_ * 1e6) - mean) AS BIGINT) AS residual FROM sz JOIN mn USING (actor)), """ + lens.HANDS_SQL
    + f""", d1 AS (SELECT phase, rs.actor, si.actor AS other, {_D.format('vpip = 1')} AS with_, {_D.format('vpip = 0')} AS out_, count(*) FILTER (vpip = 1) AS n, max(residual) FILTER (vpip = 1) / 1e6 AS most FROM rs JOIN si ON si.hand = rs.hand AND si.actor <> rs.actor JOIN hands ON hands.hand = rs.hand GROUP BY ALL),
 d AS (SELECT *, coalesce(with_, 0.0) - coalesce(out_, 0.0) AS d FROM d1) SELECT x.phase, x.actor AS a, x.other AS b, least(x.d, y.d) AS bs_d_min, greatest(x.d, y.d) AS bs_d_max, x.d + y.d AS bs_d_sum, abs(x.d - y.d) AS bs_d_asym, coalesce(least(x.with_, y.with_), 0.0) AS bs_with_min, coalesce(greatest(x.with_, y.with_), 0.0) AS bs_with_max,
 coalesce(greatest(x.most, y.most), 0.0) AS bs_with_peak, least(x.n, y.n) AS bs_n_min FROM d x JOIN d y ON y.phase = x.phase AND y.actor = x.other AND y.other = x.actor AND x.actor < x.other"""
)
def q10_mean_residual(spark: Spark, sf: str) -> DataFrame:
    """Residuals of log sizes against the raiser's own mean, by who else is in."""
    t = sizes(states(spark, sf)).select("hand", "actor", F.round(F.col("size_") * 1e6).cast("long").alias("x"))
    mean = t.groupBy("actor").agg((F.sum("x") / F.count(F.lit(1))).alias("mean"))
    return presence_residual(t.join(mean, "actor").select("hand", "actor", F.round(F.col("x") - F.col("mean")).cast("long").alias("residual")), seats(spark, sf))


@query()
def q10_fitted_residual(spark: Spark, sf: str) -> DataFrame:
    """The same against boosted trees on the decision's state, fitted on the half of the hands that the raise is not of."""
    t = sizes(states(spark, sf)).withColumn("g_", F.col("hand").cast("string"))
    scored = B.cross_fit(t.select("hand", "actor", "g_", "size_", *FEATURES), list(FEATURES), "size_", "g_", B.Settings("squared", rounds=3, leaves=63, rate=0.3), folds=2)
    return presence_residual(scored.select("hand", "actor", F.round((F.col("size_") - F.col("score")) * 1e6).cast("long").alias("residual")), seats(spark, sf))
