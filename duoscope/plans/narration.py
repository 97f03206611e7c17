"""What happened before a decision, told street by street, and the prompts made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.operators.windows import before
from duoscope.plans import lens
from duoscope.plans.registry import query

Spark = SparkSession
STREETS = ("Preflop", "Flop", "Turn", "River")


def told(acts: DataFrame) -> DataFrame:
    """acts (hand, no, actor, act, size) with street and history: earlier acts by street, with amounts; empty before the first one.

    A decision's text is put together from the acts' fragments, each made once; it is as long as what it tells.
    """
    size = F.col("size").cast("long").cast("string")
    verb = F.when(F.col("act") == "raise", F.concat(F.lit("raises to "), size)).when(F.col("act") == "call", F.concat(F.lit("calls "), size)).otherwise("folds")
    t = acts.withColumn("street", F.least("no", F.lit(3)).cast("int")).withColumn("told_", F.struct("street", F.concat(F.lit("player "), F.col("actor").cast("string"), F.lit(" "), verb).alias("text")))
    t = t.withColumn("told_", F.collect_list("told_").over(before(["hand"], ["no"])))

    def street(k: int) -> Column:
        own = F.transform(F.filter("told_", lambda x: x["street"] == k), lambda x: x["text"])
        return F.when(F.size(own) > 0, F.concat(F.lit(f"{STREETS[k]}: "), F.array_join(own, "; "), F.lit(".")))

    return t.withColumn("history", F.concat_ws(" ", *[street(k) for k in range(4)])).drop("told_")


_W = "OVER (PARTITION BY hand ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_TOLD = (
    ", f AS (SELECT *, least(no, 3) AS street, 'player ' || CAST(actor AS VARCHAR) || CASE act WHEN 'raise' THEN ' raises to ' || CAST(CAST(floor(size) AS BIGINT) AS VARCHAR) WHEN 'call' THEN ' calls ' || CAST(CAST(floor(size) AS BIGINT) AS VARCHAR) ELSE ' folds' END AS x FROM acts), h AS (SELECT *, "
    + ", ".join(f"string_agg(x, '; ') FILTER (street = {k}) {_W} AS s{k}" for k in range(4)) + " FROM f), told AS (SELECT *, concat_ws(' ', " + ", ".join(f"'{n}: ' || s{k} || '.'" for k, n in enumerate(STREETS)) + ") AS history FROM h)"
)


@query("WITH " + lens.ACTS_SQL + _TOLD + " SELECT hand, no, actor, history FROM told")
def st24_street_narration(spark: Spark, sf: str) -> DataFrame:
    return told(lens.acts(spark, sf)).select("hand", F.col("no").cast("long").alias("no"), "actor", "history")



@query(
    "WITH " + lens.PAIRS_SQL + _TOLD + """, w AS (SELECT DISTINCT p.hand, unnest([p.a, p.b]) AS actor FROM pair_hands p JOIN pairs q ON q.a = p.a AND q.b = p.b AND q.label = 1),
 pt AS (SELECT hand, no, CAST(coalesce(sum(CAST(amount AS DECIMAL(18, 2))) """ + _W + """, 0) AS BIGINT) AS pot FROM acts)
 SELECT t.hand, t.no, concat_ws(' ', nullif(history, ''), 'Pot ' || CAST(pot AS VARCHAR) || '. Player ' || CAST(t.actor AS VARCHAR) || ' to act on the ' || (['preflop', 'flop', 'turn', 'river'])[street + 1] || '.') AS prompt, act AS answer
 FROM told t JOIN w ON w.hand = t.hand AND w.actor = t.actor JOIN pt ON pt.hand = t.hand AND pt.no = t.no"""
)
def q50_decision_prompts(spark: Spark, sf: str) -> DataFrame:
    """A prompt and its answer for each decision of a positive pair's members in their common hands; a decision that several pairs share is written once."""
    pot = F.coalesce(F.sum(F.col("amount").cast("decimal(18, 2)")).over(before(["hand"], ["no"])), F.lit(0))
    positives = lens.pairs(spark, sf).filter("label = 1").select("a", "b")
    wanted = lens.pair_hands(spark, sf).select("hand", "a", "b").join(positives, ["a", "b"]).select("hand", F.explode(F.array("a", "b")).alias("actor"))
    t = told(lens.acts(spark, sf).withColumn("pot", F.round(pot, 0).cast("long"))).join(wanted, ["hand", "actor"], "left_semi")
    where = F.element_at(F.array(*[F.lit(s.lower()) for s in STREETS]), F.col("street") + 1)
    ask = F.concat(F.lit("Pot "), F.col("pot").cast("string"), F.lit(". Player "), F.col("actor").cast("string"), F.lit(" to act on the "), where, F.lit("."))
    return t.select("hand", F.col("no").cast("long").alias("no"), F.concat_ws(" ", F.when(F.col("history") != "", F.col("history")), ask).alias("prompt"), F.col("act").alias("answer"))
