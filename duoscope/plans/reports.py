"""What is said of a whole report: errors of its form, families by two opinions, weights by length, excess against the field with its rows accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.functions import scalar as S
from duoscope.operators import windows as W
from duoscope.plans import lens
from duoscope.plans.profiles import _JUDGED, _RESPONSE, responses
from duoscope.plans.registry import query
from duoscope.runtime import discard, materialize

Spark = SparkSession

# format errors

BEHAVIOURS = ("none", "directed_transfer", "soft_play", "coordinated_isolation", "other_coordination")
EVIDENCE = [f"evidence_hand_{k}" for k in range(1, 6)]
NO_EVIDENCE = "NO_EVIDENCE"


def format_errors(solution: DataFrame, report: DataFrame) -> DataFrame:
    """(rule, n) for each rule that a report must keep to be scored: ids once and the solution's own, a number from 0 to 1, a known behaviour, no hand twice.

    All values are texts. Rules on rows are counted in one pass; ids of both sides meet in one aggregate by id.
    """
    risk = F.expr("try_cast(risk_score AS double)")
    hands = F.filter(F.transform(F.array(*EVIDENCE), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "") & (x != NO_EVIDENCE))
    rows = report.agg(
        F.count_if(risk.isNull() | F.isnan(risk)).alias("risk no number"), F.count_if((risk < 0) | ((risk > 1) & ~F.isnan(risk))).alias("risk out of range"),
        F.count_if(~F.coalesce(F.col("predicted_behavior").isin(*BEHAVIOURS), F.lit(False))).alias("unknown behaviour"), F.count_if(F.size(hands) > F.size(F.array_distinct(hands))).alias("repeated evidence"),
    )
    side = lambda df, theirs: df.select("pair_id", F.lit(theirs).alias("theirs"))
    ids = side(solution, 0).unionByName(side(report, 1)).groupBy("pair_id").agg(F.count_if(F.col("theirs") == 0).alias("s"), F.count_if(F.col("theirs") == 1).alias("r"))
    ids = ids.agg(F.count_if((F.col("s") > 0) & (F.col("r") == 0)).alias("missing pair"), F.count_if((F.col("s") == 0) & (F.col("r") > 0)).alias("foreign pair"), F.count_if(F.col("r") > 1).alias("repeated pair"))
    long = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in df.columns])))
    return long(rows).unionByName(long(ids))


_FAULTY = """, rp AS (SELECT CASE WHEN a % 11 = 3 THEN pair_id || 'x' WHEN a % 13 = 5 THEN 'U_repeated' ELSE pair_id END AS pair_id, CASE WHEN (a + b) % 17 = 0 THEN 'high' WHEN (a + b) % 17 = 1 THEN '1.5' ELSE CAST(score AS VARCHAR) END AS risk_score,
 CASE WHEN b % 19 = 2 THEN NULL WHEN b % 19 = 7 THEN 'collusion' ELSE 'soft_play' END AS predicted_behavior, CAST(shared AS VARCHAR) AS e1, CASE WHEN label = 1 THEN ' ' || CAST(shared AS VARCHAR) || ' ' ELSE 'NO_EVIDENCE' END AS e2 FROM pairs)"""


@query(
    "WITH " + lens.PAIRS_SQL + _FAULTY + """, i AS (SELECT pair_id, count(*) AS r FROM rp GROUP BY pair_id) SELECT 'risk no number' AS rule, count(*) AS n FROM rp WHERE try_cast(risk_score AS DOUBLE) IS NULL
 UNION ALL SELECT 'risk out of range', count(*) FROM rp WHERE NOT try_cast(risk_score AS DOUBLE) BETWEEN 0 AND 1 UNION ALL SELECT 'unknown behaviour', count(*) FROM rp WHERE coalesce(predicted_behavior, '') NOT IN ('none', 'directed_transfer', 'soft_play', 'coordinated_isolation', 'other_coordination')
 UNION ALL SELECT 'repeated evidence', count(*) FROM rp WHERE trim(e2) = e1 UNION ALL SELECT 'missing pair', count(*) FROM pairs WHERE pair_id NOT IN (SELECT pair_id FROM i) UNION ALL SELECT 'foreign pair', count(*) FROM i WHERE pair_id NOT IN (SELECT pair_id FROM pairs)
 UNION ALL SELECT 'repeated pair', count(*) FROM i WHERE r > 1"""
)
def mt04_format_errors(spark: Spark, sf: str) -> DataFrame:
    """Counts of each error of form in a report over all pairs that breaks each rule in some rows."""
    p = lens.pairs(spark, sf)
    k, m, shared = (F.col("a") + F.col("b")) % 17, F.col("b") % 19, F.col("shared").cast("string")
    report = p.select(
        F.when(F.col("a") % 11 == 3, F.concat("pair_id", F.lit("x"))).when(F.col("a") % 13 == 5, "U_repeated").otherwise(F.col("pair_id")).alias("pair_id"),
        F.when(k == 0, "high").when(k == 1, "1.5").otherwise(F.col("score").cast("string")).alias("risk_score"), F.when(m == 2, F.lit(None)).when(m == 7, "collusion").otherwise("soft_play").alias("predicted_behavior"),
        shared.alias(EVIDENCE[0]), F.when(F.col("label") == 1, F.concat(F.lit(" "), shared, F.lit(" "))).otherwise(NO_EVIDENCE).alias(EVIDENCE[1]), *[F.lit(None).cast("string").alias(c) for c in EVIDENCE[2:]],
    )
    return format_errors(p.select("pair_id"), report)


# a family by two opinions

FAMILIES = ("directed_transfer", "soft_play", "coordinated_isolation")


def blended(tops: dict[str, Column], chances: dict[str, Column]) -> dict[str, Column]:
    """Half the classifier's probabilities, half the tops' shares of their sum (each at least a millionth; a null counts as 0)."""
    raised = {f: F.greatest(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(1e-6)) for f, x in tops.items()}
    total = sum(list(raised.values())[1:], raised[FAMILIES[0]])
    return {f: 0.5 * chances[f] + 0.5 * (raised[f] / total) for f in FAMILIES}


_BLEND = " + ".join(f"greatest(top_{f}, 1e-6)" for f in FAMILIES)


@query(
    "WITH " + lens.SCORES_SQL + ", k AS (SELECT *, " + ", ".join(f"row_number() OVER (PARTITION BY pair_id ORDER BY s_{f} DESC, hand) AS k_{f}" for f in FAMILIES) + " FROM hand_scores), t AS (SELECT pair_id, "
    + ", ".join(f"CAST(sum(CAST(round(s_{f} * 1e9) AS BIGINT)) FILTER (k_{f} <= 3) AS BIGINT) / 1e9 / least(count(*), 3) AS top_{f}, CAST(count(*) FILTER (s_{f} > 0.5) AS BIGINT) + 1 AS over_{f}" for f in FAMILIES) + " FROM k GROUP BY pair_id), c AS (SELECT *, "
    + ", ".join(f"over_{f} / ({' + '.join(f'over_{g}' for g in FAMILIES)}) AS p_{f}" for f in FAMILIES) + " FROM t), m AS (SELECT pair_id, " + ", ".join(f"0.5 * p_{f} + 0.5 * (greatest(top_{f}, 1e-6) / ({_BLEND})) AS m_{f}, top_{f}" for f in FAMILIES)
    + " FROM c) SELECT pair_id, CASE greatest(" + ", ".join(f"m_{f}" for f in FAMILIES) + ") " + " ".join(f"WHEN m_{f} THEN '{f}'" for f in FAMILIES) + " END AS family, CASE greatest(" + ", ".join(f"top_{f}" for f in FAMILIES) + ") " + " ".join(f"WHEN top_{f} THEN '{f}'" for f in FAMILIES)
    + " END AS family_by_top, greatest(" + ", ".join(f"m_{f}" for f in FAMILIES) + ") AS confidence FROM m"
)
def q33_blended_family(spark: Spark, sf: str) -> DataFrame:
    """The family by the blend beside that by the three best hands alone. The classifier here gives shares of hands over a half (one added); any other's columns can stand there."""
    s = lens.hand_scores(spark, sf).select("pair_id", "hand", *[F.col(f"s_{f}").alias(f) for f in FAMILIES])
    t = s.withColumns({f"k_{f}": F.row_number().over(W.ordered(["pair_id"], [F.desc(f), "hand"])) for f in FAMILIES})
    top = lambda f: F.sum(F.when(F.col(f"k_{f}") <= 3, F.round(F.col(f) * 1e9).cast("long"))) / 1e9 / F.least(F.count(F.lit(1)), F.lit(3))
    t = t.groupBy("pair_id").agg(*[top(f).alias(f"top_{f}") for f in FAMILIES], *[(F.count_if(F.col(f) > 0.5) + 1).alias(f"over_{f}") for f in FAMILIES])
    total = sum((F.col(f"over_{f}") for f in FAMILIES[1:]), F.col(f"over_{FAMILIES[0]}"))
    m = blended({f: F.col(f"top_{f}") for f in FAMILIES}, {f: F.col(f"over_{f}") / total for f in FAMILIES})
    t = t.withColumns({f"m_{f}": x for f, x in m.items()})
    best = lambda c: S.arg_max({f: F.col(f"{c}_{f}") for f in FAMILIES})
    return t.select("pair_id", best("m").alias("family"), best("top").alias("family_by_top"), F.greatest(*[f"m_{f}" for f in FAMILIES]).alias("confidence"))


# weights that give one population the lengths of another

EDGES = (1, 2, 3, 4, 6, 9, 13)


def length_weights(rows: DataFrame, length: str, target: Column, edges: tuple[int, ...] = EDGES, least: float = 0.25, most: float = 4.0) -> DataFrame:
    """Adds len_w to rows outside the target: the target's share of rows in the row's bin of length over its own population's share, kept in [least, most]. A row a bin is broadcast."""
    k = sum((F.when(F.col(length) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    t = rows.withColumns({"bin_": k, "target_": target})
    bins = t.groupBy("bin_").agg(F.count_if("target_").alias("t_"), F.count_if(~F.col("target_")).alias("o_"))
    share = bins.agg(F.sum("t_").alias("all_t"), F.sum("o_").alias("all_o"))
    ratio = (F.col("t_") / F.col("all_t")) / (F.col("o_") / F.col("all_o"))
    w = bins.join(F.broadcast(share)).select("bin_", F.greatest(F.least(ratio, F.lit(most)), F.lit(least)).alias("len_w"))
    return t.filter(~F.col("target_")).join(F.broadcast(w), "bin_").drop("bin_", "target_")


@query(
    "WITH " + lens.PAIR_HANDS_SQL + ", p AS (SELECT phase, a, b, count(*) AS shared, " + " + ".join(f"CAST(count(*) >= {e} AS INTEGER)" for e in EDGES) + """ AS bin FROM pair_hands GROUP BY phase, a, b),
 h AS (SELECT bin, count(*) FILTER (phase = 'evaluation') / (SELECT count(*) FROM p WHERE phase = 'evaluation') AS e, count(*) FILTER (phase = 'development') / (SELECT count(*) FROM p WHERE phase = 'development') AS d FROM p GROUP BY bin)
 SELECT a, b, shared, least(greatest(e / d, 0.25), 4.0) AS len_w FROM p JOIN h USING (bin) WHERE phase = 'development'"""
)
def md06_length_weights(spark: Spark, sf: str) -> DataFrame:
    """Development pairs weighted so that their lengths of history are spread as those of evaluation pairs are."""
    p = lens.pair_hands(spark, sf).groupBy("phase", "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return length_weights(p, "shared", F.col("phase") == "evaluation").select("a", "b", "shared", "len_w")


# excess against the field by pair and hand, with its rows accounted for


_EXCESS = (
    "WITH " + lens.ACTS_SQL + ", " + lens.HANDS_SQL + _JUDGED + _RESPONSE + """, e AS (SELECT hand, phase, responder, aggressor, rsurp_sum AS nll, rsurp_max AS most, CAST(sum(rsurp_sum) OVER w AS BIGINT) AS t, count(*) OVER w AS n FROM rsp JOIN hands USING (hand) WINDOW w AS (PARTITION BY phase, responder)),
 x AS (SELECT *, nll / 1e6 - CASE WHEN n > 1 THEN (t - nll) / 1e6 / (n - 1) ELSE 0.0 END AS excess FROM e)"""
)


def excess_rows(spark: Spark, sf: str) -> DataFrame:
    """(phase, hand, responder, aggressor): nll, greatest single one and excess over the responder's mean in its other answers of the phase (0 where there is none)."""
    t = responses(spark, sf).join(lens.hands(spark, sf).select("hand", "phase"), "hand")
    total = t.groupBy("phase", "responder").agg(F.sum("rsurp_sum").alias("t_"), F.count(F.lit(1)).alias("n_"))
    other = F.when(F.col("n_") > 1, (F.col("t_") - F.col("rsurp_sum")) / 1e6 / (F.col("n_") - 1)).otherwise(0.0)
    return t.join(total, ["phase", "responder"]).select("phase", "hand", "responder", "aggressor", (F.col("rsurp_sum") / 1e6).alias("nll"), (F.col("rsurp_max") / 1e6).alias("nll_max"), (F.col("rsurp_sum") / 1e6 - other).alias("excess"))


@query(_EXCESS + " SELECT phase, hand, responder, aggressor, nll / 1e6 AS nll, most / 1e6 AS nll_max, excess FROM x")
def q45_hand_excess(spark: Spark, sf: str) -> DataFrame:
    """The excess at the grain of a hand and an ordered pair."""
    return excess_rows(spark, sf)


@query(_EXCESS + " SELECT phase, count(*) AS rows_written, count(*) AS rows_expected, CAST(0 AS BIGINT) AS diff, TRUE AS ok, count(DISTINCT (responder, aggressor)) AS n_pairs FROM x GROUP BY phase")
def q45_row_counts(spark: Spark, sf: str) -> DataFrame:
    """The excess written by phase and read back, its rows held against the answers that the acts alone announce; ok is false for a phase that differs."""
    written = materialize(excess_rows(spark, sf), "excess")
    announced = lens.responses(spark, sf).select("phase", "hand", "actor", "aggressor").distinct().groupBy("phase").agg(F.count(F.lit(1)).alias("rows_expected"))
    found = written.groupBy("phase").agg(F.count(F.lit(1)).alias("rows_written"), F.countDistinct("responder", "aggressor").alias("n_pairs"))
    n = lambda c: F.coalesce(c, F.lit(0))
    t = announced.join(found, "phase", "full").select("phase", n("rows_written").alias("rows_written"), n("rows_expected").alias("rows_expected"), (n("rows_written") - n("rows_expected")).alias("diff"), n("n_pairs").alias("n_pairs"))
    out = materialize(t.withColumn("ok", F.col("diff") == 0), "row_counts")
    discard(written)
    return out
