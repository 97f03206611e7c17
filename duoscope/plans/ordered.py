"""Window functions, sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duoscope.operators import pairs as P
from duoscope.operators import windows as W
from duoscope.plans import lens
from duoscope.plans.registry import query
from duoscope.runtime import materialize, read

Spark = SparkSession
_GAP = "epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))"


def events(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "events")


def seconds(c: str):
    return F.unix_micros(F.to_timestamp(c).cast("timestamp")) / 1e6


def gaps(spark: Spark, sf: str) -> DataFrame:
    t = events(spark, sf).select("user_id", "event_id", "ts", "value", seconds("ts").alias("sec"))
    return t.withColumn("gap", F.col("sec") - F.lag("sec").over(W.ordered(["user_id"], ["ts", "event_id"])))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events")
def wn01_position(spark: Spark, sf: str) -> DataFrame:
    return events(spark, sf).select("user_id", "event_id", W.position(["user_id"], ["ts", "event_id"]).cast("long").alias("r"))


@query(f"SELECT event_id, round({_GAP}, 3) AS gap FROM events")
def wn02_diff_previous(spark: Spark, sf: str) -> DataFrame:
    return gaps(spark, sf).select("event_id", F.round("gap", 3).alias("gap"))


@query("SELECT event_id, round(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch(ts), 3) AS gap FROM events")
def wn03_diff_next(spark: Spark, sf: str) -> DataFrame:
    t = events(spark, sf).select("user_id", "event_id", "ts", seconds("ts").alias("sec"))
    return t.select("event_id", F.round(F.lead("sec").over(W.ordered(["user_id"], ["ts", "event_id"])) - F.col("sec"), 3).alias("gap"))


@query(f"SELECT user_id, event_id, CAST(sum(CASE WHEN gap IS NULL OR gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, {_GAP} AS gap FROM events)")
def wn04_sessions(spark: Spark, sf: str) -> DataFrame:
    return gaps(spark, sf).select("user_id", "event_id", W.session(F.col("gap"), 21600, ["user_id"], ["ts", "event_id"]).alias("session"))


@query("WITH " + lens.ACTS_SQL + " SELECT hand, no, round(coalesce(sum(amount) OVER (PARTITION BY hand ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 4) AS before FROM acts")
def wn05_exclusive_sum(spark: Spark, sf: str) -> DataFrame:
    return lens.acts(spark, sf).select("hand", F.col("no").cast("long").alias("no"), F.round(F.coalesce(F.sum("amount").over(W.before(["hand"], ["no"])), F.lit(0.0)), 4).alias("before"))


@query("WITH " + lens.ACTS_SQL + " SELECT hand, no, last_value(CASE WHEN act = 'raise' THEN actor END IGNORE NULLS) OVER (PARTITION BY hand ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS aggressor FROM acts")
def wn06_last_aggressor(spark: Spark, sf: str) -> DataFrame:
    return lens.acts(spark, sf).select("hand", F.col("no").cast("long").alias("no"), W.last_before(F.when(F.col("act") == "raise", F.col("actor")), ["hand"], ["no"]).alias("aggressor"))


_AVG_RANK = "CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {g}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0 END"


def avg_rank_sql(x: str, g: str) -> str:
    return _AVG_RANK.format(x=x, g=g)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(({avg_rank_sql('l_quantity', 'l_suppkey')}) / count(*) OVER (PARTITION BY l_suppkey), 6) AS pct FROM lineitem")
def wn07_percentile(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(W.percentile_rank(F.col("l_quantity"), ["l_suppkey"]), 6).alias("pct"))


@query("WITH " + lens.SCORES_SQL + f" SELECT pair_id, hand, (({avg_rank_sql('s_gen', 'pair_id')}) + 5 * ({avg_rank_sql('s_gen', 'tbl')}) / count(s_gen) OVER (PARTITION BY tbl)) / (count(s_gen) OVER (PARTITION BY pair_id) + 5) AS pct FROM hand_scores")
def wn08_shrunk_percentile(spark: Spark, sf: str) -> DataFrame:
    """A pair's hands are few and ranked in a window; a table's are many and ranked by counts of equal scores."""
    t = W.counted_rank(lens.hand_scores(spark, sf).select("a", "b", "hand", "s_gen", "tbl"), "s_gen", ["tbl"])
    n = F.count("s_gen").over(Window.partitionBy("a", "b"))
    return t.select(lens.pair_id().alias("pair_id"), "hand", ((W.average_rank(F.col("s_gen"), ["a", "b"]) + 5.0 * F.col("rank_") / F.col("n_")) / (n + 5.0)).alias("pct"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders")
def wn09_ordinal_descending(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(W.ordered(["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"])).cast("long").alias("r"))


@query("WITH " + lens.PAIRS_SQL + " SELECT pair_id, round((row_number() OVER (ORDER BY score, pair_id) - 0.5) / count(*) OVER (), 9) AS u FROM pairs")
def wn10_unit_rank(spark: Spark, sf: str) -> DataFrame:
    """A global rank from range-sorted partitions; no task sees all pairs."""
    p = lens.pairs(spark, sf).select("pair_id", "score")
    ranked = W.global_rank(p, [F.col("score").asc(), F.col("pair_id").asc()])
    n = ranked.agg(F.count(F.lit(1)).alias("n_"))
    return ranked.join(F.broadcast(n)).select("pair_id", F.round((F.col("global_rank") - 0.5) / F.col("n_"), 9).alias("u"))


@query("WITH " + lens.PAIRS_SQL + " SELECT pair_id, round(((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER () + (rank() OVER (ORDER BY shared) + (count(*) OVER (PARTITION BY shared) - 1) / 2.0) / count(*) OVER ()) / 2, 9) AS r FROM pairs")
def wn11_rank_average(spark: Spark, sf: str) -> DataFrame:
    """Two models' average ranks over all pairs: ranks of distinct values from their counts."""
    p = lens.pairs(spark, sf).select("pair_id", "score", "shared")

    def ranks(c: str) -> DataFrame:
        v = W.global_rank(p.groupBy(c).agg(F.count(F.lit(1)).alias("k")), [F.col(c).asc()], "pos")
        return v.select(c, (F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("pos")) - (F.col("k") - 1) / 2).alias(f"r_{c}"))

    n = p.agg(F.count(F.lit(1)).alias("n_"))
    return p.join(ranks("score"), "score").join(ranks("shared"), "shared").join(F.broadcast(n)).select("pair_id", F.round((F.col("r_score") / F.col("n_") + F.col("r_shared") / F.col("n_")) / 2, 9).alias("r"))


@query("WITH " + lens.HANDS_SQL + " SELECT hand, CAST((row_number() OVER (PARTITION BY cust, phase ORDER BY started, hand) - 1) * 5 // count(*) OVER (PARTITION BY cust, phase) AS INTEGER) AS q5 FROM hands")
def wn12_quintile(spark: Spark, sf: str) -> DataFrame:
    return lens.hands(spark, sf).select("hand", W.quintile(["cust", "phase"], ["started", "hand"]).alias("q5"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(((l_partkey % 100) - 20) * 5 // 60 AS BIGINT) AS q FROM lineitem WHERE l_partkey % 100 >= 20 AND l_partkey % 100 < 80")
def wn13_window_quintile(spark: Spark, sf: str) -> DataFrame:
    t = F.col("l_partkey") % 100
    return read(spark, sf, "lineitem").filter((t >= 20) & (t < 80)).select("l_orderkey", "l_linenumber", "l_partkey", F.floor((t - 20) * 5 / 60).alias("q"))


@query("WITH " + lens.PAIRS_SQL + ", q AS (SELECT tbl, quantile_cont(shared, 0.25) AS q1, median(shared) AS q2, quantile_cont(shared, 0.75) AS q3 FROM pairs GROUP BY tbl) SELECT pair_id, round((shared - q2) / (q3 - q1 + 1e-6), 4) AS z FROM pairs JOIN q USING (tbl)")
def wn14_robust_z(spark: Spark, sf: str) -> DataFrame:
    return W.robust_z(lens.pairs(spark, sf).select("pair_id", "tbl", "shared"), "shared", ["tbl"], "z").select("pair_id", F.round("z", 4).alias("z"))


@query("WITH " + lens.SCORES_SQL + " SELECT pair_id, hand, round((s_gen - avg(s_gen) OVER (PARTITION BY pair_id)) / (stddev_samp(s_gen) OVER (PARTITION BY pair_id) + 1e-6), 4) AS z FROM hand_scores")
def wn15_z_in_pair(spark: Spark, sf: str) -> DataFrame:
    return lens.hand_scores(spark, sf).select("pair_id", "hand", F.round(W.z_in_group(F.col("s_gen"), ["pair_id"]), 4).alias("z"))


@query("WITH " + lens.SCORES_SQL + ", q AS (SELECT pair_id, quantile_cont(s_gen, 0.7) AS q FROM hand_scores GROUP BY pair_id) SELECT pair_id, hand, CAST(s_gen >= q - 1e-12 AS INTEGER) AS hot FROM hand_scores JOIN q USING (pair_id)")
def wn16_quantile_flag(spark: Spark, sf: str) -> DataFrame:
    """A pair's hands are dealt by its actors once, sorted there, and meet the two values about the quantile in a window; scores and ids follow from the keys."""
    rows = lens.pair_hands(spark, sf, ["net", "tbl"]).select("hand", "a", "b").repartition("a", "b")
    t = rows.withColumn("s", lens.model_scores()["s_gen"]).withColumn("no", F.row_number().over(W.ordered(["a", "b"], ["s", "hand"])))
    t = t.withColumn("at", (F.count("s").over(Window.partitionBy("a", "b")) - 1) * F.lit(0.7))
    end = lambda x: F.max(F.when(F.col("no") == x + 1, F.col("s"))).over(Window.partitionBy("a", "b"))
    t = t.withColumns({"lo": end(F.floor("at")), "hi": end(F.ceil("at"))})
    q = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))
    return t.select(lens.pair_id().alias("pair_id"), "hand", (F.col("s") >= q - 1e-12).cast("int").alias("hot"))


_ONSET = ", o AS (SELECT pair_id, hand, started, evidence, s_gen, row_number() OVER w - 1 AS pos, coalesce(sum(evidence) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier, coalesce(sum(s_gen) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS score_before, sum(s_gen) OVER (PARTITION BY pair_id) AS score_all FROM hand_scores WINDOW w AS (PARTITION BY pair_id ORDER BY started, hand))"


@query("WITH " + lens.SCORES_SQL + _ONSET + " SELECT pair_id, hand, CAST(earlier AS BIGINT) AS earlier, round(earlier / nullif(CAST(pos AS DOUBLE), 0), 6) AS density, pos - min(CASE WHEN evidence = 1 THEN pos END) OVER (PARTITION BY pair_id) AS since FROM o")
def wn17_onset(spark: Spark, sf: str) -> DataFrame:
    """How many flagged hands came strictly before, their density, and the distance from the first flagged one."""
    g, o = ["pair_id"], ["started", "hand"]
    t = lens.hand_scores(spark, sf).withColumns({"pos": W.position(g, o).cast("long"), "earlier": W.exclusive_sum(F.col("evidence"), g, o)})
    first = F.min(F.when(F.col("evidence") == 1, F.col("pos"))).over(Window.partitionBy("pair_id"))
    return t.select("pair_id", "hand", "earlier", F.round(F.try_divide(F.col("earlier").cast("double"), F.col("pos").cast("double")), 6).alias("density"), (F.col("pos") - first).alias("since"))


@query("WITH " + lens.SCORES_SQL + _ONSET + " SELECT pair_id, hand, round(score_before / nullif(score_all, 0), 6) AS share FROM o")
def wn18_cumulative_share(spark: Spark, sf: str) -> DataFrame:
    share = F.try_divide(F.coalesce(F.sum("s_gen").over(W.before(["pair_id"], ["started", "hand"])), F.lit(0.0)), F.sum("s_gen").over(Window.partitionBy("pair_id")))
    return lens.hand_scores(spark, sf).select("pair_id", "hand", F.round(share, 6).alias("share"))


@query("WITH " + lens.PAIRS_SQL + ", e AS (SELECT pair_id, a AS player, score FROM pairs UNION ALL SELECT pair_id, b, score FROM pairs), k AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY score DESC, pair_id) AS k FROM e), b AS (SELECT player, max(CASE WHEN k = 1 THEN pair_id END) AS tp, max(CASE WHEN k = 1 THEN score END) AS t1, max(CASE WHEN k = 2 THEN score END) AS t2 FROM k GROUP BY player) SELECT pair_id, max(CASE WHEN tp = pair_id THEN t2 ELSE t1 END) AS best_other FROM e JOIN b USING (player) GROUP BY pair_id")
def wn19_best_other(spark: Spark, sf: str) -> DataFrame:
    return P.best_other(lens.pairs(spark, sf).select("pair_id", "a", "b", "score"), "score").select("pair_id", "best_other")


@query("WITH " + lens.SCORES_SQL + " SELECT pair_id, hand, round((epoch(started) - min(epoch(started)) OVER (PARTITION BY pair_id)) / nullif(max(epoch(started)) OVER (PARTITION BY pair_id) - min(epoch(started)) OVER (PARTITION BY pair_id), 0), 6) AS rel FROM hand_scores")
def wn20_relative_time(spark: Spark, sf: str) -> DataFrame:
    t = lens.hand_scores(spark, sf).withColumn("sec", seconds("started"))
    w = Window.partitionBy("pair_id")
    lo, hi = F.min("sec").over(w), F.max("sec").over(w)
    return t.select("pair_id", "hand", F.round(F.try_divide(F.col("sec") - lo, hi - lo), 6).alias("rel"))


@query("WITH " + lens.SCORES_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY s_gen DESC, hand) AS k FROM hand_scores) SELECT pair_id, hand, row_number() OVER (PARTITION BY pair_id ORDER BY s_soft_play DESC, hand) AS r FROM k WHERE k <= 4")
def wn21_rank_in_top(spark: Spark, sf: str) -> DataFrame:
    top = W.top_k(lens.hand_scores(spark, sf).select("pair_id", "hand", "s_gen", "s_soft_play"), 4, ["pair_id"], [F.desc("s_gen"), "hand"])
    return top.select("pair_id", "hand", F.row_number().over(W.ordered(["pair_id"], [F.desc("s_soft_play"), "hand"])).cast("long").alias("r"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem")
def wn22_count_over(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("n"))


@query("SELECT event_id, CASE WHEN count(value) OVER w >= 5 THEN round(avg(value) OVER w, 6) END AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def wn23_rolling_mean(spark: Spark, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", F.round(W.rolling_mean(F.col("value"), 20, 5, ["user_id"], ["ts", "event_id"]), 6).alias("m"))


@query("WITH " + lens.ACTS_SQL + " SELECT hand, no, CAST(sum(CASE WHEN \"at\" < before THEN 1 ELSE 0 END) OVER (PARTITION BY hand ORDER BY no) AS BIGINT) AS run FROM (SELECT *, lag(\"at\") OVER (PARTITION BY hand ORDER BY no) AS before FROM acts)")
def wn24_runs(spark: Spark, sf: str) -> DataFrame:
    """A new run where time goes back along the list."""
    t = lens.acts(spark, sf).withColumn("back", F.coalesce((F.col("at") < F.lag("at").over(W.ordered(["hand"], ["no"]))).cast("int"), F.lit(0)))
    return t.select("hand", F.col("no").cast("long").alias("no"), F.sum("back").over(W.ordered(["hand"], ["no"])).alias("run"))


@query("WITH " + lens.PAIRS_SQL + f" SELECT pair_id, CASE WHEN label = 1 THEN round(({avg_rank_sql('score', 'label')}) / count(*) OVER (PARTITION BY label), 6) END AS jitter FROM pairs")
def wn26_rank_in_tier(spark: Spark, sf: str) -> DataFrame:
    """Labels are few and large, so ranks come from counts of equal scores; no task holds a label."""
    t = W.counted_rank(materialize(lens.pairs(spark, sf).select("pair_id", "label", "score"), "scored"), "score", ["label"])
    return t.select("pair_id", F.when(F.col("label") == 1, F.round(F.col("rank_") / F.col("rows_"), 6)).alias("jitter"))


@query("WITH " + lens.SCORES_SQL + " SELECT pair_id, hand, round((row_number() OVER (PARTITION BY pair_id ORDER BY started, hand)) / CAST(count(*) OVER (PARTITION BY pair_id) AS DOUBLE), 6) AS pct FROM hand_scores")
def wn27_position_percentile(spark: Spark, sf: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("pair_id"))
    return lens.hand_scores(spark, sf).select("pair_id", "hand", F.round((W.position(["pair_id"], ["started", "hand"]) + 1) / n, 6).alias("pct"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 1000")
def tk01_mixed_sort(spark: Spark, sf: str) -> DataFrame:
    first = read(spark, sf, "orders").orderBy(F.asc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(1000)
    return W.global_rank(first, [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")], "r").select("o_orderkey", F.col("r").cast("long").alias("r"))


@query("WITH " + lens.PAIRS_SQL + " SELECT pair_id, row_number() OVER (ORDER BY shared DESC, pair_id) AS r FROM pairs")
def tk02_stable_sort(spark: Spark, sf: str) -> DataFrame:
    return W.global_rank(lens.pairs(spark, sf).select("pair_id", "shared"), [F.desc("shared"), F.asc("pair_id")], "r").select("pair_id", F.col("r").cast("long").alias("r"))


@query("SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) AS k FROM lineitem) WHERE k <= 3")
def tk03_group_head(spark: Spark, sf: str) -> DataFrame:
    return W.top_k(read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice"), 3, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_partkey"]).drop("l_partkey")


_FRACTION = "SELECT pair_id FROM (SELECT pair_id, row_number() OVER (ORDER BY score DESC, pair_id) AS r, count(*) OVER () AS n FROM pairs) WHERE r <= {k}"


def top_fraction(pairs: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs of the greatest scores, whole-th parts of them all, half rounded to even. A limit of a share of all rows would bring them into one task; ranks do not."""
    ranked = W.global_rank(pairs.select("pair_id", "score"), [F.desc("score"), F.asc("pair_id")], "r_")
    n = ranked.count()
    return ranked.filter(F.col("r_") <= round(n * part / whole)).select("pair_id")


@query("WITH " + lens.PAIRS_SQL + " " + _FRACTION.format(k="round_even(n * 0.05, 0)"))
def tk04_top_fraction(spark: Spark, sf: str) -> DataFrame:
    return top_fraction(lens.pairs(spark, sf), 5, 100)


@query("WITH " + lens.PAIRS_SQL + " " + _FRACTION.format(k="round_even(n * 3000 / 137739.0, 0)"))
def tk05_head_fraction(spark: Spark, sf: str) -> DataFrame:
    return top_fraction(lens.pairs(spark, sf), 3000, 137739)


@query("WITH " + lens.SCORES_SQL + ", t AS (SELECT pair_id, list(CAST(hand AS VARCHAR) ORDER BY s_gen DESC, hand)[1:5] AS l FROM hand_scores GROUP BY pair_id) SELECT pair_id, array_to_string(list_concat(l, ['NO_EVIDENCE', 'NO_EVIDENCE', 'NO_EVIDENCE', 'NO_EVIDENCE', 'NO_EVIDENCE'])[1:5], ',') AS hands FROM t")
def tk06_padded_top(spark: Spark, sf: str) -> DataFrame:
    top = W.top_k(lens.hand_scores(spark, sf).select("pair_id", "hand", "s_gen"), 5, ["pair_id"], [F.desc("s_gen"), "hand"])
    own = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("s_gen")).alias("k"), "hand"))), lambda x: x["hand"].cast("string"))
    return top.groupBy("pair_id").agg(F.array_join(F.slice(F.concat(own, F.array_repeat(F.lit("NO_EVIDENCE"), 5)), 1, 5), ",").alias("hands"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def tk07_limit(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT l_suppkey, l_orderkey, l_partkey FROM (SELECT l_suppkey, l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_orderkey * 7919 + l_partkey * 104729) % 1000003, l_orderkey, l_partkey) AS k FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_partkey FROM lineitem)) WHERE k <= 4")
def tk08_seeded_sample(spark: Spark, sf: str) -> DataFrame:
    """A sample of each group by a seeded order of the keys."""
    t = read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey").distinct()
    key = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729, F.lit(1000003))
    return W.top_k(t.withColumn("key_", key), 4, ["l_suppkey"], ["key_", "l_orderkey", "l_partkey"]).drop("key_")
