"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.functions.nulls import any0, sum0
from duoscope.operators import contrast as C
from duoscope.operators import pairs as P
from duoscope.operators import windows as W
from duoscope.plans import lens
from duoscope.plans.registry import query
from duoscope.runtime import read

Spark = SparkSession


def lines(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def ag01_count(spark: Spark, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey, round(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0.0), 4) AS s, round(avg(l_quantity), 6) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_suppkey")
def ag02_sum_mean(spark: Spark, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("l_suppkey").agg(F.round(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(0.0)), 4).alias("s"), F.round(F.avg("l_quantity"), 6).alias("m"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("SELECT l_orderkey, bool_or(l_quantity > 45) AS some, bool_and(l_quantity > 5) AS every FROM lineitem GROUP BY l_orderkey")
def ag03_any_all(spark: Spark, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("l_orderkey").agg(any0(F.col("l_quantity") > 45).alias("some"), F.bool_and(F.col("l_quantity") > 5).alias("every"))


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS n FROM lineitem GROUP BY l_suppkey")
def ag04_conditional_sum(spark: Spark, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("l_suppkey").agg(sum0(((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)).cast("int")).alias("n"))


@query("SELECT l_orderkey, max(l_extendedprice) FILTER (l_returnflag = 'A') AS most, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS mean FROM lineitem GROUP BY l_orderkey")
def ag05_filtered(spark: Spark, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("l_orderkey").agg(F.max(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))).alias("most"), F.round(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))), 6).alias("mean"))


@query("WITH " + lens.ACTS_SQL + " SELECT hand, arg_min(actor, no) FILTER (act = 'raise') AS first_raiser FROM acts GROUP BY hand")
def ag06_filtered_first(spark: Spark, sf: str) -> DataFrame:
    return lens.acts(spark, sf).groupBy("hand").agg(F.min_by("actor", F.when(F.col("act") == "raise", F.col("no"))).alias("first_raiser"))


@query("WITH " + lens.ACTS_SQL + " SELECT hand, arg_max(act, no) AS last_act FROM acts GROUP BY hand")
def ag07_last(spark: Spark, sf: str) -> DataFrame:
    return lens.acts(spark, sf).groupBy("hand").agg(F.max_by("act", "no").alias("last_act"))


@query("SELECT o_custkey, min(c_mktsegment) AS segment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def ag08_dependent_attribute(spark: Spark, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return read(spark, sf, "orders").join(c, "o_custkey").groupBy("o_custkey").agg(F.min("c_mktsegment").alias("segment"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey")
def ag09_n_unique(spark: Spark, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def ag10_distinct(spark: Spark, sf: str) -> DataFrame:
    return lines(spark, sf).select("l_suppkey", "l_returnflag").distinct()


@query("WITH " + lens.ACTS_SQL + " SELECT hand, string_agg(act, '>' ORDER BY no) AS acts FROM acts GROUP BY hand")
def ag11_ordered_list(spark: Spark, sf: str) -> DataFrame:
    return lens.acts(spark, sf).groupBy("hand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "act"))), lambda x: x["act"]), ">").alias("acts"))


@query("WITH " + lens.SCORES_SQL + " SELECT pair_id, round(avg(s_gen), 6) AS top3 FROM (SELECT pair_id, s_gen, row_number() OVER (PARTITION BY pair_id ORDER BY s_gen DESC, hand) AS k FROM hand_scores) WHERE k <= 3 GROUP BY pair_id")
def ag12_top_mean(spark: Spark, sf: str) -> DataFrame:
    return W.top_k(lens.hand_scores(spark, sf).select("pair_id", "hand", "s_gen"), 3, ["pair_id"], [F.desc("s_gen"), "hand"]).groupBy("pair_id").agg(F.round(F.avg("s_gen"), 6).alias("top3"))


@query("WITH " + lens.SCORES_SQL + " SELECT pair_id, array_to_string(list(hand ORDER BY s_gen DESC, hand)[1:5], ',') AS hands FROM hand_scores GROUP BY pair_id")
def ag13_top_list(spark: Spark, sf: str) -> DataFrame:
    top = W.top_k(lens.hand_scores(spark, sf).select("pair_id", "hand", "s_gen"), 5, ["pair_id"], [F.desc("s_gen"), "hand"])
    return top.groupBy("pair_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("s_gen")).alias("k"), "hand"))), lambda x: x["hand"].cast("string")), ",").alias("hands"))


@query("WITH " + lens.SCORES_SQL + " SELECT pair_id, count(*) FILTER (s_gen > 0.5) AS n50, count(*) FILTER (s_gen > 0.2) AS n20 FROM hand_scores GROUP BY pair_id")
def ag14_over_threshold(spark: Spark, sf: str) -> DataFrame:
    return lens.hand_scores(spark, sf).groupBy("pair_id").agg(F.count_if(F.col("s_gen") > 0.5).alias("n50"), F.count_if(F.col("s_gen") > 0.2).alias("n20"))


@query("SELECT user_id, round(max(CASE WHEN c >= 3 THEN m END), 6) AS win10 FROM (SELECT user_id, avg(value) OVER w AS m, count(value) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) GROUP BY user_id")
def ag15_rolling_max(spark: Spark, sf: str) -> DataFrame:
    m = W.rolling_mean(F.col("value"), 10, 3, ["user_id"], ["ts", "event_id"])
    return read(spark, sf, "events").select("user_id", m.alias("m")).groupBy("user_id").agg(F.round(F.max("m"), 6).alias("win10"))


@query("SELECT l_suppkey, sum(l_linenumber) AS s_line, sum(l_linenumber * l_linenumber) AS ss_line, round(sum(l_quantity * l_quantity), 4) AS ss_qty FROM lineitem GROUP BY l_suppkey".replace("sum(l_linenumber)", "CAST(sum(l_linenumber) AS DOUBLE)").replace("sum(l_linenumber * l_linenumber)", "CAST(sum(l_linenumber * l_linenumber) AS DOUBLE)"))
def ag16_moments(spark: Spark, sf: str) -> DataFrame:
    t = lines(spark, sf).groupBy("l_suppkey").agg(*C.moments(["l_linenumber", "l_quantity"], "x"))
    return t.select("l_suppkey", F.col("x_s_l_linenumber").alias("s_line"), F.col("x_ss_l_linenumber").alias("ss_line"), F.round("x_ss_l_quantity", 4).alias("ss_qty"))


_PRESENCE = ", pres AS (SELECT x.hand, x.actor, y.actor AS partner FROM seats x JOIN seats y ON x.hand = y.hand AND x.actor <> y.actor)"
_COMPLEMENT = _PRESENCE + """, al AS (SELECT actor, count(*) AS n, sum(raises) AS s, sum(raises * raises) AS ss FROM seats GROUP BY actor),
 here AS (SELECT s.actor, partner, count(*) AS n1, sum(raises) AS s1, sum(raises * raises) AS ss1 FROM seats s JOIN pres p ON p.hand = s.hand AND p.actor = s.actor GROUP BY s.actor, partner),
 comp AS (SELECT h.actor, partner, n1, n - n1 AS n0, CAST(s1 AS DOUBLE) AS s1, CAST(ss1 AS DOUBLE) AS ss1, CAST(s - s1 AS DOUBLE) AS s0, CAST(ss - ss1 AS DOUBLE) AS ss0 FROM here h JOIN al USING (actor))"""


def complement(spark: Spark, sf: str, metrics: tuple[str, ...] = ("raises",), extra: tuple[str, ...] = ()) -> DataFrame:
    s = lens.seats(spark, sf)
    presence = P.explode_pairs(s, "hand", "actor", ordered=True).select("hand", F.col("a").alias("actor"), F.col("b").alias("partner"))
    return C.complement(s, presence, "hand", "actor", "partner", list(metrics), list(extra))


@query("WITH " + lens.SEATS_SQL + _COMPLEMENT + " SELECT actor, partner, n1, n0, s1 AS s1_raises, s0 AS s0_raises FROM comp")
def ag17_complement(spark: Spark, sf: str) -> DataFrame:
    return complement(spark, sf).select("actor", "partner", "n1", "n0", "s1_raises", "s0_raises")


_WELCH = """, w AS (SELECT *, s1 / n1 AS m1, s0 / nullif(n0, 0) AS m0, greatest((ss1 - n1 * (s1 / n1) * (s1 / n1)) / nullif(n1 - 1, 0), 1e-6) AS v1,
 greatest((ss0 - n0 * (s0 / nullif(n0, 0)) * (s0 / nullif(n0, 0))) / nullif(n0 - 1, 0), 1e-6) AS v0 FROM comp)"""


@query("WITH " + lens.SEATS_SQL + _COMPLEMENT + _WELCH + " SELECT actor, partner, CASE WHEN n1 > 1 AND n0 > 1 THEN round(m1 - m0, 6) END AS d, CASE WHEN n1 > 1 AND n0 > 1 THEN round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 5) END AS t FROM w")
def ag18_welch(spark: Spark, sf: str) -> DataFrame:
    c = {k: F.col(k) for k in ("n1", "n0", "s1_raises", "ss1_raises", "s0_raises", "ss0_raises")}
    d, t = C.welch(c["n1"], c["s1_raises"], c["ss1_raises"], c["n0"], c["s0_raises"], c["ss0_raises"])
    return complement(spark, sf).select("actor", "partner", F.round(d, 6).alias("d"), F.round(t, 5).alias("t"))


@query("WITH " + lens.SEATS_SQL + ", q AS (SELECT *, CAST((row_number() OVER (PARTITION BY actor ORDER BY started, hand) - 1) * 5 // count(*) OVER (PARTITION BY actor) AS INTEGER) AS q5 FROM seats), pres AS (SELECT x.hand, x.actor, y.actor AS partner FROM seats x JOIN seats y ON x.hand = y.hand AND x.actor <> y.actor), al AS (SELECT actor, q5, count(*) AS n, CAST(sum(raises) AS DOUBLE) AS s FROM q GROUP BY actor, q5), here AS (SELECT q.actor, q5, partner, count(*) AS n1, CAST(sum(raises) AS DOUBLE) AS s1 FROM q JOIN pres p ON p.hand = q.hand AND p.actor = q.actor GROUP BY q.actor, q5, partner) SELECT actor, partner, round(sum(n1 * (s1 / n1 - (s - s1) / (n - n1))) / sum(n1), 6) AS d FROM here JOIN al USING (actor, q5) WHERE n > n1 GROUP BY actor, partner")
def ag19_stratified_contrast(spark: Spark, sf: str) -> DataFrame:
    """Differences within chronological quintiles, weighted by presence."""
    s = lens.seats(spark, sf).withColumn("q5", W.quintile(["actor"], ["started", "hand"]))
    presence = P.explode_pairs(s, "hand", "actor", ordered=True).select("hand", F.col("a").alias("actor"), F.col("b").alias("partner"))
    c = C.complement(s, presence, "hand", "actor", "partner", ["raises"], ["q5"]).filter("n0 > 0")
    d = F.col("s1_raises") / F.col("n1") - F.col("s0_raises") / F.col("n0")
    return c.groupBy("actor", "partner").agg(F.round(F.sum(F.col("n1") * d) / F.sum("n1"), 6).alias("d"))


@query("WITH " + lens.RESPONSES_SQL + ", g AS (SELECT actor, aggressor, count(*) AS n, count(*) FILTER (act = 'fold') AS folds FROM responses GROUP BY actor, aggressor) SELECT actor, aggressor, n, folds, round((sum(folds) OVER (PARTITION BY actor) - folds) / nullif(CAST(sum(n) OVER (PARTITION BY actor) - n AS DOUBLE), 0), 6) AS others FROM g")
def ag20_leave_one_out(spark: Spark, sf: str) -> DataFrame:
    g = lens.responses(spark, sf).groupBy("actor", "aggressor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("act") == "fold").alias("folds"))
    return C.leave_one_out(g, ["actor"], "folds", "folds", "n", "others").withColumn("others", F.round("others", 6))


@query("SELECT l_suppkey, round(sum(l_discount) / greatest(sum(l_tax), 1), 6) AS r FROM lineitem GROUP BY l_suppkey")
def ag21_ratio_floor(spark: Spark, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("l_suppkey").agg(F.round(F.sum("l_discount") / F.greatest(F.sum("l_tax"), F.lit(1.0)), 6).alias("r"))


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS w FROM lineitem GROUP BY l_suppkey")
def ag22_weighted(spark: Spark, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("w"))


@query("WITH " + lens.ACTS_SQL + ", h AS (SELECT hand, actor, max(size) AS m, count(*) AS n FROM acts GROUP BY hand, actor) SELECT actor, round(avg(m), 6) AS mean_max, CAST(max(n) AS BIGINT) AS most FROM h GROUP BY actor")
def ag23_two_level(spark: Spark, sf: str) -> DataFrame:
    h = lens.acts(spark, sf).groupBy("hand", "actor").agg(F.max("size").alias("m"), F.count(F.lit(1)).alias("n"))
    return h.groupBy("actor").agg(F.round(F.avg("m"), 6).alias("mean_max"), F.max("n").alias("most"))


@query("WITH " + lens.ACTS_SQL + " SELECT actor, round(avg(CASE WHEN act = 'raise' THEN size END), 6) AS raise_size, round(avg(CASE WHEN act = 'call' THEN size END), 6) AS call_size FROM acts GROUP BY actor")
def ag24_conditional_mean(spark: Spark, sf: str) -> DataFrame:
    m = lambda k: F.round(F.avg(F.when(F.col("act") == k, F.col("size"))), 6)
    return lens.acts(spark, sf).groupBy("actor").agg(m("raise").alias("raise_size"), m("call").alias("call_size"))


@query("WITH " + lens.SEATS_SQL + " SELECT actor, coalesce(phase, 'all') AS phase, count(*) AS n, CAST(sum(raises) AS BIGINT) AS raises FROM seats GROUP BY GROUPING SETS ((actor, phase), (actor))")
def ag25_several_grains(spark: Spark, sf: str) -> DataFrame:
    lens.seats(spark, sf).createOrReplaceTempView("duoscope_seats")
    return spark.sql("SELECT actor, coalesce(phase, 'all') AS phase, count(1) AS n, sum(raises) AS raises FROM duoscope_seats GROUP BY GROUPING SETS ((actor, phase), (actor))")


@query("SELECT l_suppkey, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY l_suppkey")
def ag26_quartiles(spark: Spark, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("l_suppkey").agg(F.percentile("l_quantity", 0.25).alias("q1"), F.median("l_quantity").alias("q2"), F.percentile("l_quantity", 0.75).alias("q3"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def ag27_value_counts(spark: Spark, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_suppkey, round(sum(l_tax), 6) AS s, max(l_tax) AS m FROM lineitem GROUP BY ALL")
def ag28_segments(spark: Spark, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("l_orderkey", "l_suppkey").agg(F.round(F.sum("l_tax"), 6).alias("s"), F.max("l_tax").alias("m"))


@query("WITH " + lens.RESPONSES_SQL + " SELECT actor, aggressor, round(sum(amount), 4) AS s, max(amount) AS m FROM responses GROUP BY ALL")
def ag29_ordered_pair_sums(spark: Spark, sf: str) -> DataFrame:
    return lens.responses(spark, sf).groupBy("actor", "aggressor").agg(F.round(F.sum("amount"), 4).alias("s"), F.max("amount").alias("m"))


@query("WITH " + lens.RESPONSES_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY actor, aggressor ORDER BY amount DESC, hand, no) AS k FROM responses) SELECT actor, aggressor, count(*) AS n, count(*) FILTER (act = 'raise') AS positive, max(amount) AS m, round(avg(amount) FILTER (k <= 3), 4) AS top3 FROM r GROUP BY ALL")
def ag30_ordered_pair_top(spark: Spark, sf: str) -> DataFrame:
    r = lens.responses(spark, sf).withColumn("k", F.row_number().over(W.ordered(["actor", "aggressor"], [F.desc("amount"), "hand", "no"])))
    return r.groupBy("actor", "aggressor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("act") == "raise").alias("positive"), F.max("amount").alias("m"), F.round(F.avg(F.when(F.col("k") <= 3, F.col("amount"))), 4).alias("top3"))


@query("WITH " + lens.SEATS_SQL + " SELECT actor, round(sum(raises - 1) / nullif(sqrt(CAST(sum((raises - 1) * (raises - 1)) AS DOUBLE)), 0), 6) AS z FROM seats GROUP BY actor")
def ag31_llr_z(spark: Spark, sf: str) -> DataFrame:
    x = F.col("raises") - 1
    return lens.seats(spark, sf).groupBy("actor").agg(F.round(F.try_divide(F.sum(x).cast("double"), F.sqrt(F.sum(x * x).cast("double"))), 6).alias("z"))


@query("SELECT l_suppkey, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_suppkey")
def ag32_std(spark: Spark, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("l_suppkey").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd"))


@query("SELECT round(quantile_cont(l_extendedprice, 0.9), 4) AS q FROM lineitem")
def ag33_global_quantile(spark: Spark, sf: str) -> DataFrame:
    return W.group_quantiles(lines(spark, sf), "l_extendedprice", [0.9]).select(F.round(F.get("q_", F.lit(0)), 4).alias("q"))


@query("WITH b AS (SELECT CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 20 THEN 2 WHEN l_quantity < 40 THEN 3 ELSE 4 END AS bin, l_returnflag = 'R' AS pos FROM lineitem), c AS (SELECT bin, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM b GROUP BY bin) SELECT bin, p, q, round((p / CAST(sum(p) OVER () AS DOUBLE)) / nullif(q / CAST(sum(q) OVER () AS DOUBLE), 0), 6) AS ratio FROM c")
def ag34_density_ratio(spark: Spark, sf: str) -> DataFrame:
    """Counts by bin for two classes, and the ratio of their densities: a weight for each bin."""
    from duoscope.functions.scalar import digitize

    c = lines(spark, sf).groupBy(digitize(F.col("l_quantity"), [5, 10, 20, 40]).alias("bin")).agg(F.count_if(F.col("l_returnflag") == "R").alias("p"), F.count_if(F.col("l_returnflag") != "R").alias("q"))
    total = c.agg(F.sum("p").cast("double").alias("tp"), F.sum("q").cast("double").alias("tq"))
    return c.join(F.broadcast(total)).select("bin", "p", "q", F.round(F.try_divide(F.col("p") / F.col("tp"), F.col("q") / F.col("tq")), 6).alias("ratio"))


@query("SELECT round(-sum(p * ln(p)), 6) AS nats FROM (SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM lineitem GROUP BY l_returnflag)")
def ag35_entropy(spark: Spark, sf: str) -> DataFrame:
    from duoscope.functions.scalar import entropy

    c = lines(spark, sf).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list("n").alias("c"), F.sum("n").cast("double").alias("t"))
    return c.select(F.round(entropy(F.transform("c", lambda n: n / F.col("t"))), 6).alias("nats"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(-30, least(30, (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem))), 6) AS z FROM lineitem WHERE l_linenumber = 2")
def ag36_standardise(spark: Spark, sf: str) -> DataFrame:
    t = lines(spark, sf)
    m = t.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (F.col("l_quantity") - F.col("m")) / F.col("s")))
    return t.filter("l_linenumber = 2").join(F.broadcast(m)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(z, 6).alias("z"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 9) AS p50, round(quantile_cont(l_quantity, 0.9), 9) AS p90, round(quantile_cont(l_quantity, 0.99), 9) AS p99 FROM lineitem GROUP BY l_returnflag")
def ag38_summary(spark: Spark, sf: str) -> DataFrame:
    """The quantiles of a class that may hold most rows are selected by rank, not gathered."""
    q = W.group_quantiles(lines(spark, sf), "l_quantity", (0.5, 0.9, 0.99), ["l_returnflag"])
    n = lines(spark, sf).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))
    return n.join(q, "l_returnflag").select("l_returnflag", "n", "mean", *[F.round(F.col("q_")[i], 9).alias(p) for i, p in enumerate(("p50", "p90", "p99"))])


_NLL = "SELECT event_id, event_type, CASE WHEN event_id % 7 = 1 THEN CAST('nan' AS DOUBLE) ELSE value END AS v FROM events"


def _nll(spark: Spark, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 7 == 1, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))


@query(f"SELECT event_type, round(avg(CASE WHEN NOT isnan(v) THEN v END), 6) AS nll, count(*) FILTER (NOT isnan(v)) AS n FROM ({_NLL}) GROUP BY event_type")
def ag39_nll_report(spark: Spark, sf: str) -> DataFrame:
    good = ~F.isnan("v")
    return _nll(spark, sf).groupBy("event_type").agg(F.round(F.avg(F.when(good, F.col("v"))), 6).alias("nll"), F.count_if(good).alias("n"))


@query(f"SELECT count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (isnan(v)) AS nans, count(*) AS n FROM ({_NLL})")
def ag40_null_counts(spark: Spark, sf: str) -> DataFrame:
    return _nll(spark, sf).agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.isnan("v")).alias("nans"), F.count(F.lit(1)).alias("n"))
