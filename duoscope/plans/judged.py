"""Decoders of evidence lists, composite metrics, card equities, learners with their weights and rankers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duoscope.functions import cards as K
from duoscope.operators import boosting as B
from duoscope.operators import decode as D
from duoscope.operators import metrics as M
from duoscope.operators import models as L
from duoscope.operators import windows as W
from duoscope.plans import composite, lens
from duoscope.plans.registry import ORACLE_SQL, query
from duoscope.runtime import materialize, read

Spark = SparkSession
FAMILIES = ("s_directed_transfer", "s_soft_play", "s_coordinated_isolation")

# decoders


def timelines(spark: Spark, sf: str, columns: Sequence[str] = ("c", "s", "way", "level")) -> DataFrame:
    """Per pair its hands in time order: hand and the given ones of c, s, way, level. Hands are dealt by their pair's actors; what follows from keys is made after that."""
    way = [F.signum(F.col("a_net") - F.col("b_net")).alias("way")] if "way" in columns else []
    rows = lens.pair_hands(spark, sf, ["net", "tbl"]).select("a", "b", "started", "hand", *way).repartition("a", "b")
    made = {"c": lens.model_scores()["s_gen"] / 2, "s": lens.model_scores()["s_soft_play"] / 3, "way": F.col("way"), "level": (F.pmod("hand", F.lit(4)) - 1).cast("int")}
    r = rows.select("a", "b", F.struct("started", "hand", *[made[c].alias(c) for c in columns]).alias("r")).groupBy("a", "b").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return r.select(lens.pair_id().alias("pair_id"), *[F.col("r")[k].alias(k) for k in ("hand", *columns)])


def _listed(t: DataFrame, h: Column) -> DataFrame:
    """One row a hand with its probability of being listed."""
    return t.select("pair_id", F.explode(F.arrays_zip("hand", h.alias("p"))).alias("x")).select("pair_id", F.col("x.hand").alias("hand"), F.round("x.p", 9).alias("p"))


@query()
def q37_slot_decoder(spark: Spark, sf: str) -> DataFrame:
    """Probabilities that hands of two kinds are listed; checked against enumeration in the tests."""
    return _listed(timelines(spark, sf, ("c", "s")), D.two_kinds(F.col("c"), F.col("s"), 0.8))


@query()
def q38_level_decoder(spark: Spark, sf: str) -> DataFrame:
    return _listed(timelines(spark, sf, ("c", "level")), D.by_level(F.col("c"), F.col("level"), 2))


@query()
def q41_redirected(spark: Spark, sf: str) -> DataFrame:
    """Decoded, and again with hands against the pair's direction damped and those along it raised."""
    return _listed(timelines(spark, sf), D.redirected(F.col("c"), F.col("s"), F.col("way"), 0.02, 2.0))


@query(
    "WITH " + lens.SCORES_SQL + """, e AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY started, hand) AS k, ln(least(greatest(s_gen, 1e-4), 1 - 1e-4)) - ln(1 - least(greatest(s_gen, 1e-4), 1 - 1e-4)) AS g
 FROM hand_scores WHERE evidence = 1), f AS (SELECT pair_id, k, g FROM e WHERE k <= 5), c AS (SELECT pair_id, k, sum(g) OVER (PARTITION BY pair_id ORDER BY k) AS total FROM f UNION ALL SELECT DISTINCT pair_id, 0, 0.0 FROM f)
 SELECT pair_id, CAST(arg_min(k, (-total, k)) AS BIGINT) AS first_kind FROM c GROUP BY pair_id"""
)
def q40_best_split(spark: Spark, sf: str) -> DataFrame:
    """How many of a pair's listed hands, in order, are of the first kind."""
    rows = lens.hand_scores(spark, sf).filter("evidence = 1").withColumn("k", F.row_number().over(W.ordered(["pair_id"], ["started", "hand"]))).filter("k <= 5")
    q = F.transform(F.sort_array(F.collect_list(F.struct("k", "s_gen"))), lambda x: x["s_gen"])
    return rows.groupBy("pair_id").agg(q.alias("q")).select("pair_id", D.best_split(F.col("q")).alias("first_kind"))


# metrics

_PARTS = {k: ORACLE_SQL[k] for k in ("mt01_average_precision", "mt02_behaviour_ap", "mt05_map_from_scores")}


@query(f"SELECT round(0.7 * a.ap + 0.2 * c.map5 + 0.1 * b.macro, 8) AS score FROM ({_PARTS['mt01_average_precision']}) a, ({_PARTS['mt02_behaviour_ap']}) b, ({_PARTS['mt05_map_from_scores']}) c")
def mt04_composite(spark: Spark, sf: str) -> DataFrame:
    """Risk, evidence and behaviour in their shares, each made from the tables."""
    a, b, c = composite.mt01_average_precision(spark, sf), composite.mt02_behaviour_ap(spark, sf), composite.mt05_map_from_scores(spark, sf)
    one = lambda df: F.broadcast(df)  # noqa: E731  one row each
    return a.crossJoin(one(b)).crossJoin(one(c)).select(F.round(0.70 * F.col("ap") + 0.20 * F.col("map5") + 0.10 * F.col("macro"), 8).alias("score"))


RESAMPLES = 2000
_DRAW = "(b * 7919 + i * 104729 + b * i * 31 + (b * b) % 97) % 10007 % n"
_TABLES = lens.PAIRS_SQL + ", t AS (SELECT tbl, count(*) AS n, sum(score - (shared % 10) / 10.0) AS d, row_number() OVER (ORDER BY tbl) - 1 AS k, count(*) OVER () AS tables FROM pairs GROUP BY tbl)"


@query(
    "WITH " + _TABLES + f""", draws AS (SELECT b, {_DRAW.replace('% n', '% tables')} AS k FROM (SELECT max(tables) AS tables FROM t), range({RESAMPLES}) r(b), (SELECT unnest(range(25)) AS i) WHERE i < tables),
 m AS (SELECT b, sum(d) / sum(n) AS mean FROM draws JOIN t USING (k) GROUP BY b) SELECT round((SELECT sum(d) / sum(n) FROM t), 8) AS delta, round(quantile_cont(mean, 0.05), 8) AS low, round(quantile_cont(mean, 0.95), 8) AS high FROM m"""
)
def mt09_bootstrap(spark: Spark, sf: str) -> DataFrame:
    """The mean difference of two scores with a 90 % interval by resampling tables: sums by table first, so a resample is a few products. Draws follow a rule, so they can be repeated."""
    p = lens.pairs(spark, sf).withColumn("d", F.col("score") - (F.col("shared") % 10) / 10)
    t = p.groupBy("tbl").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"))
    return M.table_bootstrap(t, "tbl", "d", "n", RESAMPLES).select(*[F.round(c, 8).alias(c) for c in ("delta", "low", "high")])


_TOUCH = lens.PAIRS_SQL + """, pos AS (SELECT a AS p FROM pairs WHERE label = 1 AND a % 3 = 0 UNION SELECT b FROM pairs WHERE label = 1 AND a % 3 = 0),
 k AS (SELECT *, CAST(label = 1 AND a % 3 = 0 AS INTEGER) AS y, CAST(a IN (SELECT p FROM pos) OR b IN (SELECT p FROM pos) AS INTEGER) AS touch FROM pairs),
 m AS (SELECT *, row_number() OVER (ORDER BY score DESC, pair_id) AS r FROM k), w AS (SELECT *, row_number() OVER (ORDER BY score DESC, pair_id) AS wr FROM k WHERE y = 1 OR touch = 0),
 h AS (SELECT r, row_number() OVER (ORDER BY r) AS h FROM m WHERE y = 1), hw AS (SELECT wr, row_number() OVER (ORDER BY wr) AS h FROM w WHERE y = 1)"""


@query("WITH " + _TOUCH + """ SELECT round((SELECT coalesce(avg(h / CAST(r AS DOUBLE)), 0) FROM h), 8) AS ap, round((SELECT coalesce(avg(h / CAST(wr AS DOUBLE)), 0) FROM hw), 8) AS ap_mirror, (SELECT count(*) FROM k WHERE y = 0 AND touch = 1) AS excluded,
 CAST((SELECT median(r) FROM h) AS DOUBLE) AS median_rank, (SELECT count(*) FROM h WHERE r > 10) AS over_10, (SELECT count(*) FROM m WHERE r <= 30 AND label < 0) AS unknown_30, CAST((SELECT median(wr) FROM hw) AS DOUBLE) AS mirror_median_rank""")
def mt10_mirror(spark: Spark, sf: str) -> DataFrame:
    """Average precision without the pairs that share a player with a positive one, and where positives stand."""
    met = lens.pair_hands(spark, sf, ["net", "tbl"]).select("a", "b").distinct()
    p = M.touching(met.withColumn("y", ((lens.label() == 1) & (F.col("a") % 3 == 0)).cast("int")), "y")  # scores, labels and ids follow from the keys
    return M.mirror(p.select("y", "touch", lens.pair_id().alias("pair_id"), lens.score().alias("score"), lens.label().alias("label")), "score", "y", "pair_id", 10, 30)


@query("WITH " + lens.PAIRS_SQL + """, g AS (SELECT regr_slope(score, CAST(shared AS DOUBLE)) AS k, regr_intercept(score, CAST(shared AS DOUBLE)) AS c FROM pairs),
 r AS (SELECT label, score, shared, round(score - (c + k * shared), 9) AS e FROM pairs, g), q AS (SELECT label, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS r FROM r WHERE label >= 0),
 s AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS x, rank() OVER (ORDER BY shared) + (count(*) OVER (PARTITION BY shared) - 1) / 2.0 AS y FROM r)
 SELECT round((SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) FROM q), 8) AS residual_auc, round((SELECT corr(x, y) FROM s), 7) AS rho""")
def mt12_redundancy(spark: Spark, sf: str) -> DataFrame:
    """Whether a score says more than one regressor: the AUC of what least squares leaves, and the rank correlation of the two."""
    p = lens.pairs(spark, sf).select("label", "score", F.col("shared").cast("double").alias("x"))
    g = p.agg(F.regr_slope("score", "x").alias("k"), F.regr_intercept("score", "x").alias("c"))
    e = p.join(F.broadcast(g)).withColumn("e", F.round(F.col("score") - (F.col("c") + F.col("k") * F.col("x")), 9))
    auc = M.auc(e.filter("label >= 0").select("e", "label"), "e", "label").select(F.round("auc", 8).alias("residual_auc"))
    return auc.crossJoin(F.broadcast(M.spearman(p, "score", "x").select(F.round("rho", 7).alias("rho"))))


# cards


def matchups(spark: Spark, sf: str) -> DataFrame:
    """Two hands and a flop for each part, by a rule on its key that varies with the table: seven cards apart in the deck."""
    p = F.col("p_partkey")
    return read(spark, sf, "part").select("p_partkey", F.pmod(p * 7 + F.floor(p / 52), F.lit(52)).cast("int").alias("start"), (F.pmod(p * 5, F.lit(7)) + 1).cast("int").alias("step"))


def _deal(start: int, step: int) -> list[int]:
    return [(start + k * step) % 52 for k in range(7)]


def by_matchup(df: DataFrame, value, name: str, flop: bool = True) -> DataFrame:
    """A value of each distinct matchup, made once for its canonical key and joined back, turned where the hands were exchanged."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for start, step in zip(b["start"], b["step"], strict=True):
                d = _deal(start, step)
                key, flipped = K.matchup_key(((d[0], d[1]), (d[2], d[3])), tuple(d[4:7]) if flop else ())
                rows.append((start, step, key, flipped))
            yield pd.DataFrame(rows, columns=["start", "step", "key", "flipped"])

    def valued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, start, step in zip(b["key"], b["start"], b["step"], strict=True):
                d = _deal(start, step)
                a, c, board, _ = K.canonical(((d[0], d[1]), (d[2], d[3])), tuple(d[4:7]) if flop else ())
                out.append((key, float(value([a, c], list(board), int(key)))))
            yield pd.DataFrame(out, columns=["key", name])

    keys = df.select("start", "step").distinct().mapInPandas(keyed, "start int, step int, key long, flipped boolean")
    values = keys.groupBy("key").agg(F.min(F.struct("start", "step")).alias("m")).select("key", "m.start", "m.step").mapInPandas(valued, f"key long, {name} double")
    joined = df.join(keys, ["start", "step"]).join(values, "key")
    return joined.withColumn(name, F.when(F.col("flipped"), 1 - F.col(name)).otherwise(F.col(name)))


@query()
def pk07_flop_equity(spark: Spark, sf: str) -> DataFrame:
    """Exact equities of two hands on a flop over all 990 run-outs, once for each canonical matchup."""
    return by_matchup(matchups(spark, sf), lambda h, b, _: K.equities(h, b)[0], "equity").select("p_partkey", F.round("equity", 9).alias("equity"))


@query()
def pk08_sampled_equity(spark: Spark, sf: str) -> DataFrame:
    """The same over 36 fixed run-outs."""
    return by_matchup(matchups(spark, sf), lambda h, b, _: K.sampled_equities(h, b, 36, 7)[0], "equity").select("p_partkey", F.round("equity", 9).alias("equity"))


@query()
def pk09_canonical(spark: Spark, sf: str) -> DataFrame:
    """The key that a matchup has under all renamings of suits, and whether the hands were exchanged."""
    return by_matchup(matchups(spark, sf), lambda h, b, key: 0.0, "none").select("p_partkey", "key", "flipped")


@query()
def pk10_preflop(spark: Spark, sf: str) -> DataFrame:
    """Equities before the flop over 200 boards drawn by the matchup's key, without replacement."""
    return by_matchup(matchups(spark, sf), lambda h, b, key: K.sampled_equities(h, [], 200, 1_000_003 + key)[0], "equity", flop=False).select("p_partkey", F.round("equity", 9).alias("equity"))


_EQ = "((hand * 7 + a) % 101) / 100.0 AS ef, ((hand * 11 + b) % 103) / 102.0 AS et, ((hand * 13 + a + b) % 107) / 106.0 AS er"
_FOLDS = lens.PAIR_HANDS_SQL + ", fs AS (SELECT hand, actor, min(least(no, 3)) AS street FROM acts WHERE act = 'fold' GROUP BY hand, actor)"


@query("WITH " + _FOLDS + f", e AS (SELECT p.hand, p.a, p.b, x.street AS sa, y.street AS sb, {_EQ.replace('hand', 'p.hand')} FROM pair_hands p LEFT JOIN fs x ON x.hand = p.hand AND x.actor = p.a LEFT JOIN fs y ON y.hand = p.hand AND y.actor = p.b) "
       "SELECT hand, a, b, round(CASE sa WHEN 1 THEN ef WHEN 2 THEN et WHEN 3 THEN er END, 7) AS a_at_fold, round(1 - CASE sb WHEN 1 THEN ef WHEN 2 THEN et WHEN 3 THEN er END, 7) AS b_at_fold FROM e")
def pk11_equity_at_fold(spark: Spark, sf: str) -> DataFrame:
    s = lens.acts(spark, sf).filter("act = 'fold'").groupBy("hand", "actor").agg(F.min(F.least("no", F.lit(3))).alias("street"))
    side = lambda k: s.select("hand", F.col("actor").alias(k), F.col("street").alias(f"s{k}"))
    e = lens.pair_hands(spark, sf).select("hand", "a", "b").join(side("a"), ["hand", "a"], "left").join(side("b"), ["hand", "b"], "left")
    q = [F.pmod(F.col("hand") * 7 + F.col("a"), F.lit(101)) / 100, F.pmod(F.col("hand") * 11 + F.col("b"), F.lit(103)) / 102, F.pmod(F.col("hand") * 13 + F.col("a") + F.col("b"), F.lit(107)) / 106]
    return e.select("hand", "a", "b", F.round(K.at_fold_street(F.col("sa"), *q), 7).alias("a_at_fold"), F.round(K.at_fold_street(F.col("sb"), *q, second=True), 7).alias("b_at_fold"))


@query()
def pk12_equity_of_many(spark: Spark, sf: str) -> DataFrame:
    """Exact shares of three hands on a turn, ties split; they sum to 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shares = [K.equities([(d[0], d[1]), (d[2], d[3]), (d[4], d[5])], d[6:10]) for d in ([(s + k * 5) % 52 for k in range(10)] for s in b["start"])]
            yield pd.DataFrame({"start": b["start"]} | {f"e{i}": [float(x[i]) for x in shares] for i in range(3)})

    t = matchups(spark, sf)
    found = t.select("start").distinct().mapInPandas(run, "start int, e0 double, e1 double, e2 double")
    return t.join(found, "start").select("p_partkey", *[F.round(c, 9).alias(c) for c in ("e0", "e1", "e2")])


_HOLE = "[(p_partkey * 5 + 1) % 13, (p_partkey * 17 + 4) % 13] AS hr, [(p_partkey // 3) % 4, (p_partkey // 7) % 4] AS hu, [p_partkey % 13, (p_partkey * 7 + 3) % 13, (p_partkey * 11 + 5) % 13] AS r, [p_partkey % 4, (p_partkey // 4) % 4, (p_partkey // 16) % 4] AS u"


@query(
    f"SELECT p_partkey, CAST(list_max([len(list_filter(list_concat(u, hu), lambda x: x = s)) FOR s IN [0, 1, 2, 3]]) AS INTEGER) AS suit_max, CAST(list_has_any(r, hr) AS INTEGER) AS pairs_board, CAST(len(list_filter(hr, lambda x: x > list_max(r))) AS INTEGER) AS overcards, "
    f"CAST(list_max([len(list_distinct(list_filter(list_concat(list_concat(r, hr), list_transform(list_filter(list_concat(r, hr), lambda x: x = 12), lambda x: -1)), lambda x: x >= k AND x < k + 5))) FOR k IN range(-1, 9)]) AS INTEGER) AS straight FROM (SELECT p_partkey, {_HOLE} FROM part)"
)
def pk15_hand_texture(spark: Spark, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    hr, hu = F.array((p * 5 + 1) % 13, (p * 17 + 4) % 13), F.array(F.floor(p / 3) % 4, F.floor(p / 7) % 4)
    r, u = F.array(p % 13, (p * 7 + 3) % 13, (p * 11 + 5) % 13), F.array(p % 4, F.floor(p / 4) % 4, F.floor(p / 16) % 4)
    t = K.hand_texture(hr, hu, r, u)
    return read(spark, sf, "part").select("p_partkey", *[t[c].cast("int").alias(c) for c in ("suit_max", "pairs_board", "overcards", "straight")])


# learners; their scores are Spark's own, compared by held-out metrics in the tests


def states(spark: Spark, sf: str) -> DataFrame:
    """A decision with what was public before it; the class taken: 0 raise, 1 call, 2 fold."""
    w = W.before(["hand"], ["no"])
    y = F.when(F.col("act") == "raise", 0.0).when(F.col("act") == "call", 1.0).otherwise(2.0)
    pot = F.coalesce(F.sum("amount").over(w), F.lit(0.0))
    return lens.acts(spark, sf).select("hand", F.col("no").cast("double").alias("no"), "size", F.month("at").cast("double").alias("month"), F.year("at").cast("double").alias("year"), pot.alias("pot"), y.alias("y"), F.col("hand").cast("string").alias("g"))


@query()
def md03_policy(spark: Spark, sf: str) -> DataFrame:
    """Probabilities of all three classes, none by a model that saw the hand."""
    t = B.cross_fit(states(spark, sf), ["no", "size", "month", "year", "pot"], "y", "g", B.Settings("multinomial", 3, rounds=3, leaves=127), folds=2)
    return t.select("hand", "no", "fold", "y", *[F.get("score", k).alias(f"p_{n}") for k, n in enumerate(("raise", "call", "fold"))])


def roles(spark: Spark, sf: str) -> DataFrame:
    s = lens.hand_scores(spark, sf)
    return s.select("pair_id", "hand", F.col("tbl").cast("string").alias("tbl"), F.col("a_net").alias("A_net"), F.col("b_net").alias("B_net"), (F.col("a_net") - F.col("b_net")).alias("gap"), "s_gen", "s_soft_play", F.col("evidence").cast("double").alias("y"), F.col("evidence"))


@query()
def md05_symmetric(spark: Spark, sf: str) -> DataFrame:
    """Boosted trees with row weights, fitted on the rows and on the same with roles exchanged; a score is the mean of both ways."""
    one = roles(spark, sf).withColumn("weight", L.weights(F.col("evidence") * 2 - 1, F.col("evidence")))
    rows = L.both_roles(materialize(one.drop("evidence"), "roles"), negate=["gap"])
    scored = B.cross_fit(rows, ["A_net", "B_net", "gap", "s_gen", "s_soft_play"], "y", "tbl", B.Settings("logistic", rounds=3, leaves=63), folds=5, weight=F.col("weight"))
    return scored.groupBy("pair_id", "hand").agg(F.avg("score").alias("score"))


_STAGE = lens.PAIRS_SQL + ", u AS (SELECT pair_id, row_number() OVER (ORDER BY score DESC, pair_id) AS r, count(*) OVER () AS n FROM pairs WHERE label < 0)"


@query("WITH " + _STAGE + " SELECT pair_id, CASE WHEN r <= 3 THEN 1 WHEN label = 1 THEN 1 ELSE 0 END AS target, CAST(CASE WHEN r <= 3 THEN 0.5 WHEN r <= floor(n * 0.2) THEN 0.0 WHEN label < 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS weight FROM pairs LEFT JOIN u USING (pair_id)")
def md06_second_stage(spark: Spark, sf: str) -> DataFrame:
    """Weights of a second fit: the unknown pairs that score most are no negatives, the first few are positives of half weight."""
    return L.second_stage(lens.pairs(spark, sf), "score", "label", 0.2, 3, "pair_id").select("pair_id", F.col("target").cast("int").alias("target"), F.col("weight").cast("double").alias("weight"))


FOLDS = 5


def pair_families(scores: DataFrame) -> DataFrame:
    """(pair_id, family): which of the three families' scores has the greatest mean, from 0; ties to the first."""
    mean = scores.groupBy("pair_id").agg(*[F.avg(c).alias(c) for c in FAMILIES])
    best = F.greatest(*FAMILIES)
    return mean.select("pair_id", F.when(F.col(FAMILIES[0]) == best, 0).when(F.col(FAMILIES[1]) == best, 1).otherwise(2).alias("family"))


def routed(rows: DataFrame) -> tuple[DataFrame, Column, Callable[[Column], Column]]:
    """(rows with fold by table, the models that may learn from a row, the number of a family's model that holds a row out).

    Models 0 to 4 are the generic ones, then five for each family. A row teaches the generic and its own family's models of the other folds.
    """
    t = rows.withColumn("fold", L.fold(F.col("tbl"), FOLDS))
    others = F.filter(F.array(*map(F.lit, range(FOLDS))), lambda k: k != F.col("fold"))
    return t, F.concat(others, F.transform(others, lambda k: k + (F.col("family") + 1) * FOLDS)), lambda family: F.col("fold") + (family + 1) * FOLDS


RANKED = ("s_gen", "s_soft_play", "s_coordinated_isolation")


@query()
def md07_ranking(spark: Spark, sf: str) -> DataFrame:
    """LambdaRank of a pair's hands, generic and by family, in five folds by table: all twenty models grow in the same passes."""
    scores = lens.hand_scores(spark, sf).withColumn("tbl", F.col("tbl").cast("string"))
    t, models, of = routed(scores.select("pair_id", "hand", "tbl", "evidence", *RANKED).join(pair_families(scores), "pair_id"))
    t = materialize(t.drop("tbl"), "rows")
    m = B.fit(t, list(RANKED), "evidence", models, B.Settings("rank", rounds=2, leaves=31, rate=0.3), group="pair_id", key=F.col("hand"))
    both = m.score(m.score(t, F.col("fold")), of(F.col("family")), "family_score")
    return both.select("pair_id", "hand", "family", "evidence", "score", "family_score")


def rescored(rows: DataFrame, features: list[str], settings: B.Settings, negate: list[str]) -> DataFrame:
    """(pair_id, hand, family, predicted, score) of the hands of positives whose predicted family is another than theirs.

    rows: positives' hands with tbl, family, predicted, evidence and A_ and B_ columns. Models by (family, fold) learn from hands of their own family;
    a mis-routed hand is scored by its predicted family's model that held its table out, with both roles, and has their mean.
    """
    t, models, of = routed(L.both_roles(rows, negate=negate))
    m = B.fit(t, features, "evidence", models, settings)
    lost = m.score(t.filter("predicted <> family"), of(F.col("predicted")))
    return lost.groupBy("pair_id", "hand", "family", "predicted").agg(F.avg("score").alias("score"))


@query()
def q52_rerouted(spark: Spark, sf: str) -> DataFrame:
    """Positives that were taken for another family: their hands by that family's held-out model. The prediction here is the family of the best single hand."""
    scores = lens.hand_scores(spark, sf)
    peak = scores.groupBy("pair_id").agg(*[F.max(c).alias(c) for c in FAMILIES])
    top = F.greatest(*FAMILIES)
    predicted = peak.select("pair_id", F.when(F.col(FAMILIES[0]) == top, 0).when(F.col(FAMILIES[1]) == top, 1).otherwise(2).alias("predicted"))
    positives = lens.pairs(spark, sf).filter("label = 1").select("pair_id")
    rows = roles(spark, sf).join(positives, "pair_id").join(pair_families(scores), "pair_id").join(predicted, "pair_id")
    return rescored(materialize(rows.drop("y"), "rows"), ["A_net", "B_net", "gap", "s_gen", "s_soft_play"], B.Settings("logistic", rounds=3, leaves=31), ["gap"])


@query()
def md08_two_learners(spark: Spark, sf: str) -> DataFrame:
    """Two kinds of trees, averaged by rank. Both read and score the same written rows; ranks are made one after the other, without a join."""
    rows = materialize(roles(spark, sf).select("pair_id", "hand", "tbl", "s_gen", "s_soft_play", "gap", "y"), "rows")
    features = ["s_gen", "s_soft_play", "gap"]
    t = L.cross_fit_all(rows, features, "y", "tbl", {"one": L.binary("y", iterations=10, depth=4), "two": L.multiclass("y", trees=20, depth=6)})
    t = t.select("pair_id", "hand", F.get("one", F.lit(1)).alias("one"), F.get("two", F.lit(1)).alias("two"))
    for c in ("one", "two"):  # a row keeps its first rank when the rows are sorted for the second
        t = W.global_rank(t, [F.col(c).asc(), F.col("pair_id").asc(), F.col("hand").asc()], f"r_{c}").drop(c)
    return t.select("pair_id", "hand", ((F.col("r_one") + F.col("r_two")) / 2).alias("rank"))


@query()
def md09_family(spark: Spark, sf: str) -> DataFrame:
    """A family for each pair by the mean of five seeds' probabilities, from pooled scores."""
    pooled = lens.hand_scores(spark, sf).groupBy("pair_id", F.col("tbl").cast("string").alias("tbl")).agg(*[f(c).alias(f"{n}_{c}") for c in FAMILIES for n, f in (("max", F.max), ("mean", F.avg))])
    y = F.greatest(*[F.col(f"mean_{c}") for c in FAMILIES])
    rows = pooled.withColumn("y", sum((F.when(F.col(f"mean_{c}") == y, float(k)).otherwise(0.0) for k, c in enumerate(FAMILIES)), F.lit(0.0)))
    rows = rows.withColumn("y", F.least("y", F.lit(2.0)))
    rows = materialize(rows, "pooled")
    seeds = {f"p_{seed}": L.multiclass("y", trees=10, depth=5, seed=seed) for seed in range(5)}
    t = L.cross_fit_all(rows, [f"{n}_{c}" for c in FAMILIES for n in ("max", "mean")], "y", "tbl", seeds)
    classes = F.sequence(F.lit(0), F.size("p_0") - 1)
    mean = F.transform(classes, lambda k: sum((F.get(p, k) for p in list(seeds)[1:]), F.get("p_0", k)) / len(seeds))
    t = t.select("pair_id", F.col("y").cast("int").alias("family"), mean.alias("mean"))
    return t.select("pair_id", "family", (F.array_position("mean", F.array_max("mean")) - 1).cast("int").alias("predicted"), F.array_max("mean").alias("p"))


# hashes whose tables SQL builds by rule


def _crc_step(c: int) -> int:
    for _ in range(8):
        c = c >> 1 ^ 0xEDB88320 * (c & 1)
    return c


_CRC_TABLE = ", ".join(str(_crc_step(c)) for c in range(256))
CRC_SQL = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({{0}}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, [{_CRC_TABLE}][CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS BIGINT))"
ORACLE_SQL["hs01_crc32_half"] = f"SELECT o_orderkey, CAST({CRC_SQL.format('CAST(o_orderkey AS VARCHAR)')} & 1 AS BIGINT) AS half FROM orders"
