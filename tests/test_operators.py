"""Operators against brute force, and relations that must hold."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.functions import cards as K
from duoscope.operators import decode as D
from duoscope.operators import metrics as M
from duoscope.operators import models as L
from duoscope.operators import pairs as P
from duoscope.operators import windows as W

SF = "/root/testdata/sf0.001"


def test_swap_is_an_involution(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 0.25, 5.0)], "id long, A_x double, B_x double, share double, d double")
    once = P.swap_roles(df, ["d"], ["share"])
    assert once.columns == df.columns and once.first()["A_x"] == 3.0 and once.first()["d"] == -5.0
    assert P.swap_roles(once, ["d"], ["share"]).first() == df.first()


def test_global_rank_equals_a_window(spark):
    df = spark.range(500).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    got = {r["id"]: r["global_rank"] for r in W.global_rank(df, [F.desc("v"), F.asc("id")]).collect()}
    want = [r["id"] for r in df.orderBy(F.desc("v"), "id").collect()]
    assert [got[i] for i in want] == list(range(1, 501))


def test_auc_and_spearman(spark):
    r = random.Random(1)
    rows = [(k, r.randint(0, 9) / 10, r.randint(0, 1), r.randint(0, 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, s double, y int, t int")
    pos, neg = [x[1] for x in rows if x[2]], [x[1] for x in rows if not x[2]]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert M.auc(df, "s", "y").first()[0] == pytest.approx(want)
    import pandas as pd

    assert M.spearman(df, "s", "t").first()[0] == pytest.approx(pd.DataFrame(rows)[[1, 3]].rank().corr().iloc[0, 1])


def brute_slots(p, slots):
    out = [0.0] * len(p)
    for bits in itertools.product((0, 1), repeat=len(p)):
        w = np.prod([x if b else 1 - x for x, b in zip(p, bits, strict=True)])
        for i in [i for i, b in enumerate(bits) if b][:slots]:
            out[i] += w
    return out


@pytest.mark.parametrize("n", [0, 1, 4, 7, 9])
def test_slot_decoder_equals_enumeration(spark, n):
    r = random.Random(n)
    p = [round(r.random(), 3) for _ in range(n)]
    df = spark.createDataFrame([(p, list(range(n)))], "p array<double>, h array<int>")
    got = df.select(D.slot_probabilities(F.col("p"), 3).alias("q"), D.decode(F.col("h"), F.col("p"), 3).alias("d")).first()
    want = brute_slots(p, 3)
    assert got["q"] == pytest.approx(want)
    assert got["d"] == sorted(range(n), key=lambda i: (-got["q"][i], i))[:3]


def test_hand_categories_over_all_hands():
    hands = np.fromiter(itertools.chain.from_iterable(itertools.combinations(range(52), 5)), np.int8).reshape(-1, 5)
    scores = np.concatenate([K.five(hands[i : i + 100_000].astype(np.int64)) for i in range(0, len(hands), 100_000)])
    assert np.bincount(K.category(scores)).tolist() == [1302540, 1098240, 123552, 54912, 10200, 5108, 3744, 624, 40]
    assert len(np.unique(scores)) == 7462
    card = lambda s: 4 * K.RANKS.index(s[0]) + K.SUITS.index(s[1])
    hand = lambda t: np.array([[card(c) for c in t.split()]])
    order = ["2c 4d 6h 8s Tc", "2c 2d 6h 8s Tc", "2c 2d 6h 6s Tc", "2c 2d 2h 6s Tc", "Ac 2d 3h 4s 5c", "2d 3h 4s 5c 6c", "2c 4c 6c 8c Tc", "2c 2d 2h 6s 6c", "2c 2d 2h 2s 6c", "Ac 2c 3c 4c 5c"]
    scores = [int(K.five(hand(t))[0]) for t in order]
    assert scores == sorted(scores) and len(set(scores)) == len(scores)


def test_equities_are_symmetric_and_canonical():
    e = K.equities([(50, 51), (0, 5)], [12, 20, 33])
    f = K.equities([(0, 5), (50, 51)], [12, 20, 33])
    assert e[0] == pytest.approx(f[1]) and e.sum() == pytest.approx(1)
    turn = lambda c: 4 * (c // 4) + (c + 1) % 4
    a = K.canonical(((50, 51), (0, 5)), (12, 20, 33))
    b = K.canonical(((turn(50), turn(51)), (turn(5), turn(0))), tuple(map(turn, (33, 12, 20))))
    assert a == b
    assert K.equities([(0, 4), (1, 5)], [50, 46, 42, 38, 35]).tolist() == [0.5, 0.5]


def test_causal_state_ignores_the_future(spark):
    r = random.Random(2)
    rows = [(h, n, r.randrange(6), r.choice(["raise", "call", "fold"]), float(r.randint(1, 9))) for h in range(5) for n in range(8)]
    kind = "hand long, no long, seat int, act string, amount double"
    later = [(h, n, s if n <= 4 else (s + 1) % 6, a if n <= 4 else "raise", x if n <= 4 else x + 1) for h, n, s, a, x in rows]
    a, b = (K.causal_state(spark.createDataFrame(x, kind)).filter("no <= 4").select("hand", "no", "acted", "folded", "raises", "pot").collect() for x in (rows, later))
    assert sorted(a) == sorted(b)


def test_cross_fit_holds_groups_out(spark):
    df = spark.range(200).select((F.col("id") % 10).cast("string").alias("g"), F.rand(1).alias("x"), (F.rand(2) > 0.5).cast("double").alias("y"))
    out = L.cross_fit(df, ["x"], "y", "g", L.binary("y", iterations=1, depth=2))
    assert out.count() == 200 and out.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert out.filter("score is null or score < 0 or score > 1").count() == 0


def enumerate_lists(n, listed):
    """Sums of probabilities over all 2**n truths: for each hand that it is true and listed."""
    for truth in itertools.product((0, 1), repeat=n):
        yield truth, [j for j in range(n) if truth[j] and listed(truth, j)]


def probability(truth, p):
    out = 1.0
    for t, x in zip(truth, p, strict=True):
        out *= x if t else 1 - x
    return out


def test_two_kinds_and_levels_match_enumeration(spark):
    c, s, n = [0.9, 0.5, 0.7, 0.2, 0.8], [0.3, 0.6, 0.1, 0.9, 0.4], 5
    slots, want = 2, [0.0] * n
    for tc in itertools.product((0, 1), repeat=n):
        for ts in itertools.product((0, 1), repeat=n):
            w = probability(tc, c) * probability(ts, s)
            for j in range(n):
                first = tc[j] and sum(tc[:j]) < slots
                # the second kind's slots: the other hands' first kind, and the second kind earlier
                second = ts[j] and sum(tc[:j]) + sum(tc[j + 1 :]) + sum(ts[:j]) < slots
                want[j] += w * (first + second)
    df = spark.createDataFrame([(c, s, [0, 1, 0, -1, 1], [1.0, -1.0, 1.0, 1.0, -1.0])], "c array<double>, s array<double>, l array<int>, w array<double>")
    got = df.select(D.two_kinds(F.col("c"), F.col("s"), 1.0, slots).alias("h"), D.by_level(F.col("c"), F.col("l"), 1, slots).alias("v"), D.redirected(F.col("c"), F.col("s"), F.col("w"), 0.02, 2.0, 1.0, slots).alias("r")).first()
    assert got["h"] == pytest.approx(want)
    levels = [0, 1, 0, -1, 1]
    by = [0.0] * n
    for truth, kept in enumerate_lists(n, lambda t, j: levels[j] >= 0 and sum(t[i] for i in range(n) if 0 <= levels[i] < levels[j] or levels[i] == levels[j] and i < j) < slots):
        for j in kept:
            by[j] += probability(truth, c)
    assert got["v"] == pytest.approx(by)
    top = sorted(range(n), key=lambda j: -want[j])[:slots]
    way = [1, -1, 1, 1, -1]
    main = np.sign(sum(way[j] * want[j] for j in top))
    turn = lambda p: [x * 0.02 if w == -main else 2 * x / (1 + x) for x, w in zip(p, way, strict=True)]
    again = spark.createDataFrame([(turn(c), turn(s))], "c array<double>, s array<double>").select(D.two_kinds(F.col("c"), F.col("s"), 1.0, slots).alias("h")).first()["h"]
    assert got["r"] == pytest.approx(again)


def test_empty_timelines_decode_to_nothing(spark):
    df = spark.createDataFrame([([], [])], "c array<double>, s array<double>")
    assert df.select(D.two_kinds(F.col("c"), F.col("s")).alias("h")).first()["h"] == []


def test_sampled_equities_and_keys():
    from duoscope.functions import cards

    a, b, board = (48, 49), (0, 5), [10, 21, 34]
    exact, sampled = cards.equities([a, b], board)[0], cards.sampled_equities([a, b], board, 400, 3)[0]
    assert abs(exact - sampled) < 0.1 and cards.sampled_equities([a, b], board, 36, 7).tolist() == cards.sampled_equities([a, b], board, 36, 7).tolist()
    suits = lambda c: 4 * (c // 4) + (c % 4 + 1) % 4
    key, flipped = cards.matchup_key((a, b), tuple(board))
    other, turned = cards.matchup_key((tuple(map(suits, b)), tuple(map(suits, a))), tuple(map(suits, board)))
    assert key == other and flipped != turned
    assert cards.equities([a, b, (30, 31)], [*board, 40]).sum() == pytest.approx(1.0)


def test_known_hands_have_their_categories():
    from duoscope.functions import cards

    code = lambda text: [4 * cards.RANKS.index(x[0]) + cards.SUITS.index(x[1]) for x in text.split()]
    known = {"Ah Kh Qh Jh Th 2c 3d": 8, "9c 9d 9h 9s 2c 3d 4h": 7, "9c 9d 9h 4s 4c 3d 2h": 6, "Ah 9h 7h 4h 2h Kc Qd": 5, "Ah 2c 3d 4s 5h Kc Kd": 4, "9c 9d 9h Ks 2c 3d Jh": 3, "9c 9d Kh Ks 2c 3d Jh": 2, "9c 9d Kh Qs 2c 3d Jh": 1, "9c 8d Kh Qs 2c 3d Jh": 0}
    assert cards.category(cards.best(np.array([code(x) for x in known]))).tolist() == list(known.values())


def test_hash_queries_have_their_values(spark):
    import zlib

    from duoscope.plans import registry, scalars  # noqa: F401

    rows = registry.QUERIES["hs01_crc32_half"](spark, SF).collect()
    assert rows and all(r["half"] == zlib.crc32(str(r["o_orderkey"]).encode()) & 1 for r in rows)
    sides = {}
    nation = dict(map(tuple, spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey", "s_nationkey").collect()))
    for r in registry.QUERIES["hs02_table_parity"](spark, SF).collect():
        assert sides.setdefault(nation[r["s_suppkey"]], r["side"]) == r["side"] and r["side"] in (0, 1)


def test_learners_beat_chance_where_there_is_something_to_learn(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t in range(12):
        for k in range(40):
            x, z = rng.random(), rng.random()
            rows.append((f"p{t}_{k % 4}", k, str(t), float(x), float(z), float(rng.random() < 0.1 + 0.8 * x)))
    df = spark.createDataFrame(rows, "pair_id string, hand long, tbl string, x double, z double, y double").withColumn("e", F.col("y").cast("int"))

    def auc(out):
        return M.auc(out.select("score", F.col("y").cast("int").alias("l")), "score", "l").first()[0]

    best = auc(df.withColumn("score", F.col("x")))  # what decides the label, but for chance
    assert auc(L.cross_fit(df, ["x", "z"], "y", "tbl", L.binary("y", iterations=5, depth=2))) > best - 0.05
    within = lambda out: M.group_auc(out, "score", "e", "pair_id").agg(F.avg("auc")).first()[0]  # noqa: E731  a ranker orders a group's rows
    assert within(L.ranker(df, ["x", "z"], "e", "pair_id", "hand", "tbl")) > within(df.withColumn("score", F.col("x"))) - 0.05
    whole = L.cross_fit(df, ["x", "z"], "y", "tbl", L.multiclass("y", trees=5, depth=3), vector=True).select("score").first()[0]
    assert len(whole) == 2 and sum(whole) == pytest.approx(1.0)
    roles = df.select("pair_id", "hand", "tbl", F.col("x").alias("A_x"), F.col("z").alias("B_x"), (F.col("x") - F.col("z")).alias("gap"), (F.col("x") > F.col("z")).cast("double").alias("y"))
    both = L.both_ways(roles.withColumn("y", F.lit(1.0) * (F.abs("gap") > 0.3).cast("double")), ["A_x", "B_x", "gap"], "y", "tbl", L.binary("y", iterations=5, depth=3), negate=["gap"], keys=["pair_id", "hand"])
    joined = both.join(roles.select("pair_id", "hand", (F.abs("gap") > 0.3).cast("double").alias("y")), ["pair_id", "hand"])
    assert both.count() == df.count() and auc(joined) > 0.9


def test_steps_run_once_and_in_order(spark, tmp_path):
    from duoscope.sources import files

    ran = []
    steps = files.Steps(spark, f"file://{tmp_path}/s")
    steps.add("b", lambda: ran.append("b"), ["a"])
    steps.add("a", lambda: ran.append("a"))
    steps.run()
    steps.run()
    assert ran == ["a", "b"]


def test_float_text_is_the_other_spelling(spark):
    from duoscope.sources import files

    values = [1e-7, 1.5e-5, 0.0001, 0.25, 1.0, 123456789.5, 1e15, 1e16, 1.25e300, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r["t"] for r in df.select(files.float_text(F.col("v")).alias("t")).collect()]
    assert [float(x) for x in got] == values and got == [repr(v) for v in values]


def test_written_tables_are_discarded(spark):
    import os

    from duoscope.runtime import discard, materialize

    df = materialize(spark.range(5), "gone")
    path = df.inputFiles()[0].removeprefix("file:").lstrip("/")
    assert os.path.exists(f"/{path}") and df.count() == 5
    discard(df)
    discard(df)
    assert not os.path.exists(f"/{path}")


def test_a_boundary_between_quantiles_is_found(spark):
    """The labels change at a value that is no quantile; a missing feature is no positive."""
    rows = [(k, None if k == 7 else (k - 1500) / 10, float(k > 1500)) for k in range(20_000)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    got = L.fitted_at_boundary(df, "x", L.tree("y"), "y").transform(df).filter("prediction <> y").count()
    assert got == 0
    assert L.fitted(df.filter("x is not null"), ["x"], L.tree("y")).transform(df.filter("x is not null")).filter("prediction <> y").count() > 0


def test_learners_read_written_rows(spark, monkeypatch):
    """Each pass of a learner would otherwise make the rows again."""
    from duoscope import runtime

    names, keep = [], runtime.materialize
    monkeypatch.setattr(runtime, "materialize", lambda t, name: names.append(name) or keep(t, name))
    df = spark.createDataFrame([(k, float(k % 3), float(k % 3 > 1), str(k % 7)) for k in range(60)], "k int, x double, y double, g string")
    assert L.cross_fit(df, ["x"], "y", "g", L.tree("y")).count() == 60 and names == ["folds"]


@pytest.mark.parametrize("name", ["pk20_transfer", "pk21_fold_margin", "pk25_fold_account"])
def test_pairs_of_seats_need_no_written_seats(spark, monkeypatch, name):
    """Seats are made where their acts lie: none is written or dealt again, so only acts and hands, each for both sides, are dealt by hand."""
    from duoscope.plans import pairhands

    def written(t, name):
        raise AssertionError(f"{name} written")

    monkeypatch.setattr(pairhands, "materialize", written)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")  # suppliers only
    try:
        plan = getattr(pairhands, name)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_hand = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and ("o_orderkey" in x or "l_orderkey" in x or "hand#" in x)]
    assert len(by_hand) <= 4


def test_all_learners_of_a_fold_score_a_row_where_it_is_read(spark):
    from duoscope.operators import models as L
    from duoscope.plans import registry

    df = spark.range(400).selectExpr("id", "CAST(id % 20 AS STRING) AS g", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 7 > 3 AS DOUBLE) AS y")
    learners = {"one": L.binary("y", iterations=2, depth=2), "two": L.multiclass("y", trees=3, depth=2)}
    got = {r["id"]: (r["fold"], r["one"][1], r["two"][1]) for r in L.cross_fit_all(df, ["x"], "y", "g", learners).collect()}
    want = [{r["id"]: (r["fold"], r["score"]) for r in L.cross_fit(df, ["x"], "y", "g", x).collect()} for x in learners.values()]
    assert len(got) == 400 and all(got[i][:2] == want[0][i] and abs(got[i][2] - want[1][i][1]) < 0.05 for i in got)
    plan = registry.QUERIES["md09_family"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Window [", "Aggregate [", "Generate "))
