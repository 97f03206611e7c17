"""Case statistics, labels, anomalies and reports against plain loops on small made tables."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from duoscope.plans import decisions, lens, profiles, reports

SF = "/root/testdata/sf0.001"


def held(street, part, actor):
    return (part % 21 - 1) / 20.0 if street == 0 else ((part * (7 + 6 * street) + actor) % 7462) / 7462.0


def test_case_statistics_equal_a_plain_walk(spark):
    acts = defaultdict(list)
    evaluation = lens.hands(spark, SF).filter("phase = 'evaluation'").select("hand")
    for r in lens.acts(spark, SF).join(evaluation, "hand").select("hand", "no", "actor", "part", "act").orderBy("hand", "no").collect():
        acts[r["hand"]].append(r)
    want = defaultdict(lambda: defaultdict(int))
    for rows in acts.values():
        first = {}
        for r in rows:
            first.setdefault(r["actor"], r["part"])
        pairs = [(a, b) for a in first for b in first if a < b]
        live, last, street, early, alone = set(first), None, None, [], defaultdict(set)
        for r in rows:
            if min(r["no"] // 3, 3) != street:
                street, last = min(r["no"] // 3, 3), None
            p = r["actor"]
            if r["act"] == "fold" and last not in (None, p):
                better = held(street, first[p], p) > held(street, first[last], last)
                for a, b in pairs:
                    if p in (a, b):
                        side, kind = "A" if p == a else "B", "partner" if last in (a, b) else "others"
                        want[a, b][f"{side}_folds_{kind}"] += 1
                        want[a, b][f"{side}_folds_{kind}_better"] += better
            if r["act"] == "raise":
                last = p
                early += [p] if street == 0 else []
                for a, b in pairs:
                    if p in (a, b) and (b if p == a else a) in live:
                        want[a, b][f"{'A' if p == a else 'B'}_bets_into"] += 1
            if r["act"] == "fold":
                live.discard(p)
            if street and len(live) == 2:
                alone[(*sorted(live), street)].add(r["act"])
        for a, b in pairs:
            want[a, b]["hands"] += 1
            for s, x in (("A", a), ("B", b)):
                want[a, b][f"{s}_wars"] += len(early) >= 3 and x in early
            want[a, b]["hu_hands"] += any(k[:2] == (a, b) for k in alone)
            want[a, b]["hu_passive"] += sum(k[:2] == (a, b) and v == {"call"} for k, v in alone.items())
    got = profiles.case_statistics(spark, SF, 1).collect()
    assert len(got) == len(want) > 20
    columns = [f"{s}_{c}" for s in "AB" for c in profiles._COUNTED] + ["hands", "hu_hands", "hu_passive"]
    for r in got:
        assert {c: r[c] for c in columns} == {c: want[r["a"], r["b"]][c] for c in columns}


def test_labels_under_full_lists(spark):
    rng = random.Random(3)
    rows = [(f"p{p}", t, rng.randrange(3), rng.random() < 0.2) for p in range(30) for t in range(rng.randrange(1, 40))]
    t = spark.createDataFrame(rows, "pair_id string, t int, level int, listed boolean")
    n, s = F.count_if("listed"), F.max(F.when(F.col("listed") & (F.col("level") > 0), 1)).isNotNull()
    c = profiles.censored(t, "pair_id", ["t"], F.col("listed"), (n >= 5) & ~s, F.col("level") == 0)
    level = profiles.censored(t, "pair_id", ["t"], F.col("listed"), F.count_if(F.col("listed") & (F.col("level") == 0)) >= 5, F.lit(True), F.col("level") == 0)
    by = defaultdict(list)
    for p, at, lv, on in rows:
        by[p].append((at, lv, on))
    for p, own in by.items():
        full, any_s = sum(x[2] for x in own) >= 5, any(x[2] and x[1] for x in own)
        last = max((x[0] for x in own if x[2] and x[1] == 0), default=None)
        full_0 = sum(x[2] and x[1] == 0 for x in own) >= 5
        for r in c.filter(F.col("pair_id") == p).collect():
            unknown = full and not any_s and not r["listed"] and last is not None and r["t"] > last
            assert r["lab"] == (1 if r["listed"] and r["level"] == 0 else -1 if unknown else 0)
        for r in level.filter(F.col("pair_id") == p).collect():
            assert r["lab"] == (-1 if r["level"] else 1 if r["listed"] else -1 if full_0 and r["t"] > last else 0)


def test_anomaly_of_equal_rows_and_of_none(spark):
    kind = "tbl int, a int, b int, x double, y double"
    t = spark.createDataFrame([(1, 1, k, 2.0, float(k)) for k in range(5)] + [(2, 9, 9, None, 1.0)], kind)
    got = {(r["tbl"], r["b"]): r for r in profiles.table_anomaly(t, ["tbl"], ("x", "y"), F.lit(True)).collect()}
    assert got[1, 4]["z_x"] == 0.0 and got[1, 4]["z_y"] == pytest.approx(2 / (2 + 1e-6)) and got[1, 4]["z_n3"] == 0
    assert got[2, 9]["z_x"] is None and got[2, 9]["z_y"] == 0.0 and got[2, 9]["z_max"] == 0.0  # a table whose statistic is all null
    assert profiles.table_anomaly(t.limit(0), ["tbl"], ("x", "y"), F.lit(True)).count() == 0


def test_format_errors(spark):
    kind = ", ".join(f"{c} string" for c in ("pair_id", "risk_score", "predicted_behavior", *reports.EVIDENCE))
    rows = [
        ("p1", "0.5", "none", "h1", " h1 ", None, None, ""), ("p1", "nan", "none", "NO_EVIDENCE", "NO_EVIDENCE", "", "", None), ("p2", "-1", "soft play", "h1", "h2", None, None, None),
        ("zz", None, None, None, None, None, None, None),
    ]
    got = {r["rule"]: r["n"] for r in reports.format_errors(spark.createDataFrame([("p1",), ("p2",), ("p3",)], "pair_id string"), spark.createDataFrame(rows, kind)).collect()}
    assert got == {"risk no number": 2, "risk out of range": 1, "unknown behaviour": 2, "repeated evidence": 1, "missing pair": 1, "foreign pair": 1, "repeated pair": 1}
    none = reports.format_errors(spark.createDataFrame([], "pair_id string"), spark.createDataFrame([], kind)).collect()
    assert {r["n"] for r in none} == {0} and len(none) == 7


def test_length_weights_bring_the_targets_lengths(spark):
    rows = [(n, True) for n in (1, 1, 1, 5)] + [(n, False) for n in (1, 1, 5, 5, 20)]
    got = reports.length_weights(spark.createDataFrame(rows, "shared int, goal boolean"), "shared", F.col("goal")).groupBy("shared").agg(F.max("len_w").alias("w"), F.min("len_w").alias("v")).collect()
    assert {r["shared"]: r["w"] for r in got} == {1: pytest.approx(0.75 / 0.4), 5: pytest.approx(0.25 / 0.4), 20: 0.25} and all(r["w"] == r["v"] for r in got)


def test_residuals_by_presence(spark):
    residuals = [(1, 10, 2_000_000), (2, 10, 500_000), (1, 20, -1_000_000)]
    seats = [(1, 10, "d", 1), (1, 20, "d", 1), (2, 10, "d", 1), (2, 20, "d", 0), (2, 30, "d", 1)]
    r = spark.createDataFrame(residuals, "hand int, actor int, residual long")
    s = spark.createDataFrame(seats, "hand int, actor int, phase string, vpip int")
    rows = decisions.presence_residual(r, s).collect()
    assert [(x["a"], x["b"]) for x in rows] == [(10, 20)]  # 30 never raised
    x = rows[0].asDict()
    assert (x["bs_d_max"], x["bs_d_min"], x["bs_d_sum"], x["bs_d_asym"]) == (1.5, -1.0, 0.5, 2.5)  # 2.0 with 20 in less 0.5 without; -1.0 with 10 in
    assert (x["bs_with_min"], x["bs_with_max"], x["bs_with_peak"], x["bs_n_min"]) == (-1.0, 2.0, 2.0, 1)


def test_fitted_sizes_explain_more_than_means(spark):
    """Both halves are scored by the other's model, and its residuals are smaller than the sizes' own spread."""
    from duoscope.operators import boosting as B

    t = decisions.sizes(decisions.states(spark, SF)).withColumn("g_", F.col("hand").cast("string"))
    scored = B.cross_fit(t.select("hand", "g_", "size_", *decisions.FEATURES), list(decisions.FEATURES), "size_", "g_", B.Settings("squared", rounds=3, leaves=63, rate=0.3), folds=2)
    r = scored.agg(F.avg(F.pow(F.col("size_") - F.col("score"), 2)).alias("left"), F.var_pop("size_").alias("all"), F.countDistinct("fold").alias("folds")).first()
    assert r["folds"] == 2 and r["left"] < 0.9 * r["all"]
