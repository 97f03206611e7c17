"""Stand-ins of the permutation control, and quantiles by rank selection."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.operators.windows import group_quantiles
from duoscope.plans import isolation


@pytest.mark.parametrize("n", [3, 7, 30])
def test_stand_ins_form_one_cycle_without_fixed_points(spark, n):
    roster = spark.createDataFrame([(t, "p", 100 * t + i) for t in (1, 2) for i in range(n)] + [(3, "p", 900), (3, "p", 901)], "tbl long, phase string, actor long")
    pairs = roster.alias("x").join(roster.alias("y"), (F.col("x.tbl") == F.col("y.tbl")) & (F.col("x.actor") != F.col("y.actor"))).select(F.lit("p").alias("phase"), F.col("x.actor").alias("actor"), F.col("y.actor").alias("aggressor"))
    found = {}
    for r in isolation.stand_ins(pairs, roster, 5).collect():
        found.setdefault(r["actor"], {})[r["aggressor"]] = r["stand_in"]
    assert len(found) == 2 * n and not {900, 901} & set(found)
    for actor, to in found.items():
        assert actor not in to.values() and sorted(to) == sorted(to.values())
        at, seen = next(iter(to)), set()
        while at not in seen:
            seen.add(at)
            at = to[at]
        assert len(seen) == n - 1
    assert len({tuple(sorted(to.items())) for to in found.values()}) == 2 * n


def test_quantiles_by_rank(spark):
    rnd = random.Random(3)
    rows = [("a" if rnd.random() < 0.9 else rnd.choice("bc"), rnd.choice([None, rnd.random(), 0.5])) for _ in range(2000)] + [("d", None), ("e", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    qs = (0.0, 0.1, 0.5, 0.999, 1.0)
    got = {r["g"]: r["q_"] for r in group_quantiles(df, "x", qs, ["g"]).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    for g, values in got.items():
        own = [x for k, x in rows if k == g and x is not None]
        assert np.allclose(values, np.quantile(own, qs), atol=1e-12)
    whole = group_quantiles(df, "x", [0.25]).first()["q_"][0]
    assert math.isclose(whole, np.quantile([x for _, x in rows if x is not None], 0.25), abs_tol=1e-12)
    assert group_quantiles(df.limit(0), "x", qs, ["g"]).count() == 0


def test_quantiles_of_large_groups_are_exact(spark, monkeypatch):
    from duoscope.operators import windows as W

    monkeypatch.setattr(W, "LARGE_GROUP", 300)
    monkeypatch.setattr(W, "LEAST_SEEN", 100)
    rnd = random.Random(5)
    rows = [(g, x) for g, n in ((None, 3000), ("a", 4000), ("b", 60)) for x in [rnd.choice([0.0, rnd.gauss(0, 1), -5.0]) for _ in range(n)]]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5).cache()
    qs = (0.0, 0.25, 0.5, 0.999)
    for margin in (0.1, 1e-9):  # with hardly any margin a place falls into a gap
        monkeypatch.setattr(W, "MARGIN", margin)
        got = {r["g"]: r["q_"] for r in W.group_quantiles(df, "x", qs, ["g"]).collect()}
        assert got == {g: pytest.approx(np.quantile([x for k, x in rows if k == g], qs), abs=1e-12) for g in (None, "a", "b")}
        assert W.group_quantiles(df, "x", [0.25]).first()["q_"] == pytest.approx(np.quantile([x for _, x in rows], [0.25]), abs=1e-12)


def test_a_place_is_found_without_a_join_by_rank(spark):
    """A join by rank made Spark send every rank to all tasks where the written ranks were small files."""
    df = spark.range(5000).selectExpr("id % 2 AS g", "CAST(id % 7 AS DOUBLE) AS x")
    plan = group_quantiles(df, "x", [0.5], ["g"])
    assert "rank_" not in plan._jdf.queryExecution().toString()
    assert {r["g"]: r["q_"] for r in plan.collect()} == {0: [3.0], 1: [3.0]}
