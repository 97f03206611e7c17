"""What grows with the tables: how often a plan reads the lines, and what it deals."""

from duoscope.plans import registry

SF = "/root/testdata/sf0.001"


def readings(df, key="l_orderkey"):
    """How often the plan reads the table of that key."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"Relation [{key}")


def test_skeleton_meets_hands_once(spark):
    assert readings(registry.QUERIES["jn18_skeleton"](spark, SF)) == 1


def test_pairs_are_made_from_seats_once(spark):
    for name in ("st04_ordered_pairs", "md14_merged_seeds", "mt14_gate"):
        assert readings(registry.QUERIES[name](spark, SF)) == 1, name


def windows_by(df, key):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line and f"windowspecdefinition({key}#" in line]


def test_ranks_in_large_groups_come_from_counts(spark):
    assert not windows_by(registry.QUERIES["wn08_shrunk_percentile"](spark, SF), "tbl")
    assert not windows_by(registry.QUERIES["wn26_rank_in_tier"](spark, SF), "label")


def test_counted_rank_is_the_average_rank(spark):
    from pyspark.sql import functions as F

    from duoscope.operators import windows as W

    rows = [(g, x) for g in (None, 1, 2) for x in (5.0, 3.0, 3.0, None, float(g or 9), 7.0, 7.0, 7.0)] + [(3, None)]
    t = spark.createDataFrame(rows, "g int, x double").withColumn("id", F.monotonically_increasing_id()).localCheckpoint()
    want = {r["id"]: (r["r"], r["n"], r["rows"]) for r in t.selectExpr("*", "count(x) over (partition by g) as n", "count(*) over (partition by g) as rows").withColumn("r", W.average_rank(F.col("x"), ["g"])).collect()}
    got = {r["id"]: (r["rank_"], r["n_"], r["rows_"]) for r in W.counted_rank(t, "x", ["g"]).collect()}
    assert got == want


def test_top_fraction_has_no_limit_in_one_task(spark):
    plan = registry.QUERIES["tk04_top_fraction"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan


def plan_of(name, spark):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_contrasts_join_on_what_seats_were_dealt_by(spark):
    joins = [line for line in plan_of("q14_presence_contrast", spark).splitlines() if "Join " in line]
    assert joins and all("q5#" not in line and "hand#" not in line and "phase#" in line for line in joins)


def test_pooled_scores_are_made_without_a_join(spark):
    """The wide rows come from written seats, so only a join with scores would read the lines."""
    assert readings(registry.QUERIES["q18_pooled"](spark, SF)) == 0


def test_wide_seats_are_not_dealt_by_actor(spark):
    for name in ("q06_pair_hands", "pk24_deviation"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(actor#" not in plan and "hashpartitioning(hand#" in plan, name


def test_means_of_the_other_phase_may_be_too_many_to_hold(spark):
    from duoscope.plans import pairhands as P

    seats = P.seat_rows(spark, SF).drop("answered").localCheckpoint()
    held, met = P.with_other_phase(seats), P.with_other_phase(seats, most=3)
    assert held.exceptAll(met).isEmpty() and met.exceptAll(held).isEmpty() and held.filter("b_net is not null").count() > 0


def test_quantile_flags_are_made_where_pairs_are_dealt(spark):
    joins = [line for line in plan_of("wn16_quantile_flag", spark).splitlines() if "Join " in line]
    assert joins and all("pair_id#" not in line for line in joins)


def test_context_meets_no_pairs_with_hands(spark):
    plan = plan_of("q19_context", spark)
    assert readings(registry.QUERIES["q19_context"](spark, SF)) == 1
    assert all("pair_id#" not in line for line in plan.splitlines() if "Join " in line)


def test_mirror_ranks_pairs_in_one_sort(spark, monkeypatch):
    from duoscope import runtime

    written = []
    monkeypatch.setattr(runtime, "materialize", lambda df, name, f=runtime.materialize: written.append(name) or f(df, name))
    assert registry.QUERIES["mt10_mirror"](spark, SF).count() == 1
    assert written == ["ranges", "ranges"]  # all pairs, then the positives
    assert "median(" not in plan_of("mt10_mirror", spark)


def test_timelines_are_dealt_by_actors(spark):
    for name in ("q37_slot_decoder", "q38_level_decoder", "q41_redirected"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(pair_id#" not in plan and "hashpartitioning(a#" in plan, name


def test_dominance_makes_no_row_for_each_player(spark):
    plan = plan_of("q17_dominance", spark)
    assert "player#" not in plan.replace("players#", "") and len(windows_by(registry.QUERIES["q17_dominance"](spark, SF), "a")) == 1


def test_contrasts_are_compiled(spark):
    """The JVM only interprets methods of over 8,000 bytes; the contrasts' sums, terms and aggregates were one such."""
    import re

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = registry.QUERIES["q14_presence_contrast"](spark, SF)
        text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8000
