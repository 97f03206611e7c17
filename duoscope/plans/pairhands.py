"""The wide pair-hand table, Spark's side: one row a seat, then one join of the seats with themselves on the hand.

Events are dealt by hand once. All that is needed of a seat, also what others answered to its raises, is gathered in that partitioning; what a pair
needs of outsiders is its two seats' totals less what they did to each other, so no join meets pairs with responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duoscope.operators.windows import before, last_before
from duoscope.plans import lens
from duoscope.plans.registry import query
from duoscope.runtime import materialize, read

Spark = SparkSession
STREETS = range(4)
KINDS = ("fold", "call", "raise")
MONEY = "decimal(18, 2)"


def flag(condition: Column) -> Column:
    """1 or 0; 0 for unknown."""
    return F.coalesce(condition, F.lit(False)).cast("long")


def exact_sum(x: Column, scale: int = 8) -> Column:
    """The sum as a double that does not depend on order: decimals of so many places are added."""
    return F.sum(x.cast(f"decimal(28, {scale})")).cast("double")


def exact_mean(x: Column, scale: int = 8) -> Column:
    return exact_sum(x, scale) / F.count(x)


def decisions(spark: Spark, sf: str) -> DataFrame:
    """Acts with street, the pot before, and target: whose raise is answered, if another's."""
    w, raiser = before(["hand"], ["no"]), F.when(F.col("act") == "raise", F.col("actor"))
    pot = F.coalesce(F.sum(F.col("amount").cast(MONEY)).over(w), F.lit(0)).cast("double")
    a = lens.acts(spark, sf).withColumns({"street": F.least("no", F.lit(3)), "pot": pot, "last_": last_before(raiser, ["hand"], ["no"])})
    return a.withColumn("target", F.when(F.col("last_") != F.col("actor"), F.col("last_"))).drop("last_")


_SUMS = ["n_act", "n_agg", "n_call", "n_fold", "post_act", "post_call", *[f"{p}_{k}" for k in STREETS for p in ("acted", "agg", "call")]]
_MOST = ["vpip", "pfr", "folded", "last_street", "max_amount", "max_pot"]


def answers(spark: Spark, sf: str) -> DataFrame:
    """One row for each actor of a hand and each whose raise it answers (null: its other acts), with counts."""
    act, street = F.col("act"), F.col("street")
    money = F.col("amount").cast(MONEY)
    n = {"n_act": F.lit(True), "n_agg": act == "raise", "n_call": act == "call", "n_fold": act == "fold", "post_act": street > 0, "post_call": (street > 0) & (act == "call")}
    for k in STREETS:
        n |= {f"acted_{k}": street == k, f"agg_{k}": (street == k) & (act == "raise"), f"call_{k}": (street == k) & (act == "call")}
    most = {"vpip": flag(act != "fold"), "pfr": flag((act == "raise") & (street == 0)), "folded": flag(act == "fold"), "last_street": street, "max_amount": F.col("amount"), "max_pot": F.col("pot")}
    return decisions(spark, sf).groupBy("hand", "actor", "target").agg(
        *[F.count_if(c).alias(k) for k, c in n.items()], *[F.max(c).alias(k) for k, c in most.items()],
        F.sum(money).alias("contrib"), F.sum(money * (1 - F.col("cut").cast("decimal(4, 2)"))).alias("revenue"),
        F.sum(F.when(act == "raise", F.col("amount") / (F.col("pot") + 1.0))).alias("agg_pot"), F.min(F.struct("no", "part")).alias("first"),
        F.min(F.when(act == "fold", F.struct("no", "street", "pot", "amount", F.col("target").alias("to")))).alias("fold"),
    )


def seat_rows(spark: Spark, sf: str) -> DataFrame:
    """One row for each actor of a hand, dealt by hand. answered: what others answered to its raises; means of the other phase are not in yet."""
    own = F.struct(F.col("actor").alias("key"), *[F.col(c) for c in (*_SUMS, *_MOST, "contrib", "revenue", "agg_pot", "first", "fold")], F.col("target").isNotNull().alias("facing"), F.lit(None).alias("answer"))
    answer = F.struct(F.col("actor").alias("by"), *[F.col(f"n_{c}").alias(k) for c, k in (("fold", "fold"), ("call", "call"), ("agg", "raise"))], F.col("max_amount").alias("most"))
    rows = answers(spark, sf)
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (*_SUMS, *_MOST, "contrib", "revenue", "agg_pot", "first", "fold")]
    theirs = F.struct(F.col("target").alias("key"), *none, F.lit(None).cast("boolean").alias("facing"), answer.alias("answer"))
    both = rows.select("hand", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, theirs))).alias("x")).select("hand", "x.*")
    met = F.coalesce(F.col("facing"), F.lit(False))
    t = both.groupBy("hand", F.col("key").alias("actor")).agg(
        *[F.sum(c).alias(c) for c in _SUMS], *[F.max(c).alias(c) for c in _MOST], F.sum("contrib").cast("double").alias("contrib"), F.sum("revenue").alias("revenue"),
        F.sum("agg_pot").alias("agg_pot"), F.min("first").alias("first"), F.min("fold").alias("fold_"), F.collect_list("answer").alias("answered"),
        *[F.coalesce(F.sum(F.when(met, F.col(c))), F.lit(0)).alias(k) for c, k in (("n_act", "n_facing"), ("n_fold", "n_fold_facing"), ("n_call", "n_call_facing"), ("n_agg", "n_raise_facing"))],
    )
    w = Window.partitionBy("hand")
    t = t.withColumns(
        {"net": F.col("revenue").cast("double") - F.sum("revenue").over(w).cast("double") / F.count(F.lit(1)).over(w), "mean_agg_pot": F.when(F.col("n_agg") > 0, F.col("agg_pot") / F.col("n_agg"))}
        | {f"active_{k}": F.count_if(F.col("last_street") >= k).over(w) for k in STREETS} | {f"raises_{k}": F.sum(f"agg_{k}").over(w) for k in STREETS}
        | {"fold_street": F.col("fold_.street"), "fold_pot": F.col("fold_.pot"), "fold_to_call": F.col("fold_.amount"), "fold_aggressor": F.col("fold_.to"), "fold_facing": flag(F.col("n_fold_facing") > 0)}
        | {"chen": F.col("first.part") % 21 - 1.0} | {f"str_{k}": (F.col("first.part") * (7 + 6 * k) + F.col("actor")) % 7462 / 7462.0 for k in (1, 2, 3)}
    ).drop("first", "fold_", "revenue", "agg_pot")
    table = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("actor"), F.col("s_nationkey").alias("tbl"))
    return t.join(table, "actor").join(lens.hands(spark, sf).select("hand", "phase", "started"), "hand")


BASE = ("b_vpip", "b_pfr", "b_agg_rate", "b_fold_facing", "b_call_facing", "b_raise_facing", "b_contrib", "b_net", "b_post_call", "b_saw")


#: Rows of means (an actor and phase each, some 150 bytes) that a task holds at most; more are joined.
MOST_MEANS = 1_000_000


def with_other_phase(seats: DataFrame, most: int = MOST_MEANS) -> DataFrame:
    """seats with the actor's means of the other phase. Up to `most` means go to the seats, which stay dealt by hand; more meet them by actor."""
    rate = lambda x, n: F.sum(x) / F.greatest(F.sum(n), F.lit(1)).cast("double")
    means = {
        "b_vpip": F.avg("vpip"), "b_pfr": F.avg("pfr"), "b_agg_rate": rate("n_agg", "n_act"), "b_contrib": exact_mean(F.col("contrib")), "b_net": exact_mean(F.col("net")), "b_post_call": rate("post_call", "post_act"),
        "b_saw": F.avg(flag(F.col("last_street") >= 1)), **{f"b_{k}_facing": rate(f"n_{k}_facing", "n_facing") for k in KINDS},
    }
    other = F.when(F.col("phase") == "development", "evaluation").otherwise("development")
    base = materialize(seats.groupBy("actor", other.alias("phase")).agg(*[means[b].alias(b) for b in BASE]), "means")
    few = base.limit(most + 1).count() <= most
    return seats.join(F.broadcast(base) if few else base.hint("merge"), ["actor", "phase"], "left")


_SIDE = ["n_act", "n_agg", "n_call", "n_fold", "vpip", "pfr", "folded", "last_street", "max_amount", "max_pot", "contrib", "mean_agg_pot", "post_act", "post_call", "fold_street", "n_facing", "n_fold_facing", "n_call_facing", "n_raise_facing"]
_SIDE += ["fold_facing", "fold_pot", "fold_to_call", "fold_aggressor", "net", "chen", "str_1", "str_2", "str_3", *[f"{p}_{k}" for k in STREETS for p in ("acted", "agg", "call")]]


def wide(spark: Spark, sf: str, base: bool = True, written: bool = False) -> DataFrame:
    """One row for each pair and hand in which either took part. Columns of the sides start with A_ and B_.

    Both sides are made from the acts as these are dealt by hand: seats are neither dealt again nor written unless asked for, and what
    a query does not take of them is not made.
    """
    seats = materialize(seat_rows(spark, sf), "seats") if written else seat_rows(spark, sf)
    seats = with_other_phase(seats) if base else seats
    more = list(BASE) if base else []
    side = lambda s, keep: seats.select("hand", *keep, *[F.col(c).alias(f"{s}_{c}") for c in ("actor", *_SIDE, "answered")], *[F.col(c).alias(f"{s}{c}") for c in more])
    a = side("A", ["phase", "started", "tbl", *[f"{n}_{k}" for n in ("active", "raises") for k in STREETS]])
    t = a.join(side("B", []), "hand").filter((F.col("A_actor") < F.col("B_actor")) & ((F.col("A_vpip") == 1) | (F.col("B_vpip") == 1)))
    return _derived(t.withColumnsRenamed({"A_actor": "a", "B_actor": "b"}), base)


def _derived(t: DataFrame, base: bool) -> DataFrame:
    c, zero = F.col, F.lit(0)
    names = {"A": "a", "B": "b"}
    of = lambda x, y: F.get(F.filter(c(f"{y}_answered"), lambda r: r["by"] == c(names[x])), F.lit(0))  # noqa: E731  what x answered to y's raises
    total = lambda x, k: F.aggregate(f"{x}_answered", F.lit(0).cast("long"), lambda s, r: s + r[k])
    t = t.withColumns({"AB_": of("A", "B"), "BA_": of("B", "A")})
    one = {f"r{s}_{k}": F.coalesce(c(f"{s}_")[k], zero) for s in ("AB", "BA") for k in (*KINDS, "most")}
    t = t.withColumns(one)
    two = {f"out_{k}": total("A", k) - c(f"rBA_{k}") + total("B", k) - c(f"rAB_{k}") for k in KINDS}
    two |= {f"pair_{k}": c(f"A_n_{k}_facing") - c(f"rAB_{k}") + c(f"B_n_{k}_facing") - c(f"rBA_{k}") for k in KINDS}
    outsiders = F.array_except(F.array_union(*[F.transform(f"{s}_answered", lambda r: r["by"]) for s in "AB"]), F.array("a", "b"))
    together = [(c(f"A_acted_{k}") > 0) & (c(f"B_acted_{k}") > 0) & (c(f"active_{k}") == 2) for k in STREETS]
    two |= {
        "out_responders": F.size(outsiders).cast("long"), "rAB_n": sum((c(f"rAB_{k}") for k in KINDS), zero), "rBA_n": sum((c(f"rBA_{k}") for k in KINDS), zero),
        "hu_streets": sum((flag(x) for x in together), zero), "both_passive_hu": sum((flag(x & (c(f"raises_{k}") == 0)) for k, x in zip(STREETS, together)), zero),
        "war_streets": sum((flag((c(f"A_agg_{k}") > 0) & (c(f"B_agg_{k}") > 0) & (c(f"active_{k}") > 2)) for k in STREETS), zero),
        "both_vpip": flag((c("A_vpip") == 1) & (c("B_vpip") == 1)), "both_flop": flag((c("A_last_street") >= 1) & (c("B_last_street") >= 1)),
        "net_gap": F.abs(c("A_net") - c("B_net")), "pair_contrib": c("A_contrib") + c("B_contrib"), "contrib_gap": F.abs(c("A_contrib") - c("B_contrib")),
        "chen_diff": c("A_chen") - c("B_chen"), "chen_max": F.greatest("A_chen", "B_chen"), "chen_min": F.least("A_chen", "B_chen"), "river_margin": c("A_str_3") - c("B_str_3"), "dropouts": F.greatest(c("active_0") - c("active_1"), zero),
    }
    for x, y in (("A", "B"), ("B", "A")):
        margin = F.when(c(f"{x}_fold_street") == 0, (c(f"{x}_chen") - c(f"{y}_chen")) / 20.0)
        for k in (1, 2, 3):
            margin = margin.when(c(f"{x}_fold_street") == k, c(f"{x}_str_{k}") - c(f"{y}_str_{k}"))
        two |= {f"tr_{x}_to_{y}": F.least(F.greatest(-c(f"{x}_net"), F.lit(0.0)), F.greatest(c(f"{y}_net"), F.lit(0.0))), f"{x}_fold_to_{y}": flag(c(f"{x}_fold_aggressor") == c(names[y])), f"{x}_fold_margin": margin}
    t = t.withColumns(two)
    gap = F.abs(c("tr_A_to_B") - c("tr_B_to_A"))
    three = {
        "tr_any": F.greatest("tr_A_to_B", "tr_B_to_A"), "tr_dir": c("tr_A_to_B") - c("tr_B_to_A"), "tr_imbalance": gap / (c("tr_A_to_B") + c("tr_B_to_A") + 1.0), "iso_balance": c("out_fold") - c("pair_fold"),
        "war_then_out_folds": F.when(c("war_streets") > 0, c("out_fold")).otherwise(zero),
    }
    for x, y in (("A", "B"), ("B", "A")):
        own = lambda k, x=x: c(f"{x}_{k}")
        to, raised = own(f"fold_to_{y}") == 1, own("n_agg") > 0
        three |= {
            f"{x}_fold_after_war": flag(to & (own("fold_facing") == 1) & (c("war_streets") > 0)), f"{x}_fold_to_other": flag((own("fold_facing") == 1) & ~to), f"{x}_folded_better": flag(to & (own("fold_margin") > 0)),
            f"{x}_fold_pot_odds": own("fold_to_call") / (own("fold_pot") + own("fold_to_call") + 1e-3), f"{x}_fold_ev_loss": own("fold_margin") * own("fold_pot"),
            f"{x}_agg_then_fold": flag(raised & (own("folded") == 1)), f"{x}_built_pot": flag(raised & (own("folded") == 1) & (c(f"{y}_folded") == 0)),
            f"{x}_passive_hu": flag((c("hu_streets") > 0) & ~raised & (own("last_street") >= 1)),
        }
        if base:
            share = lambda n, d, x=x: own(n, x) / F.greatest(own(d, x), F.lit(1)).cast("double")
            three |= {
                f"{x}_dev_vpip": own("vpip") - c(f"{x}b_vpip"), f"{x}_dev_agg": share("n_agg", "n_act") - c(f"{x}b_agg_rate"),
                f"{x}_dev_fold_facing": own("fold_facing") - c(f"{x}b_fold_facing"), f"{x}_dev_post_call": share("post_call", "post_act") - c(f"{x}b_post_call"),
            }
    return t.withColumns(three)


_WHOLE = [f"{s}_{c}" for s in "AB" for c in _SIDE if c not in ("max_amount", "max_pot", "contrib", "mean_agg_pot", "fold_pot", "fold_to_call", "net", "chen", "str_1", "str_2", "str_3")]
_WHOLE += [f"r{s}_{c}" for s in ("AB", "BA") for c in (*KINDS, "n")] + [f"{c}_{k}" for k in STREETS for c in ("active", "raises")]
_WHOLE += [f"{s}_{k}" for s in ("out", "pair") for k in KINDS] + ["out_responders", "hu_streets", "both_passive_hu", "war_streets", "A_fold_to_B", "B_fold_to_A", "both_vpip", "both_flop", "iso_balance", "dropouts", "war_then_out_folds"]
_WHOLE += [f"{s}_{c}" for s in "AB" for c in ("fold_after_war", "fold_to_other", "folded_better", "agg_then_fold", "built_pot", "passive_hu")]
_REAL = [f"{s}_{c}" for s in "AB" for c in ("max_amount", "max_pot", "contrib", "mean_agg_pot", "fold_pot", "fold_to_call", "net", "chen", "str_1", "str_2", "str_3", "fold_margin", "fold_pot_odds", "fold_ev_loss")]
_REAL += [f"{s}_dev_{c}" for s in "AB" for c in ("vpip", "agg", "fold_facing", "post_call")] + [f"{s}{c}" for s in "AB" for c in BASE]
_REAL += ["tr_A_to_B", "tr_B_to_A", "tr_any", "tr_dir", "tr_imbalance", "net_gap", "pair_contrib", "contrib_gap", "chen_diff", "chen_max", "chen_min", "river_margin", "rAB_most", "rBA_most"]


def columns(whole: list[str], real: list[str]) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in whole] + [F.col(c).cast("double").alias(c) for c in real]


@query()
def q06_pair_hands(spark: Spark, sf: str) -> DataFrame:
    """Both seats by street, answers both ways and to outsiders, means of the other phase, and all that follows, for each pair and hand in which either took part."""
    return wide(spark, sf).select("hand", "a", "b", "phase", *columns(_WHOLE, _REAL))


@query()
def pk20_transfer(spark: Spark, sf: str) -> DataFrame:
    """What one side lost and the other gained in a hand, both ways, direction and imbalance."""
    return wide(spark, sf, base=False).select("hand", "a", "b", *columns([], ["tr_A_to_B", "tr_B_to_A", "tr_any", "tr_dir", "tr_imbalance", "net_gap"]))


@query()
def pk21_fold_margin(spark: Spark, sf: str) -> DataFrame:
    """The folder's strength against the partner's at the street of its fold, the pot odds it had and the value it gave up."""
    found = wide(spark, sf, base=False).filter("A_folded = 1 or B_folded = 1")
    return found.select("hand", "a", "b", *columns([f"{s}_{c}" for s in "AB" for c in ("fold_street", "folded_better")], [f"{s}_{c}" for s in "AB" for c in ("fold_margin", "fold_pot_odds", "fold_ev_loss")]))


@query()
def pk24_deviation(spark: Spark, sf: str) -> DataFrame:
    """A side's behaviour in a hand against its own mean of the other phase; null where it has none there."""
    return wide(spark, sf).select("hand", "a", "b", *columns([], [f"{s}_dev_{c}" for s in "AB" for c in ("vpip", "agg", "fold_facing", "post_call")]))


@query()
def pk25_fold_account(spark: Spark, sf: str) -> DataFrame:
    """Of each pair: how often each folds, to whom, at which street, after putting in how much, with what left in the pot."""
    out = [F.count(F.lit(1)).alias("hands")]
    for s, o in (("A", "B"), ("B", "A")):
        lost = lambda x, when: F.coalesce(exact_sum(F.when(when, F.col(x)), 2), F.lit(0.0))
        out += [F.sum(f"{s}_{c}").alias(f"{s}_{n}") for c, n in (("folded", "folds"), (f"fold_to_{o}", "to_partner"), ("fold_to_other", "to_others"))]
        out += [F.count_if(F.col(f"{s}_fold_street") == k).alias(f"{s}_folds_{k}") for k in STREETS]
        out += [lost(f"{s}_contrib", F.col(f"{s}_folded") == 1).alias(f"{s}_lost"), lost(f"{s}_fold_pot", F.col(f"{s}_fold_to_{o}") == 1).alias(f"{s}_left")]
    return wide(spark, sf, base=False).groupBy("a", "b").agg(*out)
