"""SQL of the wide pair-hand table and of what is made of it, for the engine that results are compared with.

Spark's side is written apart from it, in pairhands.py and pairviews.py. So that no result depends on the order of a sum, both sides sum amounts
as decimals of their own scale, and other reals as decimals of six, eight or nine places or as whole millionths; no result is rounded or shifted after that.
"""

from __future__ import annotations

from duoscope.plans import composite, lens
from duoscope.plans.registry import ORACLE_SQL

_NAMED = "WITH " + lens.PAIR_HANDS_SQL + lens.RESPONSES_SQL[len(lens.ACTS_SQL + ", " + lens.HANDS_SQL) :] + composite._FREQ
_NAMED += lens.SCORES_SQL[len(lens.PAIR_HANDS_SQL) :] + lens.PAIRS_SQL[len(lens.PAIR_HANDS_SQL) :]
_FRAMES = ("acts", "hands", "responses", "seats", "pair_hands", "hand_scores", "pairs", "sp")


def oracle(name: str, steps: list[tuple[str, str]], last: str) -> None:
    """The SQL of a query: named steps in order and a last statement; {acts} and so on stand for the lens's frames."""
    body = ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in steps)
    ORACLE_SQL[name] = f"{_NAMED}{', ' if body else ' '}{body} {last}".format(**{k: k for k in _FRAMES})


def double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def nearest(x: str) -> str:
    """The double nearest to a decimal; a plain cast divides twice-rounded numbers."""
    return f"CAST(CAST({x} AS VARCHAR) AS DOUBLE)"


def exact_sum(x: str, scale: int = 8) -> str:
    return nearest(f"sum(CAST({x} AS DECIMAL(28, {scale})))")


def exact_mean(x: str, scale: int = 8) -> str:
    return f"{exact_sum(x, scale)} / count({x})"


def count(condition: str) -> str:
    return f"sum(CASE WHEN {condition} THEN 1 ELSE 0 END)"


STREETS = range(4)
_CALLS_LATER = "street > 0 AND act = 'call'"
#: The parts of a seat: its acts by street, how it answers raises, its first fold, and strengths by street.
SEAT = [
    ("pot", "SELECT hand, no, actor, part, act, amount, size, cut, least(no, 3) AS street, CAST(coalesce(sum(CAST(amount AS DECIMAL(18, 2))) OVER (PARTITION BY hand ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS pot FROM {acts}"),
    (
        "st",
        "SELECT hand, actor, count(*) AS n_act, " + ", ".join(f"{count(f'act = {a!r}')} AS {n}" for a, n in (("raise", "n_agg"), ("call", "n_call"), ("fold", "n_fold")))
        + ", max(CASE WHEN act <> 'fold' THEN 1 ELSE 0 END) AS vpip, max(CASE WHEN act = 'raise' AND street = 0 THEN 1 ELSE 0 END) AS pfr, max(CASE WHEN act = 'fold' THEN 1 ELSE 0 END) AS folded, "
        + "max(street) AS last_street, max(amount) AS max_amount, max(pot) AS max_pot, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS contrib, sum(CAST(amount AS DECIMAL(18, 2)) * (1 - CAST(cut AS DECIMAL(4, 2)))) AS revenue, avg(CASE WHEN act = 'raise' THEN amount / (pot + 1.0) END) AS mean_agg_pot, "
        + f"{count('street > 0')} AS post_act, {count(_CALLS_LATER)} AS post_call, "
        + "min(CASE WHEN act = 'fold' THEN street END) AS fold_street, min(CASE WHEN act = 'fold' THEN no END) AS fold_no, min_by(part, no) AS card, "
        + ", ".join(f"{count(f'street = {k}')} AS acted_{k}, {count(f'street = {k} AND act = {chr(39)}raise{chr(39)}')} AS agg_{k}, {count(f'street = {k} AND act = {chr(39)}call{chr(39)}')} AS call_{k}" for k in STREETS)
        + " FROM pot GROUP BY hand, actor",
    ),
    ("fo", f"SELECT hand, actor, count(*) AS n_facing, {count('act = ' + repr('fold'))} AS n_fold_facing, {count('act = ' + repr('call'))} AS n_call_facing, {count('act = ' + repr('raise'))} AS n_raise_facing FROM {{responses}} GROUP BY hand, actor"),
    ("fl", "SELECT p.hand, p.actor, p.pot AS fold_pot, p.amount AS fold_to_call, r.aggressor AS fold_aggressor FROM st s JOIN pot p ON p.hand = s.hand AND p.no = s.fold_no LEFT JOIN {responses} r ON r.hand = p.hand AND r.no = p.no"),
    (
        "seat",
        "SELECT st.*, coalesce(n_facing, 0) AS n_facing, coalesce(n_fold_facing, 0) AS n_fold_facing, coalesce(n_call_facing, 0) AS n_call_facing, coalesce(n_raise_facing, 0) AS n_raise_facing, "
        + "CASE WHEN coalesce(n_fold_facing, 0) > 0 THEN 1 ELSE 0 END AS fold_facing, fold_pot, fold_to_call, fold_aggressor, CAST(st.revenue AS DOUBLE) - CAST(sum(st.revenue) OVER (PARTITION BY st.hand) AS DOUBLE) / count(*) OVER (PARTITION BY st.hand) AS net, z.phase, z.tbl, z.started, "
        + "(st.card % 21) - 1.0 AS chen, " + ", ".join(f"((st.card * {7 + 6 * k} + st.actor) % 7462) / 7462.0 AS str_{k}" for k in (1, 2, 3))
        + " FROM st JOIN {seats} z ON z.hand = st.hand AND z.actor = st.actor LEFT JOIN fo ON fo.hand = st.hand AND fo.actor = st.actor LEFT JOIN fl ON fl.hand = st.hand AND fl.actor = st.actor",
    ),
]
#: An actor's baseline in each phase; pairs take those of the other phase.
BASE_COLUMNS = {
    "b_vpip": "avg(vpip)", "b_pfr": "avg(pfr)", "b_agg_rate": "sum(n_agg) / CAST(greatest(sum(n_act), 1) AS DOUBLE)", "b_fold_facing": "sum(n_fold_facing) / CAST(greatest(sum(n_facing), 1) AS DOUBLE)",
    "b_call_facing": "sum(n_call_facing) / CAST(greatest(sum(n_facing), 1) AS DOUBLE)", "b_raise_facing": "sum(n_raise_facing) / CAST(greatest(sum(n_facing), 1) AS DOUBLE)", "b_contrib": exact_mean("contrib"), "b_net": exact_mean("net"),
    "b_post_call": "sum(post_call) / CAST(greatest(sum(post_act), 1) AS DOUBLE)", "b_saw": "avg(CASE WHEN last_street >= 1 THEN 1.0 ELSE 0.0 END)",
}
BASE = ("base", "SELECT actor, CASE phase WHEN 'development' THEN 'evaluation' ELSE 'development' END AS for_phase, " + ", ".join(f"{v} AS {k}" for k, v in BASE_COLUMNS.items()) + " FROM seat GROUP BY actor, phase")
LEVELS = ("lv", "SELECT hand, " + ", ".join(f"count(DISTINCT CASE WHEN street >= {k} THEN actor END) AS active_{k}, {count(f'street = {k} AND act = {chr(39)}raise{chr(39)}')} AS raises_{k}" for k in STREETS) + " FROM pot GROUP BY hand")
RESPONSES = ("rs", "SELECT hand, actor, aggressor, " + ", ".join(f"{count(f'act = {a!r}')} AS r_{a}" for a in ("fold", "call", "raise")) + ", max(amount) AS r_most FROM {responses} GROUP BY hand, actor, aggressor")
OUTSIDE = [
    ("o1", "SELECT p.hand, p.a, p.b, sum(r_fold) AS out_fold, sum(r_call) AS out_call, sum(r_raise) AS out_raise, count(DISTINCT r.actor) AS out_responders FROM {pair_hands} p JOIN rs r ON r.hand = p.hand AND (r.aggressor = p.a OR r.aggressor = p.b) AND r.actor <> p.a AND r.actor <> p.b GROUP BY p.hand, p.a, p.b"),
    ("o2", "SELECT p.hand, p.a, p.b, sum(r_fold) AS pair_fold, sum(r_call) AS pair_call, sum(r_raise) AS pair_raise FROM {pair_hands} p JOIN rs r ON r.hand = p.hand AND (r.actor = p.a OR r.actor = p.b) AND r.aggressor <> p.a AND r.aggressor <> p.b GROUP BY p.hand, p.a, p.b"),
]
_SIDE = ["n_act", "n_agg", "n_call", "n_fold", "vpip", "pfr", "folded", "last_street", "max_amount", "max_pot", "contrib", "mean_agg_pot", "post_act", "post_call", "fold_street", "n_facing", "n_fold_facing", "n_call_facing", "n_raise_facing", "fold_facing", "fold_pot", "fold_to_call", "fold_aggressor", "net", "chen", "str_1", "str_2", "str_3"]
_SIDE += [f"{p}_{k}" for k in STREETS for p in ("acted", "agg", "call")]


def _each_side(text: str) -> str:
    """A column for A and its mirror image for B; {x} and {y} are the sides."""
    return ", ".join(text.format(x=x, y=y) for x, y in (("A", "B"), ("B", "A")))


_HEADS_UP = " + ".join(f"CASE WHEN A_acted_{k} > 0 AND B_acted_{k} > 0 AND active_{k} = 2 THEN 1 ELSE 0 END" for k in STREETS)
_PASSIVE = " + ".join(f"CASE WHEN A_acted_{k} > 0 AND B_acted_{k} > 0 AND active_{k} = 2 AND raises_{k} = 0 THEN 1 ELSE 0 END" for k in STREETS)
_WAR = " + ".join(f"CASE WHEN A_agg_{k} > 0 AND B_agg_{k} > 0 AND active_{k} > 2 THEN 1 ELSE 0 END" for k in STREETS)
_MARGIN = "CASE {x}_fold_street " + " ".join(f"WHEN {k} THEN {{x}}_str_{k} - {{y}}_str_{k}" for k in (1, 2, 3)) + " WHEN 0 THEN ({x}_chen - {y}_chen) / 20.0 END AS {x}_fold_margin"
WIDE = [
    *SEAT, BASE, LEVELS, RESPONSES, *OUTSIDE,
    (
        "w0",
        "SELECT p.hand, p.a, p.b, p.phase, p.started, a.tbl, " + ", ".join(f"a.{c} AS A_{c}, b.{c} AS B_{c}" for c in _SIDE) + ", " + ", ".join(f"active_{k}, raises_{k}" for k in STREETS) + ", "
        + ", ".join(f"coalesce({r}.r_{c}, 0) AS r{s}_{c}" for r, s in (("ab", "AB"), ("ba", "BA")) for c in ("fold", "call", "raise", "most")) + ", "
        + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("out_fold", "out_call", "out_raise", "out_responders", "pair_fold", "pair_call", "pair_raise")) + ", "
        + ", ".join(f"x.{c} AS A{c}, y.{c} AS B{c}" for c in BASE_COLUMNS)
        + " FROM {pair_hands} p JOIN seat a ON a.hand = p.hand AND a.actor = p.a JOIN seat b ON b.hand = p.hand AND b.actor = p.b JOIN lv ON lv.hand = p.hand"
        + " LEFT JOIN rs ab ON ab.hand = p.hand AND ab.actor = p.a AND ab.aggressor = p.b LEFT JOIN rs ba ON ba.hand = p.hand AND ba.actor = p.b AND ba.aggressor = p.a"
        + " LEFT JOIN o1 ON o1.hand = p.hand AND o1.a = p.a AND o1.b = p.b LEFT JOIN o2 ON o2.hand = p.hand AND o2.a = p.a AND o2.b = p.b"
        + " LEFT JOIN base x ON x.actor = p.a AND x.for_phase = p.phase LEFT JOIN base y ON y.actor = p.b AND y.for_phase = p.phase WHERE a.vpip = 1 OR b.vpip = 1",
    ),
    (
        "w1",
        f"SELECT w0.*, {_HEADS_UP} AS hu_streets, {_PASSIVE} AS both_passive_hu, {_WAR} AS war_streets, " + _each_side("CASE WHEN {x}_fold_aggressor = " + "{y}_id THEN 1 ELSE 0 END AS {x}_fold_to_{y}").replace("A_id", "a").replace("B_id", "b")
        + ", CASE WHEN A_vpip = 1 AND B_vpip = 1 THEN 1 ELSE 0 END AS both_vpip, CASE WHEN A_last_street >= 1 AND B_last_street >= 1 THEN 1 ELSE 0 END AS both_flop, "
        + _each_side("least(greatest(-{x}_net, 0.0), greatest({y}_net, 0.0)) AS tr_{x}_to_{y}") + ", abs(A_net - B_net) AS net_gap, A_contrib + B_contrib AS pair_contrib, abs(A_contrib - B_contrib) AS contrib_gap, "
        + "A_chen - B_chen AS chen_diff, greatest(A_chen, B_chen) AS chen_max, least(A_chen, B_chen) AS chen_min, rAB_fold + rAB_call + rAB_raise AS rAB_n, rBA_fold + rBA_call + rBA_raise AS rBA_n, A_str_3 - B_str_3 AS river_margin, "
        + _each_side(_MARGIN) + ", out_fold - pair_fold AS iso_balance, greatest(active_0 - active_1, 0) AS dropouts FROM w0",
    ),
    (
        "wide",
        "SELECT w1.*, greatest(tr_A_to_B, tr_B_to_A) AS tr_any, tr_A_to_B - tr_B_to_A AS tr_dir, abs(tr_A_to_B - tr_B_to_A) / (tr_A_to_B + tr_B_to_A + 1.0) AS tr_imbalance, CASE WHEN war_streets > 0 THEN out_fold ELSE 0 END AS war_then_out_folds, "
        + _each_side(
            "CASE WHEN {x}_fold_to_{y} = 1 AND {x}_fold_facing = 1 AND war_streets > 0 THEN 1 ELSE 0 END AS {x}_fold_after_war, CASE WHEN {x}_fold_facing = 1 AND {x}_fold_to_{y} = 0 THEN 1 ELSE 0 END AS {x}_fold_to_other, "
            "CASE WHEN {x}_fold_to_{y} = 1 AND {x}_fold_margin > 0 THEN 1 ELSE 0 END AS {x}_folded_better, {x}_fold_to_call / ({x}_fold_pot + {x}_fold_to_call + 1e-3) AS {x}_fold_pot_odds, {x}_fold_margin * {x}_fold_pot AS {x}_fold_ev_loss, "
            "CASE WHEN {x}_n_agg > 0 AND {x}_folded = 1 THEN 1 ELSE 0 END AS {x}_agg_then_fold, CASE WHEN {x}_n_agg > 0 AND {x}_folded = 1 AND {y}_folded = 0 THEN 1 ELSE 0 END AS {x}_built_pot, "
            "CASE WHEN hu_streets > 0 AND {x}_n_agg = 0 AND {x}_last_street >= 1 THEN 1 ELSE 0 END AS {x}_passive_hu, {x}_vpip - {x}b_vpip AS {x}_dev_vpip, "
            "{x}_n_agg / CAST(greatest({x}_n_act, 1) AS DOUBLE) - {x}b_agg_rate AS {x}_dev_agg, {x}_fold_facing - {x}b_fold_facing AS {x}_dev_fold_facing, {x}_post_call / CAST(greatest({x}_post_act, 1) AS DOUBLE) - {x}b_post_call AS {x}_dev_post_call"
        )
        + " FROM w1",
    ),
]
_WHOLE = [f"{s}_{c}" for s in "AB" for c in _SIDE if c not in ("max_amount", "max_pot", "contrib", "mean_agg_pot", "fold_pot", "fold_to_call", "net", "chen", "str_1", "str_2", "str_3")]
_WHOLE += [f"r{s}_{c}" for s in ("AB", "BA") for c in ("fold", "call", "raise", "n")] + [f"{c}_{k}" for k in STREETS for c in ("active", "raises")]
_WHOLE += ["out_fold", "out_call", "out_raise", "out_responders", "pair_fold", "pair_call", "pair_raise", "hu_streets", "both_passive_hu", "war_streets", "A_fold_to_B", "B_fold_to_A", "both_vpip", "both_flop", "iso_balance", "dropouts", "war_then_out_folds"]
_WHOLE += [f"{s}_{c}" for s in "AB" for c in ("fold_after_war", "fold_to_other", "folded_better", "agg_then_fold", "built_pot", "passive_hu")]
_REAL = [f"{s}_{c}" for s in "AB" for c in ("max_amount", "max_pot", "contrib", "mean_agg_pot", "fold_pot", "fold_to_call", "net", "chen", "str_1", "str_2", "str_3", "fold_margin", "fold_pot_odds", "fold_ev_loss", "dev_vpip", "dev_agg", "dev_fold_facing", "dev_post_call")]
_REAL += [f"{s}{c}" for s in "AB" for c in BASE_COLUMNS] + ["tr_A_to_B", "tr_B_to_A", "tr_any", "tr_dir", "tr_imbalance", "net_gap", "pair_contrib", "contrib_gap", "chen_diff", "chen_max", "chen_min", "river_margin", "rAB_most", "rBA_most"]


def _columns(whole: list[str], real: list[str]) -> str:
    return ", ".join([f"CAST({c} AS BIGINT) AS {c}" for c in whole] + [f"{double(c)} AS {c}" for c in real])


#: Both seats of a pair, for statements that need no more of the wide table.
_BOTH = "FROM {pair_hands} p JOIN seat a ON a.hand = p.hand AND a.actor = p.a JOIN seat b ON b.hand = p.hand AND b.actor = p.b"
_TAKEN = "(a.vpip = 1 OR b.vpip = 1)"

oracle("q06_pair_hands", WIDE, f"SELECT hand, a, b, phase, {_columns(_WHOLE, _REAL)} FROM wide")
oracle(
    "pk20_transfer", [*SEAT, ("f", f"SELECT p.hand, p.a, p.b, least(greatest(-a.net, 0.0), greatest(b.net, 0.0)) AS ab, least(greatest(-b.net, 0.0), greatest(a.net, 0.0)) AS ba, abs(a.net - b.net) AS net_gap {_BOTH} WHERE {_TAKEN}")],
    "SELECT hand, a, b, ab AS tr_A_to_B, ba AS tr_B_to_A, greatest(ab, ba) AS tr_any, ab - ba AS tr_dir, abs(ab - ba) / (ab + ba + 1.0) AS tr_imbalance, net_gap FROM f",
)
_SIDE_MARGIN = "CASE {x}.fold_street WHEN 0 THEN ({x}.chen - {y}.chen) / 20.0 " + " ".join(f"WHEN {k} THEN {{x}}.str_{k} - {{y}}.str_{k}" for k in (1, 2, 3)) + " END"
oracle(
    "pk21_fold_margin",
    [*SEAT, ("m", "SELECT p.hand, p.a, p.b, " + ", ".join(f"{x}.fold_street AS {s}_street, {_SIDE_MARGIN.format(x=x, y=y)} AS {s}_margin, {x}.fold_pot AS {s}_pot, {x}.fold_to_call AS {s}_call, {x}.fold_aggressor = p.{y} AS {s}_to" for s, x, y in (("A", "a", "b"), ("B", "b", "a"))) + f" {_BOTH} WHERE {_TAKEN} AND (a.folded = 1 OR b.folded = 1)")],
    "SELECT hand, a, b, " + ", ".join(f"CAST({s}_street AS BIGINT) AS {s}_fold_street, CAST(CASE WHEN {s}_to AND {s}_margin > 0 THEN 1 ELSE 0 END AS BIGINT) AS {s}_folded_better, {s}_margin AS {s}_fold_margin, {s}_call / ({s}_pot + {s}_call + 1e-3) AS {s}_fold_pot_odds, {s}_margin * {s}_pot AS {s}_fold_ev_loss" for s in "AB") + " FROM m",
)
_DEV = {"vpip": "{x}.vpip - {z}.b_vpip", "agg": "{x}.n_agg / CAST(greatest({x}.n_act, 1) AS DOUBLE) - {z}.b_agg_rate", "fold_facing": "{x}.fold_facing - {z}.b_fold_facing", "post_call": "{x}.post_call / CAST(greatest({x}.post_act, 1) AS DOUBLE) - {z}.b_post_call"}
oracle(
    "pk24_deviation", [*SEAT, BASE],
    "SELECT p.hand, p.a, p.b, " + ", ".join(f"{double(v.format(x=x, z=z))} AS {s}_dev_{k}" for s, x, z in (("A", "a", "y"), ("B", "b", "z")) for k, v in _DEV.items())
    + f" {_BOTH} LEFT JOIN base y ON y.actor = p.a AND y.for_phase = p.phase LEFT JOIN base z ON z.actor = p.b AND z.for_phase = p.phase WHERE {_TAKEN}",
)
oracle(
    "pk25_fold_account", [*SEAT],
    "SELECT p.a, p.b, count(*) AS hands, " + ", ".join(
        f"CAST(sum({x}.folded) AS BIGINT) AS {s}_folds, CAST({count(f'{x}.fold_aggressor = p.{y}')} AS BIGINT) AS {s}_to_partner, CAST({count(f'{x}.fold_facing = 1 AND {x}.fold_aggressor IS DISTINCT FROM p.{y}')} AS BIGINT) AS {s}_to_others, "
        + ", ".join(f"CAST({count(f'{x}.fold_street = {k}')} AS BIGINT) AS {s}_folds_{k}" for k in STREETS)
        + f", coalesce({exact_sum(f'CASE WHEN {x}.folded = 1 THEN {x}.contrib END', 2)}, 0.0) AS {s}_lost, coalesce({exact_sum(f'CASE WHEN {x}.fold_aggressor = p.{y} THEN {x}.fold_pot END', 2)}, 0.0) AS {s}_left"
        for s, x, y in (("A", "a", "b"), ("B", "b", "a"))
    )
    + f" {_BOTH} WHERE {_TAKEN} GROUP BY p.a, p.b",
)

# presence contrasts

_STATES = [
    ("sn", "SELECT hand, actor, sum(surprise) AS nll_sum, max(surprise) AS nll_max FROM {sp} GROUP BY hand, actor"),
    ("q5", "SELECT hand, CAST(floor((row_number() OVER (PARTITION BY phase, cust % 25 ORDER BY started, hand) - 1) * 5 / count(*) OVER (PARTITION BY phase, cust % 25)) AS INTEGER) AS q5 FROM {hands}"),
    ("ms", "SELECT seat.*, nll_sum, nll_max, q5, contrib / 1000.0 AS share, CAST(last_street AS DOUBLE) AS depth, CASE WHEN folded = 0 THEN 1 ELSE 0 END AS sd FROM seat JOIN sn ON sn.hand = seat.hand AND sn.actor = seat.actor JOIN q5 ON q5.hand = seat.hand"),
]
FIRST = ("nll_sum", "nll_max", "n_act", "folded", "sd", "share")
SECOND = (*FIRST, "n_agg", "n_call", "vpip", "pfr", "depth", "n_facing", "n_fold_facing", "n_call_facing", "n_raise_facing")


def micro(m: str) -> str:
    return f"CAST(round(CAST(p.{m} AS DOUBLE) * 1e6) AS HUGEINT)"


def level(m: str) -> str:
    """The mean of the quintiles' differences, weighted by presence."""
    return f"sum(CAST(round(d_{m} * n1 * 1e9) AS HUGEINT))::DOUBLE / 1e9 / sum(n1)"


def contrast_steps(metrics: tuple[str, ...], window: str = "TRUE") -> list[tuple[str, str]]:
    """Per ordered pair: differences with the partner there against away, over all hands (g) and by quintile of time, weighted by presence (l). Away is all less there."""
    sums = lambda p: ", ".join(f"sum({micro(m)}) AS s{p}_{m}, sum({micro(m)} * {micro(m)}) AS q{p}_{m}" for m in metrics)

    def welch(tag: str, more: str) -> list[tuple[str, str]]:
        by = f"phase, actor{more}"
        keys = f"p.phase, p.actor{more.replace(', ', ', p.')}"
        on = f"t.phase = h.phase AND t.actor = h.actor{' AND t.q5 = h.q5' if more else ''}"
        mean = lambda m: (f"s1_{m} / n1", f"s0_{m} / greatest(n0, 1)")
        parts = []
        for m in metrics:
            a, b = mean(m)
            parts.append(f"CASE WHEN n0 > 0 THEN {a} - {b} ELSE 0.0 END AS d_{m}, greatest(q1_{m} / n1 - ({a}) * ({a}), 0.0) / n1 + greatest(q0_{m} / greatest(n0, 1) - ({b}) * ({b}), 0.0) / greatest(n0, 1) + 1e-6 AS v_{m}")
        return [
            (f"t{tag}", f"SELECT {by}, count(*) AS n_all, {sums('t')} FROM world p GROUP BY {by}"),
            (f"h{tag}", f"SELECT {keys}, o.actor AS other, count(*) AS n1, {sums('1')} FROM world p JOIN world o ON o.hand = p.hand AND o.actor <> p.actor GROUP BY {keys}, o.actor"),
            (f"c{tag}", f"SELECT {', '.join('h.' + k for k in by.split(', '))}, other, n1, n_all - n1 AS n0, " + ", ".join(f"{nearest(f's1_{m}')} / 1e6 AS s1_{m}, {nearest(f'q1_{m}')} / 1e12 AS q1_{m}, {nearest(f'st_{m} - s1_{m}')} / 1e6 AS s0_{m}, {nearest(f'qt_{m} - q1_{m}')} / 1e12 AS q0_{m}" for m in metrics) + f" FROM h{tag} h JOIN t{tag} t ON {on}"),
            (f"w{tag}", f"SELECT {by}, other, n1, n0, {', '.join(parts)} FROM c{tag}"),
        ]

    steps = [*SEAT, *_STATES, ("world", f"SELECT * FROM ms WHERE {window}"), *welch("g", ""), *welch("q", ", q5")]
    steps.append(("lq", "SELECT phase, actor, other, " + ", ".join(f"{level(m)} AS dl_{m}, {level(m)} / sqrt(sum(n1 * n1 * v_{m}) / CAST(sum(n1) * sum(n1) AS DOUBLE) + 1e-12) AS tl_{m}" for m in metrics) + " FROM wq GROUP BY phase, actor, other"))
    steps.append(("oc", "SELECT g.phase, g.actor, g.other, g.n1, g.n0, " + ", ".join(f"g.d_{m} AS {m}_dg, g.d_{m} / sqrt(g.v_{m}) AS {m}_tg, l.dl_{m} AS {m}_dl, l.tl_{m} AS {m}_tl" for m in metrics) + " FROM wg g JOIN lq l ON l.phase = g.phase AND l.actor = g.actor AND l.other = g.other"))
    return steps


def folded(metrics: tuple[str, ...]) -> str:
    """Both directions of each pair in one row."""
    each = [f"{m}_{k}" for m in metrics for k in ("dg", "tg", "dl", "tl")]
    out = [f"(x.{c} + y.{c}) / 2 AS pc_{c}_mean, least(x.{c}, y.{c}) AS pc_{c}_min" for c in each] + [f"greatest(x.{c}, y.{c}) AS pc_{c}_max" for c in each if c.startswith("nll_sum")]
    return f"SELECT x.phase, x.actor AS a, x.other AS b, least(x.n0, y.n0) AS pc_n_absent_min, x.n1 AS pc_n_present, {', '.join(out)} FROM oc x JOIN oc y ON y.phase = x.phase AND y.actor = x.other AND y.other = x.actor WHERE x.actor < x.other"


oracle("q14_presence_contrast", contrast_steps(FIRST), folded(FIRST))
oracle("q15_contrast_pairs", contrast_steps(SECOND), folded(SECOND))
_WINDOW = "started >= TIMESTAMP '1996-01-01' AND started < TIMESTAMP '2000-01-01'"
oracle("q21_window_contrast", contrast_steps(FIRST, _WINDOW), folded(FIRST))
oracle("q21_whole_window", contrast_steps(FIRST, "started >= TIMESTAMP '1900-01-01' AND started < TIMESTAMP '2200-01-01'"), folded(FIRST))

# pooling

_TOP = [
    ("tp", "SELECT * FROM (SELECT pair_id, hand, a, b, s_gen, row_number() OVER (PARTITION BY pair_id ORDER BY s_gen DESC, hand) AS k FROM {hand_scores}) z WHERE k <= 5"),
    ("pm", "SELECT hand, a, b, s_gen FROM {hand_scores}"),
    # the best other pair of the hand that shares a player: each player's two best pairs settle it
    ("en", "SELECT hand, player, a, b, s_gen, row_number() OVER (PARTITION BY hand, player ORDER BY s_gen DESC, a, b) AS r FROM (SELECT hand, a AS player, a, b, s_gen FROM pm UNION ALL SELECT hand, b, a, b, s_gen FROM pm) z"),
    ("b2", "SELECT hand, player, max(CASE WHEN r = 1 THEN a END) AS a1, max(CASE WHEN r = 1 THEN b END) AS b1, max(CASE WHEN r = 1 THEN s_gen END) AS s1, max(CASE WHEN r = 2 THEN s_gen END) AS s2 FROM en WHERE r <= 2 GROUP BY hand, player"),
    ("nx", "SELECT t.pair_id, t.hand, t.s_gen, max(coalesce(CASE WHEN x.a1 = t.a AND x.b1 = t.b THEN x.s2 ELSE x.s1 END, 0.0)) AS nmax FROM tp t JOIN b2 x ON x.hand = t.hand AND (x.player = t.a OR x.player = t.b) GROUP BY t.pair_id, t.hand, t.s_gen"),
]
oracle(
    "q17_dominance", _TOP,
    f"SELECT pair_id, avg(CASE WHEN nmax > s_gen THEN 1.0 ELSE 0.0 END) AS dom5, sum(CASE WHEN nmax > s_gen THEN s_gen ELSE 0.0 END) / nullif(sum(s_gen), 0) AS dommass, avg(least(greatest(nmax / greatest(s_gen, 1e-6), 0.0), 5.0)) AS ratio5, count(*) AS ntop FROM nx GROUP BY pair_id",
)
_MODELS = ("s_gen", "s_directed_transfer", "s_soft_play", "s_coordinated_isolation")
_MEANS = ["both_vpip", "both_flop", "hu_streets", "both_passive_hu", "war_streets", "tr_any", "pair_contrib", "net_gap", "chen_max", "chen_min", "rAB_n", "rBA_n"]
_MEANS += [f"{s}_{c}" for s in "AB" for c in ("fold_to_other", "folded_better", "vpip", "n_agg", "n_act", "contrib", "dev_vpip", "dev_agg", "dev_post_call", "folded")] + ["A_fold_to_B", "B_fold_to_A", *[f"r{s}_{c}" for s in ("AB", "BA") for c in ("fold", "call", "raise")]]
_POOLED = [
    *WIDE,
    ("hs", "SELECT w.*, h.pair_id, " + ", ".join(f"h.{m}" for m in _MODELS) + " FROM wide w JOIN {hand_scores} h ON h.hand = w.hand AND h.a = w.a AND h.b = w.b"),
    (
        "pl",
        "SELECT hs.*, row_number() OVER (PARTITION BY pair_id ORDER BY started, hand) AS t_rank, " + ", ".join(
            f"row_number() OVER (PARTITION BY pair_id ORDER BY {m} DESC, hand) AS k_{m}, " + ", ".join(f"avg({m}) OVER (PARTITION BY pair_id ORDER BY started, hand ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m{n}_{m}" for n in (10, 20)) for m in _MODELS
        ) + " FROM hs",
    ),
]
_POOL = ", ".join(
    f"max({m}) AS {m}_max, avg({m}) AS {m}_mean, avg(CASE WHEN k_{m} <= 3 THEN {m} END) AS {m}_top3, avg(CASE WHEN k_{m} <= 5 THEN {m} END) AS {m}_top5, CAST({count(f'{m} > 0.5')} AS BIGINT) AS {m}_n50, "
    f"CAST({count(f'{m} > 0.2')} AS BIGINT) AS {m}_n20, sum({m}) AS {m}_sum, max(CASE WHEN t_rank >= 5 THEN m20_{m} END) AS {m}_win20, max(CASE WHEN t_rank >= 3 THEN m10_{m} END) AS {m}_win10"
    for m in _MODELS
)
_TOP5 = {"dir": "abs(avg(CASE WHEN k_s_gen <= 5 THEN sign(A_net - B_net) END))", "t_spread": "stddev_samp(CASE WHEN k_s_gen <= 5 THEN t_rank END)"} | {
    k: exact_mean(f"CASE WHEN k_s_gen <= 5 THEN {v} END") for k, v in {"tr_any": "tr_any", "contrib": "pair_contrib", "hu": "hu_streets", "passive": "both_passive_hu", "war": "war_streets", "fold_to_partner": "A_fold_to_B + B_fold_to_A", "folded_better": "A_folded_better + B_folded_better", "chen_min": "chen_min"}.items()
}
oracle(
    "q18_pooled", _POOLED,
    f"SELECT pair_id, count(*) AS n_rows, {_POOL}, " + ", ".join(f"{exact_mean(c)} AS m_{c}" for c in _MEANS) + ", " + ", ".join(f"{v} AS top5_{k}" for k, v in _TOP5.items())
    + f", {exact_sum('tr_A_to_B')} AS sum_tr_AB, {exact_sum('tr_B_to_A')} AS sum_tr_BA, abs({exact_sum('tr_A_to_B')} - {exact_sum('tr_B_to_A')}) / ({exact_sum('tr_A_to_B')} + {exact_sum('tr_B_to_A')} + 1.0) AS tr_consistency, greatest({exact_sum('tr_A_to_B')}, {exact_sum('tr_B_to_A')}) AS tr_max_dir, "
    + f"abs({exact_sum('A_net')} - {exact_sum('B_net')}) AS net_flow_abs, avg(rAB_fold) / (avg(rAB_n) + 1e-3) - max(Ab_fold_facing) AS A_fold_vs_B_diff, avg(rBA_fold) / (avg(rBA_n) + 1e-3) - max(Bb_fold_facing) AS B_fold_vs_A_diff, "
    + f"avg(hu_streets) / (max(Ab_vpip) * max(Bb_vpip) + 1e-3) AS hu_norm FROM pl GROUP BY pair_id",
)

# probabilities of actions from outside: a solver's, and with or without private information

_SOLVER = [
    ("lg", "SELECT p.hand, p.no, p.actor, p.act, a.a, a.b, CASE WHEN p.actor = a.a THEN 'A' ELSE 'B' END AS role, " + ", ".join(f"-0.3 - ((p.hand * {x} + p.no * 17 + p.actor) % 97) / 40.0 AS l_{k}" for k, x in (("fold", 31), ("call", 7), ("raise", 13)))
     + " FROM {pair_hands} a JOIN {acts} p ON p.hand = a.hand AND (p.actor = a.a OR p.actor = a.b)"),
    ("nz", "SELECT lg.*, ln(exp(l_fold) + exp(l_call) + exp(l_raise)) AS z FROM lg"),
    ("sv", "SELECT nz.*, CAST(l_fold - z AS DECIMAL(18, 9)) AS p_fold, CAST(l_call - z AS DECIMAL(18, 9)) AS p_call, CAST(l_raise - z AS DECIMAL(18, 9)) AS p_raise, CAST(z - CASE act WHEN 'fold' THEN l_fold WHEN 'call' THEN l_call ELSE l_raise END AS DECIMAL(18, 9)) AS surp, CASE WHEN l_fold >= l_call AND l_fold >= l_raise THEN 'fold' WHEN l_call >= l_raise THEN 'call' ELSE 'raise' END AS best FROM nz"),
]
_PB = {
    "surp_max": "max(surp)", "surp_sum": "sum(surp)", "surp_mean": "sum(surp)", "surp_A_max": "max(CASE WHEN role = 'A' THEN surp END)", "surp_B_max": "max(CASE WHEN role = 'B' THEN surp END)",
    **{f"surp_{k}_max": f"max(CASE WHEN act = '{k}' THEN surp END)" for k in ("fold", "call", "raise")}, "disagree_rate": "avg(CASE WHEN best <> act THEN 1.0 ELSE 0.0 END)",
    **{f"{k}_lp_min": f"min(CASE WHEN act = '{k}' THEN p_{k} END)" for k in ("fold", "call", "raise")}, "pfold_max": "max(p_fold)", "pcall_max": "max(p_call)",
}
oracle("q24_solver_surprisal", _SOLVER, "SELECT hand, a, b, count(*) AS pb_n_dec, CAST(" + count("best <> act") + " AS BIGINT) AS pb_n_disagree, " + ", ".join(f"{double(v)}{" / count(*)" if k == "surp_mean" else ""} AS pb_{k}" for k, v in _PB.items()) + " FROM sv GROUP BY hand, a, b")
_RATIOS = [
    *_SOLVER,
    ("pv", "SELECT sv.*, -surp AS lp_all, CAST(-surp - CAST(((hand * 5 + no) % 41) / 60.0 AS DECIMAL(18, 9)) + 0.3 AS DECIMAL(18, 9)) AS lp_public, CAST(-surp - CAST(((hand * 11 + no) % 53) / 50.0 AS DECIMAL(18, 9)) + 0.4 AS DECIMAL(18, 9)) AS lp_none, CASE WHEN EXISTS (SELECT 1 FROM {acts} f WHERE f.hand = sv.hand AND f.actor = CASE WHEN sv.role = 'A' THEN sv.b ELSE sv.a END AND f.act = 'fold' AND f.no < sv.no) THEN 1 ELSE 0 END AS out_before FROM sv"),
    ("lr", "SELECT pv.*, lp_all - lp_public AS private, lp_public - lp_none AS public, lp_all - lp_none AS total FROM pv"),
]
_NI = {f"{c}_{k}": f"{k}({c})" for k in ("max", "sum") for c in ("private", "public", "total")} | {f"private_{k}_max": f"max(CASE WHEN act = '{k}' THEN private END)" for k in ("fold", "call", "raise")}
_NI |= {"private_in_max": "max(CASE WHEN out_before = 0 THEN private END)", "private_in_sum": "coalesce(sum(CASE WHEN out_before = 0 THEN private END), 0.0)"}
oracle("q26_private_ratio", _RATIOS, "SELECT hand, a, b, " + ", ".join(f"{double(v)} AS lr_{k}" for k, v in _NI.items()) + " FROM lr GROUP BY hand, a, b")
