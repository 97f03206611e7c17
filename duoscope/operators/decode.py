"""Slot decoding: which of a pair's hands are listed, when the first five of the true ones in time are, and confidence is independent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 5


def slot_probabilities(p: Column, slots: int = SLOTS) -> Column:
    """For hands in time order with probabilities p of being true: that a hand is true and fewer than `slots` earlier ones are.

    A prefix pass over the array carries the distribution of the number of true hands so far, cut off at `slots`.
    """
    start = F.struct(F.array(F.lit(1.0), *[F.lit(0.0)] * (slots - 1)).alias("d"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        d = acc["d"]
        below = F.aggregate(d, F.lit(0.0), lambda a, y: a + y)
        new = F.array(*[(F.get(d, k) * (1 - x) + (F.get(d, k - 1) * x if k else F.lit(0.0))) for k in range(slots)])
        return F.struct(new.alias("d"), F.concat(acc["out"], F.array(x * below)).alias("out"))

    return F.aggregate(p, start, step, lambda acc: acc["out"])


def decode(hands: Column, p: Column, slots: int = SLOTS) -> Column:
    """The `slots` hands most probably listed, most probable first; the earlier of equal ones."""
    q = slot_probabilities(p, slots)
    ranked = F.array_sort(F.zip_with(F.transform(q, lambda x, i: F.struct((-x).alias("k"), i.alias("i"))), hands, lambda a, h: F.struct(a["k"].alias("k"), a["i"].alias("i"), h.alias("h"))))
    return F.transform(F.slice(ranked, 1, slots), lambda x: x["h"])


def levels(c: Column, s: Column) -> Column:
    """Censored labels of a hand: listed (c = 1), surely not true (c = 0 with room left), unknown (the list was full before)."""
    return F.when(c == 1, 1).when(s < SLOTS, 0)


def damped(lists: Column, factor: float = 0.02) -> Column:
    """Probabilities of hands against the pair's direction, scaled down."""
    return lists * factor


def _start(n: int) -> Column:
    return F.array(F.lit(1.0), *[F.lit(0.0)] * (n - 1))


def _next(d: Column, x: Column, n: int) -> Column:
    """The distribution of a number of true hands, cut off at n, with one hand more."""
    return F.array(*[F.get(d, k) * (1 - x) + (F.get(d, k - 1) * x if k else F.lit(0.0)) for k in range(n)])


def prefixes(p: Column, n: int = SLOTS) -> Column:
    """For each hand the distribution of the number of true hands before it (0 to n - 1; the rest is what is left to 1)."""
    none = F.expr("cast(array() as array<array<double>>)")
    step = lambda acc, x: F.struct(_next(acc["d"], x, n).alias("d"), F.concat(acc["out"], F.array(acc["d"])).alias("out"))
    return F.aggregate(p, F.struct(_start(n).alias("d"), none.alias("out")), step, lambda acc: acc["out"])


def total(p: Column, n: int = SLOTS) -> Column:
    return F.aggregate(p, _start(n), lambda d, x: _next(d, x, n))


def _at_most(parts: list[Column], n: int) -> Column:
    """The probability that independent numbers sum to fewer than n."""
    first, *rest = parts
    if not rest:
        return sum((F.get(first, k) for k in range(1, n)), F.get(first, 0))
    return sum((F.get(first, k) * _at_most(rest, n - k) for k in range(1, n)), F.get(first, 0) * _at_most(rest, n))


def two_kinds(c: Column, s: Column, softening: float = 1.0, slots: int = SLOTS) -> Column:
    """For hands in time order, with probabilities c and s of the first and the second kind: that each is listed.

    A first-kind hand is listed if fewer than `slots` first-kind ones are earlier; a second-kind hand if those of the first kind at any time and those of
    the second kind earlier are fewer than `slots`. A softening below 1 lessens a hand's own probability relative to the slots.
    """
    after = F.reverse(prefixes(F.reverse(c), slots))
    rows = F.arrays_zip(c.alias("c"), s.alias("s"), prefixes(c, slots).alias("before"), after.alias("after"), prefixes(s, slots).alias("own"))
    soft = lambda x: x if softening == 1.0 else F.pow(x, F.lit(softening))
    return F.transform(rows, lambda r: soft(r["c"]) * _at_most([r["before"]], slots) + soft(r["s"]) * _at_most([r["before"], r["after"], r["own"]], slots))


def by_level(p: Column, level: Column, most: int, slots: int = SLOTS) -> Column:
    """For hands in time order with strength levels 0 (strongest) to most (below 0: no candidate): that each is listed, which it is if true hands of stronger
    levels at any time and of its own level earlier are fewer than `slots`. Up to `slots` hands the others always are fewer, so p itself is the answer."""
    both = F.arrays_zip(p.alias("p"), level.alias("l"))
    only = lambda keep: F.transform(both, lambda r: F.when(keep(r["l"]), r["p"]).otherwise(0.0))
    out = F.transform(p, lambda x: F.lit(0.0))
    for k in range(most + 1):
        earlier = F.arrays_zip(p.alias("p"), level.alias("l"), prefixes(only(lambda l: l == k), slots).alias("e"))  # noqa: B023
        own = lambda stronger: F.transform(earlier, lambda r: F.when(r["l"] == k, r["p"] * _at_most([stronger, r["e"]], slots)))  # noqa: B023, E731
        out = F.zip_with(out, once(total(only(lambda l: (l >= 0) & (l < k)), slots), own), lambda a, x: F.coalesce(x, a))  # noqa: B023
    few = F.transform(both, lambda r: F.when(r["l"].between(0, most), r["p"]).otherwise(0.0))
    return F.when(F.size(p) <= slots, few).otherwise(out)


def once(value: Column, use) -> Column:
    """use(value), with the value made once for the row rather than for each element of an array that use() goes over."""
    return F.get(F.transform(F.array(value), use), 0)


def best_split(q: Column) -> Column:
    """For an ordered list with probabilities q of the first kind: how many belong to it, where the first kind comes first; the least of equally likely splits."""
    clipped = F.transform(q, lambda x: F.least(F.greatest(x, F.lit(1e-4)), F.lit(1 - 1e-4)))
    gain = F.transform(clipped, lambda x: F.ln(x) - F.ln(1 - x))
    sums = F.aggregate(gain, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.array_position(sums, F.array_max(sums)) - 1


def redirected(c: Column, s: Column, way: Column, factor: float = 0.02, odds: float = 1.0, softening: float = 1.0, slots: int = SLOTS) -> Column:
    """two_kinds(), then again where the first `slots` hands by it have a direction: hands of the other direction are scaled down, those of the same may have their odds raised."""
    h = two_kinds(c, s, softening, slots)
    ranked = F.array_sort(F.transform(F.arrays_zip(h.alias("h"), way.alias("w")), lambda r, i: F.struct((-r["h"]).alias("h"), i.alias("i"), r["w"].alias("w"))))
    main = F.signum(F.aggregate(F.slice(ranked, 1, slots), F.lit(0.0), lambda a, r: a - r["h"] * r["w"]))
    raised = lambda x: x if odds == 1.0 else odds * x / (1 - x + odds * x)

    def again(m: Column) -> Column:
        turned = lambda p: F.zip_with(p, way, lambda x, w: F.when((m != 0) & (w == -m), x * factor).when((m != 0) & (w == m), raised(x)).otherwise(x))
        return two_kinds(turned(c), turned(s), softening, slots)

    return once(main, again)
