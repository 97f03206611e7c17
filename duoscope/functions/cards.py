"""Playing cards: codes, textures and hand strength.

Ranks are 0 (two) to 12 (ace), suits 0 to 3; a card's number is 4 * rank + suit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.operators.windows import before

RANKS, SUITS = "23456789TJQKA", "cdhs"
RANK_WORDS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "jack", "queen", "king", "ace")
SUIT_WORDS = ("clubs", "diamonds", "hearts", "spades")


def words(code: Column) -> Column:
    table = lambda keys, values: F.create_map(*[F.lit(x) for kv in zip(keys, values, strict=True) for x in kv])
    return F.concat(F.element_at(table(RANKS, RANK_WORDS), F.substring(code, 1, 1)), F.lit(" of "), F.element_at(table(SUITS, SUIT_WORDS), F.substring(code, 2, 1)))


def number(code: Column) -> Column:
    """Of a code such as Kh."""
    return 4 * (F.instr(F.lit(RANKS), F.substring(code, 1, 1)) - 1) + F.instr(F.lit(SUITS), F.substring(code, 2, 1)) - 1


def board_size(board: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(board, F.lit("")), " "), lambda x: x != ""))


def chen(r1: Column, u1: Column, r2: Column, u2: Column) -> Column:
    """Chen's points of a starting hand, unrounded: high card, pairs, suits, gaps, and one for small connected cards."""
    hi, lo = F.greatest(r1, r2), F.least(r1, r2)
    value = F.when(hi == 12, 10.0).when(hi == 11, 8.0).when(hi == 10, 7.0).when(hi == 9, 6.0).otherwise((hi + 2) / 2)
    gap = hi - lo - 1
    off = F.when(gap <= 0, 0).when(gap == 1, 1).when(gap == 2, 2).when(gap == 3, 4).otherwise(5)
    apart = value + F.when(u1 == u2, 2).otherwise(0) - off + F.when((gap <= 1) & (hi < 10), 1).otherwise(0)
    return F.when(hi == lo, F.greatest(2 * value, F.lit(5.0))).otherwise(apart)


def action_class(act: Column, amount: Column, to_call: Column) -> Column:
    aggressive = act.isin("bet", "raise") | ((act == "all_in") & (amount > to_call))
    return F.when(aggressive, "aggressive").when(act.isin("call", "all_in"), "call").otherwise(act)


def of_pot(amount: Column, pot: Column) -> Column:
    return F.least(F.greatest(amount / F.greatest(pot, F.lit(1)), F.lit(0.0)), F.lit(20.0))


def pot_odds(to_call: Column, pot: Column) -> Column:
    return to_call / (pot + to_call + 1e-3)


def call_regret(cost: Column, pot: Column, equity: Column) -> Column:
    return F.greatest(F.lit(0.0), cost - equity * (pot + cost))


def causal_state(acts: DataFrame) -> DataFrame:
    """Adds what was public before each row of (hand, no, seat 0..5, act, amount): masks of who acted and folded, raises, pot."""
    w = before(["hand"], ["no"])
    bit = F.expr("shiftleft(1L, seat)")
    return acts.withColumns({
        "acted": F.coalesce(F.bit_or(bit).over(w), F.lit(0).cast("long")), "folded": F.coalesce(F.bit_or(F.when(F.col("act") == "fold", bit)).over(w), F.lit(0).cast("long")),
        "raises": F.coalesce(F.sum((F.col("act") == "raise").cast("long")).over(w), F.lit(0).cast("long")), "pot": F.coalesce(F.sum("amount").over(w), F.lit(0.0)),
    })


def texture(ranks: Column, suits: Column) -> Column:
    """suit_max, paired, high, straight: the most cards of a suit, a repeated rank, the highest rank, the most ranks in five in a row (an ace is also low)."""
    of_suit = lambda s: F.size(F.filter(suits, lambda x: x == s))
    within = lambda k: F.size(F.array_distinct(F.filter(low, lambda x: (x >= k) & (x < k + 5))))
    suit_max = F.greatest(*[of_suit(s) for s in range(4)])
    low = F.concat(ranks, F.transform(F.filter(ranks, lambda x: x == 12), lambda x: x - 13))
    straight = F.greatest(*[within(k) for k in range(-1, 9)])
    return F.struct(suit_max.alias("suit_max"), (F.size(F.array_distinct(ranks)) < F.size(ranks)).alias("paired"), F.array_max(ranks).cast("int").alias("high"), straight.alias("straight"))


# Hand strength in numpy, for Arrow functions. A score orders hands; equal scores tie.

CATEGORIES = ("high card", "pair", "two pair", "three of a kind", "straight", "flush", "full house", "four of a kind", "straight flush")


def five(cards: np.ndarray) -> np.ndarray:
    """Scores of five-card hands, n x 5 card numbers: category and then ranks by count and height, in base 16."""
    r, s = np.sort(cards // 4, axis=1)[:, ::-1], cards % 4
    counts = (r[:, :, None] == r[:, None, :]).sum(axis=2)
    order = np.argsort(-(counts * 16 + r), axis=1, kind="stable")
    ranks, by = np.take_along_axis(r, order, axis=1), np.take_along_axis(counts, order, axis=1)
    flush = (s == s[:, :1]).all(axis=1)
    distinct = by[:, 0] == 1
    wheel = distinct & (r == [12, 3, 2, 1, 0]).all(axis=1)
    straight = distinct & (r[:, 0] - r[:, 4] == 4) | wheel
    ranks = np.where(wheel[:, None], [3, 2, 1, 0, 0], ranks)
    category = np.select(
        [straight & flush, by[:, 0] == 4, (by[:, 0] == 3) & (by[:, 3] == 2), flush, straight, by[:, 0] == 3, (by[:, 0] == 2) & (by[:, 2] == 2), by[:, 0] == 2], [8, 7, 6, 5, 4, 3, 2, 1], 0
    )
    score = category.astype(np.int64)
    for k in range(5):
        score = score * 16 + ranks[:, k]
    return score


def best(cards: np.ndarray) -> np.ndarray:
    """Scores of the best five of n x 5, 6 or 7 cards."""
    return np.max([five(cards[:, list(c)]) for c in combinations(range(cards.shape[1]), 5)], axis=0)


def category(score: np.ndarray) -> np.ndarray:
    return score >> 20


def equities(hands: list[tuple[int, int]], board: list[int]) -> np.ndarray:
    """Exact shares of the pot of each of several hands over all run-outs of a board of three to five cards; ties split."""
    used = {c for h in hands for c in h} | set(board)
    deck = [c for c in range(52) if c not in used]
    missing = 5 - len(board)
    runs = np.array(list(combinations(deck, missing)), np.int64) if missing else np.zeros((1, 0), np.int64)
    scores = np.stack([best(np.concatenate([np.tile([*h, *board], (len(runs), 1)), runs], axis=1)) for h in hands], axis=1)
    wins = scores == scores.max(axis=1, keepdims=True)
    return (wins / wins.sum(axis=1, keepdims=True)).mean(axis=0)


def canonical(hands: tuple[tuple[int, int], tuple[int, int]], board: tuple[int, ...]) -> tuple:
    """The same key for matchups that differ by a renaming of suits or the order of cards; with whether the hands were exchanged."""
    from itertools import permutations

    keys = []
    for p in permutations(range(4)):
        to = lambda c: 4 * (c // 4) + p[c % 4]
        a, b = (tuple(sorted(map(to, h))) for h in hands)
        keys.append((min(a, b), max(a, b), tuple(sorted(map(to, board))), a > b))
    return min(keys)


def sampled_equities(hands: list[tuple[int, int]], board: list[int], n: int, seed: int) -> np.ndarray:
    """equities() over n run-outs drawn without replacement within each, by the seed alone."""
    used = {c for h in hands for c in h} | set(board)
    deck = np.array([c for c in range(52) if c not in used])
    runs = deck[np.argsort(np.random.default_rng(seed).random((n, len(deck))), axis=1)[:, : 5 - len(board)]]
    scores = np.stack([best(np.concatenate([np.tile([*h, *board], (n, 1)), runs], axis=1)) for h in hands], axis=1)
    wins = scores == scores.max(axis=1, keepdims=True)
    return (wins / wins.sum(axis=1, keepdims=True)).mean(axis=0)


def matchup_key(hands: tuple[tuple[int, int], tuple[int, int]], board: tuple[int, ...] = ()) -> tuple[int, bool]:
    """canonical() as one number, a seed for its matchup, and whether the hands were exchanged."""
    a, b, cards, flipped = canonical(hands, board)
    number_ = 0
    for c in (*a, *b, *cards):
        number_ = number_ * 64 + c + 1
    return number_ % (1 << 61), flipped


def at_fold_street(street: Column, flop: Column, turn: Column, river: Column, second: bool = False) -> Column:
    """The folder's equity at the street of its fold; equities are the first side's, so the second side takes the rest. Null before the flop."""
    own = F.when(street == 1, flop).when(street == 2, turn).when(street == 3, river)
    return 1 - own if second else own


def hand_texture(hole_ranks: Column, hole_suits: Column, ranks: Column, suits: Column) -> Column:
    """suit_max, pairs_board, overcards, straight: of two cards with the board."""
    high = F.array_max(ranks)
    whole = texture(F.concat(ranks, hole_ranks), F.concat(suits, hole_suits))
    return F.struct(
        whole["suit_max"].alias("suit_max"), F.arrays_overlap(ranks, hole_ranks).cast("int").alias("pairs_board"), F.size(F.filter(hole_ranks, lambda x: x > high)).alias("overcards"), whole["straight"].alias("straight")
    )
