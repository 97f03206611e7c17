"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are the lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+` and one end. The most frequent training tokens are output units of their own;
the rest are dealt by hash to units that open a tree of further classes, as deep and wide as the counted vocabulary needs, with a leaf for each
word: P(token) = P(class | context) P(unit | class, context) P(child | node, context) ... P(token | leaf). All softmaxes are linear in hashed
features: the last token, the last two (an n-gram), and the one before last (a skip); they start at the unigram model's logs. Where the vocabulary is
over unit_words, the most frequent words have leaves and the others share some by hash, inside which they follow their smoothed counts; unknown
words share such leaves too.

Counts cover all training documents. Training runs in rounds; the documents of a round are dealt by hash to units of work, whose number follows the
counted tokens, so that the model does not depend on how the table is split. Each unit makes gradient steps over its documents, in order of a hash,
from the shared weights, and what it changed is summed by blocks of weights and averaged over the units that changed a weight. Rounds
and rows of weights grow with the counted tokens, rows up to 2**MOST_BITS a level, so they can be broadcast. Counts are looked up in broadcast arrays while the vocabulary is at most
lookup_words; a larger one is joined.

Null and empty texts are one end; very long ones are learned and scored whole. Ids learn by crc32 of the id as text (null: of the empty text). Rows
that repeat an id give a row each. Of words of equal count that are partly left out of the own units or leaves, the first by spelling or hash are in.
Where there is nothing to learn from, all tokens are unknown and both scores use one unknown outcome. An empty table gives an empty one. Other
columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import claim, crc_mod, crc_mod_column, ddl, mix64, slices, text_bytes, two_columns
from duoscope.runtime import discard, materialize

FOLD = (5, 1)
CLASSES, SIZE = 32, 32
SHARED = 32  # units that open trees of rarer tokens: the last class
CLASS_BITS, UNIT_BITS, MOST_BITS = 14, 15, 16  # at least and at most: rows are 16-bit numbers
ROUNDS = 2  # at least
#: Words with a leaf of their own besides the most frequent; each takes 20 bytes in a task.
UNIT_WORDS = 4_000_000
#: Words that share a leaf where there are more, at least.
SHARE_LEAF = 16
CHUNK = 2048
RATE = 0.15
LOOKUP_WORDS = 4_000_000
FLUSH_WORDS = 200_000
BLOCK = 512
MOST_SUMS = 96  # tasks that sum changes
WORK_TOKENS = 1 << 20  # of a unit of work, at least
MOST_WORK = 4096  # units of work in a round, at most
PARTS = 4  # in which the driver gets the words
END = b""
_FEATURES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_START = (np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))


class Tail(NamedTuple):
    """Trees of the rarer tokens, one for each of the SHARED units: at each level, caps[j] places a tree, width to a node. The first places of the last level are shared."""

    width: int
    keys: np.ndarray  # of the words with a leaf, by tree and hash
    counts: np.ndarray  # of the same words
    firsts: np.ndarray  # number of each tree's first word
    slots: int  # shared leaves of a tree
    caps: list[int]
    logs: list[np.ndarray]  # of the masses, for each level and node
    shared: np.ndarray  # masses of the shared leaves, by tree


class Units(NamedTuple):
    """The output units: tokens with their own, and the counts that shared ones hold (with 0.5 for one unknown outcome each)."""

    own: dict[bytes, int]
    mass: np.ndarray
    total: int
    words: int
    tail: Tail | None = None


class Weights(NamedTuple):
    class_bias: np.ndarray
    unit_bias: np.ndarray
    classes: np.ndarray
    units: np.ndarray
    tails: tuple[np.ndarray, ...] = ()  # for each level of the trees

    @property
    def tables(self) -> list[np.ndarray]:
        return [self.classes, self.units, *self.tails]


class Tokens(NamedTuple):
    """Distinct tokens of some texts with their hashes, units, leaves (-1: none) and masses they share (0: none), and the texts as numbers of these."""

    unique: list[bytes]
    hashes: np.ndarray
    unit: np.ndarray
    leaf: np.ndarray
    mass: np.ndarray
    ids: np.ndarray
    counts: np.ndarray


def tokens(raws: list[bytes], units: Units) -> Tokens:
    parts = [raw.lower().split() for raw in raws]
    for p in parts:
        p.append(END)
    counts = np.array([len(p) for p in parts], np.int64)
    n = int(counts.sum())
    index: dict[bytes, int] = {}
    first = np.fromiter(map(index.setdefault, chain.from_iterable(parts), range(n)), np.int64, n)  # where each word is met first
    ids = (np.cumsum(first == np.arange(n)) - 1)[first]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, index, repeat(42)), np.uint64, len(index))
    first = CLASSES * SIZE - SHARED
    unit = np.fromiter(map(units.own.get, index, repeat(-1)), np.int64, len(index))
    rare = unit < 0
    tree = (hashes % np.uint64(SHARED)).astype(np.int64)
    unit = np.where(rare, first + tree, unit)
    if units.tail is None:
        return Tokens(list(index), hashes, unit, np.full(len(unit), -1), np.where(rare, units.mass[unit], 0.0), ids, counts)
    leaf, mass = leaves(units.tail, hashes, tree)
    return Tokens(list(index), hashes, unit, np.where(rare, leaf, -1), np.where(rare, mass, 0.0), ids, counts)


def tree_keys(hashes: np.ndarray) -> np.ndarray:
    """The hashes turned so that they sort by tree."""
    bits = np.uint64(SHARED.bit_length() - 1)
    return (hashes >> bits) | (hashes << (np.uint64(64) - bits))


def leaves(tail: Tail, hashes: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words in the last level, and the masses of those that are shared (else 0)."""
    at, known = found_in(tail, hashes)
    slot = ((hashes >> np.uint64(32)) % np.uint64(tail.slots)).astype(np.int64)
    place = np.where(known, tail.slots + at - tail.firsts[tree], slot)
    return tree * tail.caps[-1] + place, np.where(known, 0.0, tail.shared[tree, slot])


def found_in(tail: Tail, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words among those with a leaf, and whether they are there."""
    if not len(tail.keys):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    keys = tree_keys(hashes)
    at = np.minimum(np.searchsorted(tail.keys, keys), len(tail.keys) - 1)
    return at, tail.keys[at] == keys


def shape_of(places: int) -> tuple[int, int]:
    """Levels and width of a tree: the cheapest that has the places, where a level costs its width and about 24 more."""
    width = lambda levels: next(b for b in range(max(2, int(places ** (1 / levels)) - 1), places + 3) if b**levels >= places)
    return min(((n, width(n)) for n in range(1, 12)), key=lambda x: x[0] * (x[1] + 24))


def tail_of(keys: np.ndarray, counts: np.ndarray, shared: np.ndarray) -> Tail:
    """keys and counts: of the words with a leaf, sorted. shared: for each tree and shared leaf its mass."""
    slots = shared.shape[1]
    tree = (keys >> np.uint64(65 - SHARED.bit_length())).astype(np.int8)
    sizes = np.bincount(tree, minlength=SHARED)
    firsts = np.cumsum(sizes) - sizes
    levels, width = shape_of(slots + int(sizes.max()))
    mass = np.zeros((SHARED, -(-(slots + int(sizes.max())) // width) * width))
    mass[:, :slots] = shared
    for k in range(SHARED):
        mass[k, slots : slots + sizes[k]] = counts[firsts[k] : firsts[k] + sizes[k]] + 0.5
    caps, logs = [], []
    for level in range(levels):
        own = np.full(mass.shape, -1e9, np.float32)
        np.log(mass, out=own, where=mass > 0, casting="same_kind")
        caps.insert(0, mass.shape[1])
        logs.insert(0, own.reshape(-1, width))
        nodes = mass.shape[1] // width
        mass = mass.reshape(SHARED, nodes, width).sum(axis=2)
        mass = np.pad(mass, ((0, 0), (0, -nodes % width)))
    return Tail(width, keys, counts, firsts, slots, caps, logs, shared)


def places(tail: Tail, leaf: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a level on the way to the leaves, and which child is the next."""
    tree, place = np.divmod(leaf, tail.caps[-1])
    return np.divmod(tree * tail.caps[level] + place // tail.width ** (len(tail.caps) - 1 - level), tail.width)


def tail_rows(features: np.ndarray, nodes: np.ndarray, level: int, bits: int) -> np.ndarray:
    own = mix64(nodes.astype(np.uint64) * _FEATURES[2] + np.uint64(level + 1))
    return (((features + own[:, None]) * _FEATURES[0]) >> np.uint64(64 - bits)).astype(np.uint16)


def tail_forward(table: np.ndarray, logs: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shifted values of a level's softmax and their exponentials."""
    y = np.take(logs, nodes, axis=0)
    for k in range(rows.shape[1]):
        y += np.take(table, rows[:, k], axis=0)
    y -= y.max(axis=1, keepdims=True)
    return y, np.exp(y)


def bits_of(table: np.ndarray) -> int:
    return len(table).bit_length() - 1


def contexts(own: Tokens) -> np.ndarray:
    """Hashed features of each token's context: last token, last two, one before last. Mixed once for each distinct token where one decides."""
    n = len(own.ids)
    h = np.concatenate([own.hashes, np.array(_START, np.uint64)])
    m = len(own.hashes)
    starts = np.cumsum(own.counts) - own.counts
    one, two = np.empty(n, np.int64), np.empty(n, np.int64)
    one[1:], two[2:] = own.ids[:-1], own.ids[:-2]
    one[starts] = m
    two[starts] = m + 1
    two[(starts + 1)[own.counts > 1]] = m
    return np.stack([mix64(h * _FEATURES[0])[one], mix64((h * _FEATURES[1])[one] + mix64(h)[two]), mix64(h * _FEATURES[2])[two]], axis=1)


def rows_of(features: np.ndarray, classes: np.ndarray, bits: tuple[int, int] = (CLASS_BITS, UNIT_BITS)) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two weight tables, as 16-bit numbers, which sort fast."""
    a = (features >> np.uint64(64 - bits[0])).astype(np.uint16)
    b = (((features + (classes.astype(np.uint64) * _FEATURES[1])[:, None]) * _FEATURES[0]) >> np.uint64(64 - bits[1])).astype(np.uint16)
    return a, b


def forward(w: Weights, a: np.ndarray, b: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shifted values of both softmaxes, their exponentials and sums of these."""
    x, y = w.class_bias + np.take(w.classes, a[:, 0], axis=0), np.take(w.unit_bias, classes, axis=0)
    y += np.take(w.units, b[:, 0], axis=0)
    for k in range(1, a.shape[1]):
        x += np.take(w.classes, a[:, k], axis=0)
        y += np.take(w.units, b[:, k], axis=0)
    x -= x.max(axis=1, keepdims=True)
    y -= y.max(axis=1, keepdims=True)
    return x, y, np.exp(x), np.exp(y)


def unit_logs(w: Weights, own: Tokens, tail: Tail | None = None) -> np.ndarray:
    """Natural log of P(class) P(unit | class) for each token, times that of its way to its leaf."""
    out = np.empty(len(own.ids))
    features, unit = contexts(own), own.unit[own.ids]
    bits = bits_of(w.classes), bits_of(w.units)
    for at in range(0, len(out), CHUNK):
        s = slice(at, at + CHUNK)
        classes = unit[s] // SIZE
        x, y, ex, ey = forward(w, *rows_of(features[s], classes, bits), classes)
        i = np.arange(len(classes))
        out[s] = x[i, classes] + y[i, unit[s] % SIZE] - np.log(ex.sum(axis=1) * ey.sum(axis=1))
    rare = np.flatnonzero(own.leaf[own.ids] >= 0)
    for at in range(0, len(rare) if tail else 0, CHUNK):
        s = rare[at : at + CHUNK]
        leaf, f = own.leaf[own.ids[s]], features[s]
        for level, table in enumerate(w.tails):
            nodes, child = places(tail, leaf, level)
            y, ey = tail_forward(table, tail.logs[level], tail_rows(f, nodes, level, bits_of(table)), nodes)
            out[s] += y[np.arange(len(s)), child] - np.log(ey.sum(axis=1))
    return out


def descend(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """Adagrad with one rate a row, on the summed gradients of the rows."""
    for k in range(rows.shape[1]):
        order = np.argsort(rows[:, k], kind="stable")
        sorted_ = rows[order, k]
        first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        at, g, n = sorted_[first], np.take(grad, order[first], axis=0), np.diff(first, append=len(order))
        many = np.flatnonzero(n > 1)
        if len(many):  # most rows are met once
            inside, size = np.flatnonzero(np.repeat(n > 1, n)), n[many]
            g[many] = np.add.reduceat(np.take(grad, order[inside], axis=0), np.cumsum(size) - size, axis=0)
        s = np.take(squares, at) + np.einsum("ij,ij->i", g, g) / g.shape[1]
        squares[at] = s
        g *= (rate / np.sqrt(s))[:, None]
        table[at] = np.take(table, at, axis=0) - g


class Learner:
    """A task's own copy of the weights."""

    def __init__(self, w: Weights) -> None:
        self.before = w
        self.w = w._replace(classes=w.classes.copy(), units=w.units.copy(), tails=tuple(x.copy() for x in w.tails))
        self.squares = [np.full(len(x), 1e-2, np.float32) for x in w.tables]

    def learn(self, own: Tokens, tail: Tail | None = None) -> None:
        features, unit = contexts(own), own.unit[own.ids]
        bits = bits_of(self.w.classes), bits_of(self.w.units)
        for at in range(0, len(unit), CHUNK):
            s = slice(at, at + CHUNK)
            classes, within = unit[s] // SIZE, unit[s] % SIZE
            a, b = rows_of(features[s], classes, bits)
            _, _, x, y = forward(self.w, a, b, classes)
            x /= x.sum(axis=1, keepdims=True)
            y /= y.sum(axis=1, keepdims=True)
            i = np.arange(len(classes))
            x[i, classes] -= 1
            y[i, within] -= 1
            descend(self.w.classes, self.squares[0], a, x, RATE)
            descend(self.w.units, self.squares[1], b, y, RATE)
        rare = np.flatnonzero(own.leaf[own.ids] >= 0)
        for at in range(0, len(rare) if tail else 0, CHUNK):
            s = rare[at : at + CHUNK]
            leaf, f = own.leaf[own.ids[s]], features[s]
            for level, table in enumerate(self.w.tails):
                nodes, child = places(tail, leaf, level)
                rows = tail_rows(f, nodes, level, bits_of(table))
                _, y = tail_forward(table, tail.logs[level], rows, nodes)
                y /= y.sum(axis=1, keepdims=True)
                y[np.arange(len(s)), child] -= 1
                descend(table, self.squares[2 + level], rows, y, RATE)

    def changes(self) -> Iterator[tuple[int, bytes]]:
        """Blocks of rows that changed: number and differences."""
        n = 0
        for now, then in zip(self.w.tables, self.before.tables, strict=True):
            for at in range(0, len(now), BLOCK):
                d = now[at : at + BLOCK] - then[at : at + BLOCK]
                if d.any():
                    yield n, d.astype(np.float16).tobytes()
                n += 1


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, c) over a table with text_; the end is the empty word. Tasks sum their own words first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for batch in slices(batches, "text_"):
            for t in batch.column("text_").to_pylist():
                held.update(text_bytes(t).lower().split())
            held[END] += batch.num_rows
            if len(held) > FLUSH_WORDS:
                yield out()
                held.clear()
        if held:
            yield out()

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def leaf_words(rest: DataFrame, words: int, unit_words: int) -> Column:
    """Which words have a leaf of their own: all, or the most frequent; of the last count that fits in part, those with the smallest hashes."""
    if words <= unit_words:
        return F.lit(True)
    free = unit_words
    for r in rest.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect():  # fewer than the root of twice the tokens
        if r["n"] > free:
            part = (free << 20) // r["n"]
            return (F.col("c") > r["c"]) | ((F.col("c") == r["c"]) & (F.shiftrightunsigned("h", 44) < part))
        free -= r["n"]
    return F.lit(True)


def output_units(counts: DataFrame, unit_words: int = UNIT_WORDS) -> Units:
    total, words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    first = CLASSES * SIZE - SHARED
    top = counts.filter("word <> ''").orderBy(F.desc("c"), "word").limit(first - 1).collect()
    end = counts.filter("word = ''").collect()
    ranked = sorted([(r["word"].encode(), r["c"]) for r in [*top, *end]], key=lambda x: (-x[1], x[0]))
    own = {w: i for i, (w, _) in enumerate(ranked)}
    mass = np.zeros(CLASSES * SIZE)
    mass[:first] = 0.5
    for i, (_, c) in enumerate(ranked):
        mass[i] += c
    rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w.decode(),) for w in own] or [("",)], "word string")), "word", "left_anti").select(F.xxhash64("word").alias("h"), "c")  # at most 992 rows
    count = int(words) - len(own)
    has_leaf = leaf_words(rest, count, unit_words)
    keys, c = [], []
    for k in range(0, SHARED, SHARED // PARTS):  # in parts, so that the driver holds little at once
        found = rest.filter(has_leaf & F.pmod("h", F.lit(SHARED)).between(k, k + SHARED // PARTS - 1)).toArrow()
        own_keys, n = tree_keys(found.column("h").to_numpy().view(np.uint64)), found.column("c").to_numpy()
        found, order = None, np.argsort(own_keys)
        keys.append(own_keys[order])
        c.append(n[order].astype(np.int32 if n.max(initial=0) < 1 << 31 else np.int64))
    keys, c = np.concatenate(keys), np.concatenate(c)
    slots = max(1, min(-(-(count - len(c)) // (SHARED * SHARE_LEAF)), unit_words // (4 * SHARED)))
    shared = np.full((SHARED, slots), 0.5)
    if len(c) < count:
        place = F.pmod("h", F.lit(SHARED)) * slots + F.pmod(F.shiftrightunsigned("h", 32), F.lit(slots))
        table = rest.filter(~has_leaf).groupBy(place.alias("k")).agg((F.sum("c") + 0.5 * F.count(F.lit(1))).alias("m")).toArrow()  # at most unit_words / 4 rows
        shared.ravel()[table.column("k").to_numpy()] += table.column("m").to_numpy()
    tail = tail_of(keys, c, shared)
    mass[first:] = shared.sum(axis=1) + [(x + 0.5).sum() for x in np.split(c, tail.firsts[1:])]
    return Units(own, mass, int(total), int(words), tail)


def start_weights(units: Units) -> Weights:
    """Twice the rows for each doubling of the tokens from 2**21 on, up to 2**MOST_BITS."""
    mass = units.mass.reshape(CLASSES, SIZE)
    class_mass = mass.sum(axis=1)
    more = max(0, units.total.bit_length() - 21)
    zero = lambda bits, width=SIZE: np.zeros((1 << min(MOST_BITS, bits + more), width), np.float32)
    tails = tuple(zero(UNIT_BITS, units.tail.width) for _ in units.tail.caps) if units.tail else ()
    return Weights(np.log(class_mass / class_mass.sum()).astype(np.float32), np.log(mass / class_mass[:, None]).astype(np.float32), zero(CLASS_BITS), zero(UNIT_BITS), tails)


def rounds_for(total: int) -> int:
    """ROUNDS, and one more each time the tokens are four times as many from 2**26 on."""
    return max(ROUNDS, (total.bit_length() - 21) // 2)


def train(texts: DataFrame, shared_units: Broadcast, rounds: int | None = None) -> Weights:
    """Distributed gradient rounds over a table with id_ and text_; each text is in one round."""
    units = shared_units.value
    context = texts.sparkSession.sparkContext
    w = start_weights(units)
    rounds = rounds or rounds_for(units.total)
    blocks = np.cumsum([0, *[len(x) // BLOCK for x in w.tables]])
    work = max(1, min(MOST_WORK, -(-units.total // (rounds * WORK_TOKENS))))
    h = F.xxhash64("id_", "text_", F.lit(11))
    dealt = texts.select("id_", "text_", h.alias("h_"), F.pmod(F.shiftrightunsigned(h, 20), F.lit(work)).cast("int").alias("work_"))
    for k in range(rounds):
        shared = context.broadcast(w)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            claim("lm")
            learner = None
            for batch in slices(batches, "text_"):
                if learner is None:
                    learner, own = Learner(shared.value), batch.column("work_")[0].as_py()
                learner.learn(tokens([text_bytes(t) for t in batch.column("text_").to_pylist()], shared_units.value), shared_units.value.tail)
            if learner:
                for n, data in learner.changes():
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([own], pa.int32()), pa.array([data], pa.binary())], names=["block", "work", "data"])

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums sorted blocks one after another; a weight's change is averaged over the units of work that changed its row."""
            now, total, seen = None, None, None

            def out() -> pa.RecordBatch:
                mean = (total / np.maximum(seen, 1)[:, None]).astype(np.float32)
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([mean.tobytes()], pa.binary())], names=["block", "data"])

            for batch in batches:
                for n, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    if n != now:
                        if now is not None:
                            yield out()
                        now, total, seen = n, np.zeros((BLOCK, len(data) // (2 * BLOCK))), np.zeros(BLOCK)
                    d = np.frombuffer(data, np.float16).reshape(BLOCK, -1).astype(np.float32)
                    total += d
                    seen += d.any(axis=1)
            if now is not None:
                yield out()

        part = dealt.filter(F.pmod("h_", F.lit(rounds)) == k).repartitionById(work, "work_").sortWithinPartitions("h_", "id_", "text_")
        changes = part.mapInArrow(run, "block int, work int, data binary").repartition(min(int(blocks[-1]), MOST_SUMS), "block").sortWithinPartitions("block", "work")
        changed = changes.mapInArrow(add, "block int, data binary")
        changed = materialize(changed, "changed")  # so that its shuffle files go at once
        for table, first, end in zip(w.tables, blocks[:-1], blocks[1:], strict=True):
            for r in changed.filter(F.col("block").between(int(first), int(end) - 1)).collect():
                at = (r["block"] - int(first)) * BLOCK
                table[at : at + BLOCK] += np.frombuffer(r["data"], np.float32).reshape(BLOCK, -1)
        discard(changed)
        shared.destroy()
    return w


def counts_of(own: Tokens, units: Units) -> np.ndarray:
    """Counts of distinct tokens, where all words have a leaf or a unit."""
    at, known = found_in(units.tail, own.hashes)
    rare = np.where(known, units.tail.counts[at], 0) if len(units.tail.counts) else np.zeros(len(at), np.int64)
    return np.where(own.unit < CLASSES * SIZE - SHARED, np.round(units.mass[own.unit] - 0.5).astype(np.int64), rare)


def by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(counts) - counts) if len(counts) else np.zeros(0)


def score_lm(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = FOLD, rounds: int | None = None, lookup_words: int = LOOKUP_WORDS, unit_words: int = UNIT_WORDS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigram), score (the model), both log10 of the text's probability."""
    spark = docs.sparkSession
    rows = two_columns(docs, id_col, text_col)
    learn = rows.filter(crc_mod_column(F.col("id_"), fold[0]) != fold[1])
    counts = materialize(count_tokens(learn), "counts")
    units = output_units(counts, unit_words)
    shared_units = spark.sparkContext.broadcast(units)
    model = spark.sparkContext.broadcast(train(learn, shared_units, rounds))
    lookup = None
    if units.words <= min(lookup_words, unit_words):
        lookup = shared_units  # has all counts
    elif units.words <= lookup_words:
        found = counts.select(F.xxhash64("word").alias("h"), "c").toArrow()
        h, c = found.column("h").to_numpy(), found.column("c").to_numpy()
        order = np.argsort(h)
        lookup = spark.sparkContext.broadcast((h[order], c[order]))  # at most lookup_words entries of 16 bytes
    kind = ddl(rows.schema["id_"].dataType)

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        claim("lm")
        own_units, w = shared_units.value, model.value
        for batch in slices(batches, "text_"):
            own = tokens([text_bytes(t) for t in batch.column("text_").to_pylist()], own_units)
            logs = by_text(unit_logs(w, own, own_units.tail), own.counts) / np.log(10)
            ids = batch.column("id_")
            held = pa.array([crc_mod(x, fold[0]) == fold[1] for x in ids.to_pylist()])
            yield ids, held, own, logs, np.log10(np.where(own.mass > 0, own.mass, 1.0)), own.mass > 0, own_units

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lookup.value
        for ids, held, own, logs, mass, shared_unit, u in parts(batches):
            if isinstance(table, Units):
                n = counts_of(own, table)
            else:
                h, c = table
                signed = own.hashes.view(np.int64)
                at = np.minimum(np.searchsorted(h, signed), max(0, len(h) - 1))
                n = np.where(h[at] == signed, c[at], 0) if len(h) else np.zeros(len(signed), np.int64)
            log_n = np.log10(n + 0.5)
            base = log_n - np.log10(u.total + 0.5 * (u.words + 1))
            inside = np.where(shared_unit, log_n - mass, 0.0)
            arrays = [ids, held, pa.array(own.counts), pa.array(by_text((n > 0).astype(np.int64)[own.ids], own.counts)), pa.array(np.full(len(ids), u.total, np.int64)), pa.array(by_text(base[own.ids], own.counts)), pa.array(logs + by_text(inside[own.ids], own.counts))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id_", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def spelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the join: scores without what depends on counts, and the text's distinct words."""
        kind_ = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64()), ("shared", pa.bool_())]))
        for ids, held, own, logs, mass, shared_unit, _ in parts(batches):
            logs = logs - by_text(np.where(shared_unit, mass, 0.0)[own.ids], own.counts)
            signed, words = own.hashes.view(np.int64), []
            for x in np.split(own.ids, np.cumsum(own.counts)[:-1]):
                distinct, n = np.unique(x, return_counts=True)
                words.append([{"h": int(signed[i]), "n": int(k), "shared": bool(shared_unit[i])} for i, k in zip(distinct, n, strict=True)])
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(own.counts), pa.array(logs), pa.array(words, kind_)], names=["id_", "held_out", "n_tokens", "logs", "words"])

    if lookup is not None:
        out = rows.mapInArrow(scored, f"id_ {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        return out.withColumnRenamed("id_", id_col)
    table = rows.mapInArrow(spelled, f"id_ {kind}, held_out boolean, n_tokens long, logs double, words array<struct<h:long,n:long,shared:boolean>>")
    table = materialize(table.withColumn("row_", F.monotonically_increasing_id()), "spelled")  # written, so the row numbers stay
    words = table.select("row_", F.explode("words").alias("w")).select("row_", "w.*")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)) * F.col("n")
    sums = words.join(counts.select(F.xxhash64("word").alias("h"), "c"), "h", "left").groupBy("row_").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"), F.sum(log_c).alias("b"), F.sum(F.when(F.col("shared"), log_c).otherwise(0.0)).alias("s")
    )
    return table.join(sums, "row_").select(
        F.col("id_").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(units.total).cast("long").alias("train_tokens"),
        (F.col("b") - F.col("n_tokens") * F.lit(float(np.log10(units.total + 0.5 * (units.words + 1))))).alias("base_score"), (F.col("logs") + F.col("s")).alias("score"),
    )
