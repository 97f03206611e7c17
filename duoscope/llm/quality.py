"""Quality rules: exact base counts, then a calibrated logistic regression on hashed word and character n-grams.

Base counts use words `[^\\x20\\x09-\\x0D]+` of the whole text; a text with fewer than 20 words, or of which over 30 % of the words
lie in repeated 8-word windows, fails. The model sees hashed words, word pairs and sequences of 3 and 4 characters (code points), each as its
share of the text. It is trained on a bounded, hash-ordered sample of labelled rows of each class; a quarter of the
sample is left out of training and calibrates the probabilities (Platt's method), with classes weighted as in all labels.

Null texts count as empty: no words, base_failed. Repeated ids give a row each. Labels are read by id; null labels and ids are
left out, and of contradicting ones the greater counts. Without labels of both classes every probability is 0.5 and the
verdict is that of the base rules. A probability that equals keep_from is kept. Very long texts are scored whole, and learned from where the sample's
words allow it. An empty table gives an empty one. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from duoscope.llm.common import bounded_labels, claim, class_counts, ddl, mix64, platt, sampled_texts, slices, text_bytes, two_columns

#: The bound of the training sample: rows of each class.
PER_CLASS = 1500
#: And its words, half of them for each class.
TRAIN_WORDS = 6_000_000
BITS = 17
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
KEEP_FROM = 0.5

_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)


class Words(NamedTuple):
    """Texts taken apart: unique words, and for each word of the texts its number among them and its text."""

    unique: list[bytes]
    ids: np.ndarray
    counts: np.ndarray


def take_apart(raws: list[bytes]) -> Words:
    index: dict[bytes, int] = {}
    put = index.setdefault
    parts = [np.array([put(w, len(index)) for w in raw.split()], np.int64) for raw in raws]
    return Words(list(index), np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array([len(p) for p in parts], np.int64))


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Per text, words in windows that the text has twice or more."""
    n, owner = len(words.ids), np.repeat(np.arange(len(words.counts)), words.counts)
    if n < window:
        return np.zeros(len(words.counts), np.int64)
    base = mix64(words.ids + 1)
    starts = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    h = mix64(owner[starts].astype(np.uint64) + np.uint64(1 << 40))
    for k in range(window):  # words of a text have different numbers, so equal sums mean equal windows but for 64-bit collisions
        h = (h ^ base[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(starts), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[again], 1)
    np.add.at(edge, starts[again] + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(words.counts))


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def base(raws: list[bytes], words: Words) -> dict[str, np.ndarray]:
    def code_points(raw: bytes) -> int:
        data = np.frombuffer(raw, np.uint8)
        return int(np.count_nonzero((data & 0xC0) != 0x80)) - int(np.count_nonzero((data == 32) | ((data >= 9) & (data <= 13))))

    out = {
        "n_words": words.counts, "word_chars": np.array([code_points(r) for r in raws], np.int64),
        "n_symbols": np.array([len(r.translate(None, _NOT_SYMBOL)) for r in raws], np.int64),
        "n_dup_lines": np.array([duplicate_lines(r) for r in raws], np.int64), "n_repeat_words": repeated_words(words),
    }
    return out | {"base_failed": (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])}


def features(raws: list[bytes], words: Words, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group of features, the hashed feature of each item and the item's text."""
    shift = np.uint64(64 - bits)
    hashed = np.array([xxhash.xxh64_intdigest(w) for w in words.unique], np.uint64)[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(raws)), words.counts)
    same = owner[1:] == owner[:-1]
    pair = (hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashed[1:])[same]
    out = [((mix64(hashed) >> shift).astype(np.int64), owner), ((mix64(pair) >> shift).astype(np.int64), owner[1:][same])]
    texts = [raw.decode("utf-8", "replace") for raw in raws]
    data = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    text = np.repeat(np.arange(len(raws)), [len(t) for t in texts])
    for n, factor in ((3, 0x9E3779B97F4A7C15), (4, 0x85EBCA77C2B2AE63)):
        m = max(0, len(data) - n + 1)
        h = np.zeros(m, np.uint64)
        for k in range(n):  # 21 bits hold a code point: three fit, four are folded
            h = (h << np.uint64(21) | h >> np.uint64(43)) ^ data[k : k + m]
        inside = text[:m] == text[n - 1 :]
        out.append((((h * np.uint64(factor)) >> shift).astype(np.int64)[inside], text[:m][inside]))
    return out


class Model(NamedTuple):
    weights: np.ndarray  # groups x 2**bits
    bias: float
    slope: float
    intercept: float


#: Shares of a text are small, so they are scaled.
SCALE = 20.0


def logits(model: Model, raws: list[bytes], words: Words) -> np.ndarray:
    out = np.full(len(raws), model.bias)
    for w, (idx, owner) in zip(model.weights, features(raws, words), strict=True):
        n = np.maximum(np.bincount(owner, minlength=len(raws)), 1)
        out += SCALE * np.bincount(owner, weights=w[idx], minlength=len(raws)) / n
    return out


def probabilities(model: Model | None, raws: list[bytes], words: Words) -> np.ndarray:
    if model is None:
        return np.full(len(raws), 0.5)
    return 1 / (1 + np.exp(-np.clip(model.slope * logits(model, raws, words) + model.intercept, -30, 30)))


def fit(rows: list[tuple[bytes, int]], share_of_one: float, epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Model | None:
    """rows: text and class. A quarter of each class, by order of the text's hash, calibrates."""
    rows = sorted(rows, key=lambda r: xxhash.xxh64_intdigest(r[0], seed))
    y = np.array([r[1] for r in rows], np.float64)
    if not 0 < y.sum() < len(y):
        return None
    held = np.zeros(len(rows), bool)
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        held[at[::4][: len(at) // 4]] = True
    groups: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for raw, _ in rows:
        own = []
        for idx, _ in features([raw], take_apart([raw])):
            u, c = np.unique(idx, return_counts=True)
            own.append((u.astype(np.int32), (SCALE * c / max(1, c.sum())).astype(np.float32)))
        groups.append(own)
    weights, squares, bias, bias_square = np.zeros((4, 1 << BITS), np.float32), np.full((4, 1 << BITS), 1e-3, np.float32), 0.0, 1e-3
    train = np.flatnonzero(~held)
    balance = {c: len(train) / 2 / max(1, (y[train] == c).sum()) for c in (0, 1)}
    value = lambda i: bias + sum(float(weights[g][u] @ v) for g, (u, v) in enumerate(groups[i]))
    generator = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in generator.permutation(train):
            grad = (1 / (1 + np.exp(-np.clip(value(i), -30, 30))) - y[i]) * balance[int(y[i])]
            for g, (u, v) in enumerate(groups[i]):
                step = grad * v + 1e-5 * weights[g][u]
                squares[g][u] += step * step
                weights[g][u] -= rate * 0.2 * step / np.sqrt(squares[g][u])
            bias_square += grad * grad
            bias -= rate * 0.2 * grad / np.sqrt(bias_square)
    at = np.flatnonzero(held) if held.any() else train
    true = {0: 1 - share_of_one, 1: share_of_one}
    weight = np.array([true[int(c)] / max(1, (y[at] == c).sum()) for c in y[at]]) * len(at)
    return Model(weights, bias, *platt(np.array([value(i) for i in at]), y[at], weight))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, train_words: int = TRAIN_WORDS) -> Model | None:
    """Fits on at most per_class rows of each class and train_words / 2 words of each; these alone go to the driver, bounded before they do."""
    found = sampled_texts(docs, bounded_labels(labels, id_col, label_col, per_class), id_col, text_col, train_words)
    rows = [(text_bytes(t.as_py()), y) for t, y in zip(found.column("text_"), found.column("y_").to_pylist(), strict=True)]
    zero, one = class_counts(labels, id_col, label_col)
    return fit(rows, one / max(1, zero + one))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, keep_from: float = KEEP_FROM, train_words: int = TRAIN_WORDS) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability (of quality 1), kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, per_class, train_words))  # 4 x 2**17 floats
    rows = two_columns(docs, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in slices(batches, "text_"):
            raws = [text_bytes(t) for t in batch.column("text_").to_pylist()]
            words = take_apart(raws)
            own = base(raws, words)
            own["probability"] = probabilities(model.value, raws, words)
            own["kept"] = ~own["base_failed"] & (own["probability"] >= keep_from)
            yield pa.RecordBatch.from_arrays([batch.column("id_"), *map(pa.array, own.values())], names=["id_", *own])

    kind = ddl(rows.schema["id_"].dataType)
    return rows.mapInArrow(
        run, f"id_ {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    ).withColumnRenamed("id_", id_col)
