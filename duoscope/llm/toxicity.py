"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the mean of hashed rows for the word, its beginnings and its ends. Filters of widths 1, 2 and 3 run over the
words, the greatest response of each filter over the whole text is kept (max pooling), and a logistic layer gives the score.
It is trained on a bounded, hash-ordered sample of labelled rows, where a text too long for what is left of its class's words is passed over; a fifth of the sample is left out and calibrates the score
(Platt's method) and the threshold of each language, which is drawn to the common threshold 0.5 the more the fewer toxic rows the language has there.
Neither labels, language, source nor id are inputs of a score.

Null and empty texts are scored like a text without words; very long ones are scored whole. Repeated ids give a row each. Without labels of both
classes every score is 0. A score that equals a threshold reaches it. A language without calibration rows of both classes, unknown or null takes the
common threshold. An empty table gives an empty one. Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from duoscope.llm.common import bounded_labels, claim, class_counts, crc_mod, ddl, platt, sampled_texts, slices, text_bytes, within_words
from duoscope.llm.quality import Words, take_apart

#: The bound of the training sample: rows of each class, and words in all, half of them for each class.
PER_CLASS = 4000
TRAIN_WORDS = 6_000_000
FOLD = (5, 0)
BITS, DIM, FILTERS, WIDTHS = 16, 16, 16, (1, 2, 3)
BEGINNINGS, ENDS = (3, 4, 5, 6, 7, 8, 9), (3, 5)
CACHED_WORDS = 250_000
#: Bytes of text whose responses a worker holds at a time.
HELD_BYTES = 1 << 20
#: Toxic calibration rows from which a language's own threshold counts more than the common one.
EVEN_ROWS = 25

_EDGES = bytes(range(0x21, 0x30)) + b":;<=>?@[]^_`{|}~"


def pieces(word: bytes) -> list[int]:
    """Hashed rows of a word: itself, its beginnings and its ends, lower-cased, without edge punctuation."""
    word = word.lower().strip(_EDGES)
    own = {b"^%b$" % word} | {b"^" + word[:n] for n in BEGINNINGS if n < len(word)} | {word[-n:] + b"$" for n in ENDS if n < len(word)}
    return [xxhash.xxh64_intdigest(x) >> (64 - BITS) for x in own]


class Model(NamedTuple):
    table: np.ndarray  # 2**BITS x DIM
    kernels: list[np.ndarray]  # for each width: width x DIM x FILTERS
    shifts: np.ndarray  # for each width and filter
    out: np.ndarray
    bias: float
    slope: float
    intercept: float


class Embedder:
    """Embeddings of words, kept from call to call up to a number of words."""

    def __init__(self, table: np.ndarray) -> None:
        self.table, self.rows, self.known = table, np.zeros((1024, DIM), np.float32), {}

    def __call__(self, unique: list[bytes]) -> np.ndarray:
        if len(self.known) + len(unique) > CACHED_WORDS:
            self.known = {}
        new = [w for w in unique if w not in self.known]
        if new:
            ids = [pieces(w) for w in new]
            counts = np.array([len(x) for x in ids])
            flat = self.table[np.concatenate([np.array(x) for x in ids])]
            sums = np.add.reduceat(flat, np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0) / counts[:, None]
            at = len(self.known)
            if at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[:at], np.zeros((max(at, len(new)) + len(new), DIM), np.float32)])
            self.rows[at : at + len(new)] = sums
            for w in new:
                self.known[w] = len(self.known)
        return self.rows[[self.known[w] for w in unique]] if unique else np.zeros((0, DIM), np.float32)


def pooled(model: Model, embedded: np.ndarray, words: Words, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Greatest response of each filter in each text (0 where the text is shorter than the filter), and at which word it starts."""
    texts, n = len(words.counts), len(words.ids)
    ends = np.cumsum(words.counts)
    out = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
    at = np.full(out.shape, -1, np.int64) if where else None
    for k, (width, kernel) in enumerate(zip(WIDTHS, model.kernels, strict=True)):
        long = np.flatnonzero(words.counts >= width)
        if not len(long):
            continue
        response = np.zeros((n, FILTERS), np.float32)
        for j in range(width):
            response[: n - j] += (embedded @ kernel[j])[words.ids[j:]]
        # runs: a text's window starts, then the starts that would pass its end
        first = ends[long] - words.counts[long]
        edges = np.stack([first, ends[long] - width + 1], axis=1).ravel()
        most = np.maximum.reduceat(np.concatenate([response, np.full((1, FILTERS), -np.inf, np.float32)]), edges, axis=0)[::2]
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        value = most + model.shifts[cols]
        out[long, cols] = np.maximum(value, 0)
        if where:
            for t, a, b, v in zip(long, first, ends[long] - width + 1, value, strict=True):
                at[t, cols] = np.where(v > 0, a + response[a:b].argmax(axis=0), -1)
    return out, at


def logits(model: Model, embed: Embedder, raws: list[bytes]) -> np.ndarray:
    words = take_apart(raws)
    return pooled(model, embed(words.unique), words)[0] @ model.out + model.bias


def scores(model: Model | None, embed: Embedder | None, raws: list[bytes]) -> np.ndarray:
    if model is None:
        return np.zeros(len(raws))
    return 1 / (1 + np.exp(-np.clip(model.slope * logits(model, embed, raws).astype(np.float64) + model.intercept, -30, 30)))


def fit(rows: list[tuple[bytes, int, str | None]], share_of_one: float, epochs: int = 4, batch: int = 16, rate: float = 0.05, seed: int = 5, train_words: int = TRAIN_WORDS) -> tuple[Model | None, dict[str, float]]:
    """rows: text, class and language. Returns the model and the thresholds of languages."""
    rows = sorted(rows, key=lambda r: xxhash.xxh64_intdigest(r[0], seed))
    kept = within_words([(r, r[1], len(r[0].split())) for r in rows], train_words)
    kept = [r for r, _, _ in kept]
    y = np.array([r[1] for r in kept], np.float32)
    if not 0 < y.sum() < len(y):
        return None, {}
    held = np.zeros(len(kept), bool)
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        held[at[::5][: len(at) // 5]] = True
    words = take_apart([r[0] for r in kept])
    kept = [(None, *r[1:]) for r in kept]  # the texts are no longer needed
    rows.clear()
    starts = np.cumsum(words.counts) - words.counts
    ids = [np.array(pieces(w), np.int32) for w in words.unique]
    sizes = np.array([len(x) for x in ids] or [0])
    begin, flat = np.cumsum(sizes) - sizes, np.concatenate(ids) if ids else np.zeros(0, np.int32)
    del ids
    g = np.random.default_rng(seed)
    table = g.normal(0, 0.5, (1 << BITS, DIM)).astype(np.float32)
    kernels = [g.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    odds = log_odds(words, begin, sizes, flat, y * ~held, ~held)
    table[:, 0] = odds  # the first filter of the narrowest width starts as the most telling word of a text
    kernels[0][0][:, 0] = np.eye(DIM, dtype=np.float32)[0]
    shifts, out, bias = np.zeros(len(WIDTHS) * FILTERS, np.float32), g.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32), 0.0
    out[0] = 1.0
    squares = {"table": np.full(1 << BITS, 1e-4, np.float32), "shifts": np.full_like(shifts, 1e-4), "out": np.full_like(out, 1e-4), "bias": 1e-4} | {k: np.full_like(x, 1e-4) for k, x in enumerate(kernels)}
    train = np.flatnonzero(~held)
    balance = {c: len(train) / 2 / max(1, (y[train] == c).sum()) for c in (0, 1)}

    def part(texts: np.ndarray) -> Words:
        spans = np.concatenate([words.ids[starts[t] : starts[t] + words.counts[t]] for t in texts]) if len(texts) else np.zeros(0, np.int64)
        unique, inverse = np.unique(spans, return_inverse=True)
        return Words(unique, inverse, words.counts[texts])

    def embedded(unique: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = sizes[unique]
        rows_ = flat[np.repeat(begin[unique] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        owner = np.repeat(np.arange(len(unique)), n)
        return np.add.reduceat(table[rows_], np.cumsum(n) - n, axis=0) / n[:, None] if len(unique) else np.zeros((0, DIM), np.float32), rows_, owner

    for epoch in range(epochs):
        step = rate * (1 - 0.8 * epoch / epochs)
        order = g.permutation(train)
        for s in range(0, len(order), batch):
            texts = order[s : s + batch]
            own = part(texts)
            x, rows_, owner = embedded(own.unique)
            model = Model(table, kernels, shifts, out, bias, 1, 0)
            top, at = pooled(model, x, own, where=True)
            drop = (g.random(top.shape) > 0.2) / np.float32(0.8)
            p = 1 / (1 + np.exp(-np.clip((top * drop) @ out + bias, -30, 30)))
            d = (p - y[texts]) * np.array([balance[int(c)] for c in y[texts]], np.float32) / len(texts)
            d_top = d[:, None] * out[None, :] * drop * (at >= 0)
            d_out, d_bias = (top * drop).T @ d + 1e-4 * out, float(d.sum())
            d_x = np.zeros_like(x)
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                delta = d_top[:, cols]
                for j in range(width):
                    w = own.ids[np.maximum(at[:, cols], 0) + j] if len(own.ids) >= width else np.zeros(delta.shape, np.int64)
                    grad = np.einsum("tf,tfd->df", delta, x[w]) + 1e-5 * kernels[k][j]
                    np.add.at(d_x, w.ravel(), (delta[:, :, None] * kernels[k][j].T[None]).reshape(-1, DIM))
                    squares[k][j] += grad * grad
                    kernels[k][j] -= step * grad / np.sqrt(squares[k][j])
            mask = np.abs(d_x).sum(axis=1)[owner] > 0
            touched = rows_[mask]
            change = d_x[owner[mask]] / sizes[own.unique][owner[mask]][:, None]
            unique, inverse = np.unique(touched, return_inverse=True)
            total_change = np.zeros((len(unique), DIM), np.float32)
            np.add.at(total_change, inverse, change)
            squares["table"][unique] += (total_change**2).sum(axis=1)
            table[unique] -= 4 * step * total_change / np.sqrt(squares["table"][unique])[:, None]
            d_shift = d_top.sum(axis=0)
            squares["shifts"] += d_shift**2
            shifts -= step * d_shift / np.sqrt(squares["shifts"])
            squares["out"] += d_out**2
            out -= step * d_out / np.sqrt(squares["out"])
            squares["bias"] += d_bias**2
            bias -= step * d_bias / squares["bias"] ** 0.5
    model = Model(table, kernels, shifts, out, bias, 1.0, 0.0)

    def value(texts: np.ndarray) -> np.ndarray:
        out_ = []
        for s in range(0, len(texts), 64):
            own = part(texts[s : s + 64])
            out_.append(pooled(model, embedded(own.unique)[0], own)[0] @ out + bias)
        return np.concatenate(out_).astype(np.float64)

    at = np.flatnonzero(held) if held.any() else train
    z, yt = value(at), y[at]
    true = {0: 1 - share_of_one, 1: share_of_one}
    weight = np.array([true[int(c)] / max(1, (yt == c).sum()) for c in yt]) * len(at)
    slope, intercept = platt(z, yt, weight)
    p = 1 / (1 + np.exp(-np.clip(slope * z + intercept, -30, 30)))
    thresholds = {}
    for lang in sorted({kept[i][2] for i in at if kept[i][2] is not None}):
        own = np.array([kept[i][2] == lang for i in at])
        n = int((own & (yt == 1)).sum())
        if n and (own & (yt == 0)).any():
            thresholds[lang] = (n * best_threshold(p[own], yt[own], weight[own]) + EVEN_ROWS * 0.5) / (n + EVEN_ROWS)
    return model._replace(slope=slope, intercept=intercept), thresholds


def log_odds(words: Words, begin: np.ndarray, sizes: np.ndarray, flat: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """For each hashed row the smoothed log odds that a text with it has class 1, from the texts in use."""
    starts, seen = np.cumsum(words.counts) - words.counts, np.zeros((2, 1 << BITS))
    for t in np.flatnonzero(used):
        own = np.unique(words.ids[starts[t] : starts[t] + words.counts[t]])
        n = sizes[own]
        seen[int(y[t]), np.unique(flat[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())])] += 1
    share = y[used].sum() / used.sum()
    return (np.log((seen[1] + 4 * share) / (seen[0] + 4 * (1 - share))) - np.log(share / (1 - share))).astype(np.float32)


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the greatest weighted F1, the nearest to 0.5 of those within 1 % of it."""
    grid = np.linspace(0.05, 0.95, 91)
    f1 = np.array([2 * (weight * (p >= t) * y).sum() / max(1e-9, (weight * (p >= t)).sum() + (weight * y).sum()) for t in grid])
    good = grid[f1 >= 0.99 * f1.max()]
    return float(good[np.abs(good - 0.5).argmin()])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", per_class: int = PER_CLASS, fold: tuple[int, int] | None = FOLD, train_words: int = TRAIN_WORDS) -> tuple[Model | None, dict[str, float]]:
    """Fits on at most per_class labelled rows of each class outside the fold, and train_words / 2 words of each; these rows alone go to the driver, bounded before they do."""
    picked = bounded_labels(labels, id_col, label_col, per_class, fold)
    found = sampled_texts(docs, picked, id_col, text_col, train_words, (lang_col,)).select(["text_", "y_", f"{lang_col}_"])
    rows = [(text_bytes(t.as_py()), y, lang) for t, y, lang in zip(found.column(0), found.column(1).to_pylist(), found.column(2).to_pylist(), strict=True)]
    found = None
    zero, one = class_counts(labels, id_col, label_col, fold)
    return fit(rows, one / max(1, zero + one), train_words=train_words)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", per_class: int = PER_CLASS, fold: tuple[int, int] = FOLD, train_words: int = TRAIN_WORDS) -> DataFrame:
    """Per row: id, held_out, score, predicted (score >= 0.5), threshold (of the row's language), toxic (score >= threshold)."""
    model, thresholds = train(docs, labels, id_col, text_col, lang_col, label_col, per_class, fold, train_words)
    shared = docs.sparkSession.sparkContext.broadcast((model, thresholds))  # 2**16 x 16 floats
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"), F.col(lang_col).cast("string").alias("lang_"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        own, limits = shared.value
        embed = Embedder(own.table) if own else None
        for batch in slices(batches, "text_", HELD_BYTES):
            p = scores(own, embed, [text_bytes(t) for t in batch.column("text_").to_pylist()])
            limit = np.array([limits.get(x, 0.5) for x in batch.column("lang_").to_pylist()])
            held = [crc_mod(x, fold[0]) == fold[1] for x in batch.column("id_").to_pylist()]
            arrays = [batch.column("id_"), pa.array(held), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(limit), pa.array(p >= limit)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id_", "held_out", "score", "predicted", "threshold", "toxic"])

    kind = ddl(rows.schema["id_"].dataType)
    return rows.mapInArrow(run, f"id_ {kind}, held_out boolean, score double, predicted int, threshold double, toxic boolean").withColumnRenamed("id_", id_col)


#: The column that mark_toxic() adds.
MARK = "is_toxic_"


def mark_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", per_class: int = PER_CLASS, fold: tuple[int, int] = FOLD, train_words: int = TRAIN_WORDS) -> DataFrame:
    """The documents with all their columns and MARK, whether the score reaches the language's threshold. No shuffle."""
    model, thresholds = train(docs, labels, id_col, text_col, lang_col, label_col, per_class, fold, train_words)
    shared = docs.sparkSession.sparkContext.broadcast((model, thresholds))
    schema = StructType([*docs.schema.fields, StructField(MARK, BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        own, limits = shared.value
        embed = Embedder(own.table) if own else None
        for batch in slices(batches, text_col, HELD_BYTES):
            p = scores(own, embed, [text_bytes(t) for t in batch.column(text_col).to_pylist()])
            yield batch.append_column(MARK, pa.array(p >= np.array([limits.get(x, 0.5) for x in batch.column(lang_col).to_pylist()])))

    return docs.mapInArrow(run, schema)
