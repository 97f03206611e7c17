"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from duoscope.runtime import discard, materialize

#: Bytes of text that a Python worker takes apart at a time; one longer text is taken whole.
SLICE_BYTES = 1 << 21
WORD = r"[^\x20\x09-\x0D]+"


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each piece holds at most limit bytes of the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at, before = to, int(ends[to - 1])


def ddl(kind: DataType) -> str:
    return kind.simpleString()


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names of our own: no column that comes along can clash."""
    return df.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))


_CACHES: dict[str, Callable[[], None]] = {}


def claim(name: str, drop: Callable[[], None] = lambda: None) -> None:
    """Called in a Python worker by the operator that begins work there: what other operators have left in the worker's memory goes."""
    for other in [k for k in _CACHES if k != name]:
        _CACHES.pop(other)()
    _CACHES[name] = drop


def text_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc_mod(doc_id, mod: int) -> int:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def crc_mod_column(column, mod: int):
    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0)) % F.lit(mod)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bounded_labels(labels: DataFrame, id_col: str, label_col: str, per_class: int, fold: tuple[int, int] | None = None) -> DataFrame:
    """At most per_class labelled ids of each class (0 and 1), those with the smallest hash of the id: (id_, y_).

    fold=(mod, remainder) leaves out ids with that crc32 remainder. An id with several labels counts as 1 if any is 1;
    null ids and labels are left out.
    """
    known = labels.select(F.col(id_col).alias("id_"), F.col(label_col).cast("int").alias("y_")).filter("id_ is not null and y_ in (0, 1)")
    if fold:
        known = known.filter(crc_mod_column(F.col("id_"), fold[0]) != fold[1])
    known = known.groupBy("id_").agg(F.max("y_").alias("y_"))
    return known.filter("y_ = 0").orderBy(F.xxhash64("id_"), "id_").limit(per_class).unionByName(known.filter("y_ = 1").orderBy(F.xxhash64("id_"), "id_").limit(per_class))


def class_counts(labels: DataFrame, id_col: str, label_col: str, fold: tuple[int, int] | None = None) -> tuple[int, int]:
    """How many distinct labelled ids each class has."""
    known = labels.select(F.col(id_col).alias("id_"), F.col(label_col).cast("int").alias("y_")).filter("id_ is not null and y_ in (0, 1)")
    if fold:
        known = known.filter(crc_mod_column(F.col("id_"), fold[0]) != fold[1])
    row = known.groupBy("id_").agg(F.max("y_").alias("y_")).agg(F.count_if(F.col("y_") == 0), F.count_if(F.col("y_") == 1)).first()
    return int(row[0]), int(row[1])


def labelled_texts(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The texts of the picked ids. The picked side is bounded by its maker's parameter, so it is broadcast.

    Of rows that repeat an id the one with the smallest text counts.
    """
    rows = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_"), *[F.col(c).alias(f"{c}_") for c in extra])
    return rows.join(F.broadcast(picked), "id_").groupBy("id_").agg(F.min(F.struct("text_", "y_", *[f"{c}_" for c in extra])).alias("s")).select("id_", "s.*")


def within_words(rows: list[tuple], train_words: int) -> list[tuple]:
    """rows: (any, class, size). The rows in order, each class up to half of train_words. One too large for what is left is passed over; the smallest of a class always stays."""
    least = {c: min((i for i, r in enumerate(rows) if r[1] == c), key=lambda i: rows[i][2], default=-1) for c in (0, 1)}
    left = {c: train_words // 2 - (rows[i][2] if i >= 0 else 0) for c, i in least.items()}
    kept = []
    for i, r in enumerate(rows):
        if i != least[r[1]]:
            if r[2] > left[r[1]]:
                continue
            left[r[1]] -= r[2]
        kept.append(r)
    return kept


def sampled_texts(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str, train_words: int, extra: tuple[str, ...] = ()) -> pa.Table:
    """labelled_texts() for training on the driver, with words and bytes bounded before they are collected.

    Each class has half of train_words, in order of the texts' hashes. A text counts as many words as it has, or as one for each 16 bytes if
    that is more, so that no more than 16 * train_words bytes are collected (besides one text of each class). One too large for what is left is
    passed over. What the driver chooses from is a number a picked row.
    """
    sample = materialize(labelled_texts(docs, picked, id_col, text_col, extra).withColumn("row_", F.monotonically_increasing_id()), "sample")
    size = F.greatest(F.regexp_count("text_", F.lit(WORD)), F.ceil(F.octet_length("text_") / 16).cast("int"))
    rows = sorted(map(tuple, sample.select(F.xxhash64("text_"), "row_", "y_", size).collect()))
    kept = within_words([r[1:] for r in rows], train_words)
    found = sample
    if len(kept) < len(rows):
        found = sample.join(F.broadcast(docs.sparkSession.createDataFrame([(r[0],) for r in kept], "row_ long")), "row_")  # no more than the picked rows
    found = found.drop("row_", "id_").toArrow()
    discard(sample)
    return found


def platt(logits: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Weighted logistic fit of y on one logit, by Newton's method with a small ridge towards slope 1: (slope, intercept)."""
    a, b = 1.0, 0.0
    ridge = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        g = weight * (p - y)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * logits).sum() + ridge * (a - 1), g.sum() + 1e-3 * b
        haa, hab, hbb = (h * logits * logits).sum() + ridge, (h * logits).sum(), h.sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -4, 4))
        if abs(da) + abs(db) < 1e-7:
            break
    return max(a, 1e-3), b
