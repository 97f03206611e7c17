"""Operator 12: documents drawn by how likely their features are under a target's distribution.

The counts of each document's hashed features are written once, as a sparse matrix (a row of the table holds the buckets and counts of one
document). Its column sums give both distributions; a bucket's gain is the logarithm of their smoothed ratio. A document's weight is its row
of the matrix times the gains, over its features. Weights with Gumbel noise by id are ranked by
range-sorted partitions and their offsets. The driver sees one number a bucket.

Results by definition:
* Null or empty text: no features, weight 0, never drawn unless least_words is 0. An empty target or corpus has counts of zero, the smoothing stays.
  Empty table: no rows.
* A null id counts as the empty text in the noise and comes last among equal scores. Rows that repeat an id are rows of their own with the same
  noise; what ties with the same id is ordered by features and weight. Other columns are not read, whatever their names.
* Very long texts are taken apart in pieces of PIECE bytes that end between words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duoscope.llm.common import claim, ddl, slices, text_bytes, two_columns
from duoscope.runtime import discard, materialize

#: Bytes of a text that are taken apart at a time.
PIECE = 1 << 20
#: Buckets of features that a worker remembers; all are forgotten at that number.
REMEMBERED = 1_000_000

#: Bytes of words stay (0-9, a-z, all of non-ASCII code points), A-Z become small, the others are spaces.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class Buckets(dict):
    """From a feature's bytes to its bucket."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        at = self[feature] = zlib.crc32(feature) % self.buckets
        return at


def word_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    data = text_bytes(text).translate(_WORDS)
    at = 0
    while at < len(data):
        to = at + PIECE
        if to < len(data):
            cut = data.rfind(b" ", at, to)
            cut = data.find(b" ", to) if cut < 0 else cut
            to = len(data) if cut < 0 else cut + 1
        yield data[at:to].split()
        at = to


def count_row(text: str | None, ngrams: int, known: Buckets) -> tuple[int, np.ndarray, np.ndarray]:
    """Words, and the buckets of a text's features in order with their counts."""
    n, tail = 0, []
    first = dense = None
    for words in word_pieces(text):
        n += len(words)
        runs = words
        if ngrams > 1:
            both = tail + words
            runs = words + [b" ".join(both[i - k + 1 : i + 1]) for i in range(len(tail), len(both)) for k in range(2, min(ngrams, i + 1) + 1)]
            tail = both[-(ngrams - 1) :]
        found = np.fromiter(map(known.__getitem__, runs), np.int64, len(runs))
        if first is None:
            first = found
        else:  # a text of several pieces is summed by bucket
            dense = np.bincount(found, minlength=known.buckets) + (np.bincount(first, minlength=known.buckets) if dense is None else dense)
    if dense is not None:
        at = np.flatnonzero(dense)
        return n, at, dense[at]
    at, times = np.unique(np.zeros(0, np.int64) if first is None else first, return_counts=True)
    return n, at, times


def count_matrix(docs: DataFrame, id_col: str, text_col: str, ngrams: int, buckets: int) -> DataFrame:
    """The sparse matrix, a row a document: id_, n_words, columns and counts (as many as it has buckets, at most `buckets`).

    A reader decodes thousands of rows at once, so no row may hold more than a document.
    """
    rows = two_columns(docs, id_col, text_col)
    kind = ddl(rows.schema["id_"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("resampling")
        known = Buckets(buckets)
        for batch in slices(batches, "text_"):
            found = [count_row(text, ngrams, known) for text in batch.column("text_").to_pylist()]
            ends = pa.array(np.cumsum([0, *[len(c) for _, c, _ in found]]), pa.int32())
            cells = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[i] for f in found]), kind_)) for i, kind_ in ((1, pa.int32()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id_"), pa.array([n for n, _, _ in found], pa.int64()), *cells], names=["id_", "n_words", "columns", "counts"])

    return rows.mapInArrow(run, f"id_ {kind}, n_words long, columns array<int>, counts array<long>")


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' columns and counts, one after another, and where rows end."""
    columns, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("columns", "counts"))
    return columns, counts, np.cumsum(batch.column("columns").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))


def column_sums(matrix: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket. Each task adds up its rows; a row a bucket reaches the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            columns, counts, _ = _cells(batch)
            np.add.at(total, columns, counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    sums = matrix.select("columns", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(of_corpus: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed ratio, floored."""
    s, t, n = of_corpus.astype(np.float64), of_target.astype(np.float64), float(len(of_corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per document: id_, n_words, n_features and weight: the matrix's product with the gains, over the document's features."""
    kind = ddl(matrix.schema["id_"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, counts, ends = _cells(batch)
            both = [np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])] for x in (gain[columns] * counts, counts)]
            total, n = (np.diff(x) for x in both)
            yield pa.RecordBatch.from_arrays([batch.column("id_"), batch.column("n_words"), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["id_", "n_words", "n_features", "weight"])

    return matrix.select("id_", "n_words", "columns", "counts").mapInArrow(run, f"id_ {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, least: int) -> DataFrame:
    """rows with rank, from 1, in a total order: partitions sorted by range, then their offsets. Ranks over least are null.

    Only partitions' sizes (a row each) meet in one task.
    """
    parts = materialize(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part_", before.alias("before_"))
    at = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) + F.col("before_")
    return parts.join(F.broadcast(offsets), "part_").withColumn("rank", at).withColumn("rank", F.when(F.col("rank") <= least, F.col("rank")).cast("long")).drop("part_", "before_")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
    ngrams: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024",
) -> DataFrame:
    """Per document: id, n_words, n_features, weight, score and rank (null where it is not drawn).

    Of the documents with at least least_words words the percent with the highest scores is drawn.
    """
    matrix = materialize(count_matrix(docs, id_col, text_col, ngrams, buckets), "counts")
    aim = materialize(count_matrix(target, target_id, target_text, ngrams, buckets), "target_counts")
    gain = gains(column_sums(matrix, buckets), column_sums(aim, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id_").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = materialize(weights(matrix, gain).withColumn("score", F.col("weight") + noise), "scores")
    for done in (matrix, aim):
        discard(done)
    may = rows.filter(F.col("n_words") >= least_words)
    drawn = ranked(may, [F.desc("score"), F.col("id_").asc_nulls_last(), F.col("n_features"), F.col("weight")], percent * may.count() // 100)
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).withColumnRenamed("id_", id_col)
