"""Operator 11: codes of vector parts by Lloyd's rounds whose sums are kept up by differences.

Vectors are made whole numbers (floor of scale * x) and cut into equal parts; each part position has a codebook. They are written once, bucketed
by a row number; each round's assignments are written in the same buckets, so a round joins a vector with its last assignment without a
shuffle. What a round shuffles are the plus and minus contributions of parts whose assignment changed, summed in each Arrow batch beforehand;
each task adds its own up, and they join the running whole-number sums, which are written as a small table. The driver sees codebooks only (parts x entries x width).

Results by definition:
* A vector that is null or empty, has a null or non-finite component or one beyond 2^70, or whose length is not the table's (the length that
  most vectors have among those the number of parts divides; ties to the longer one) is left out. No rows left: no rows.
* Fewer rows than entries: codebooks have as many entries as rows. Codebooks start from the smallest ids; of equal ids the smaller vector counts
  first, null ids come last. Rows that repeat an id are rows of their own. Equal distances go to the lower entry.
* Null labels form one label. Other columns are not read, whatever their names. An error over 2^63 - 1 is given as that.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import ddl
from duoscope.runtime import discard, fresh_path, materialize

#: Bytes of vectors to a bucket; Spark's own limit on buckets holds besides.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000
#: Sums by label are broadcast up to so many labels, joined beyond.
SENT_LABELS = 100_000
LARGEST = float(1 << 70)
MOST_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Bucketed:
    """A table of the session's catalog, bucketed and sorted by row_ in the shared folder."""

    frame: DataFrame
    name: str
    path: str

    def drop(self) -> None:
        spark = self.frame.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, buckets: int) -> Bucketed:
    spark, name = df.sparkSession, f"codes_{uuid.uuid4().hex}"
    path = fresh_path(spark, name)
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "row_").sortBy("row_").saveAsTable(name)
    return Bucketed(spark.table(name), name, path)


class Codebooks:
    """Whole-number codebooks, one for each part position."""

    def __init__(self, entries: list[list[int]], parts: int, scale: int) -> None:
        """entries: whole vectors of whole numbers, whose parts are the first entries."""
        self.parts, self.scale, self.width = parts, scale, len(entries[0]) // parts
        self.books = [[row[p * self.width : (p + 1) * self.width] for row in entries] for p in range(parts)]

    def update(self, sums: dict[int, int]) -> None:
        """Each entry becomes the floored mean of its parts; sums by slot()."""
        for p, book in enumerate(self.books):
            for e in range(len(book)):
                at = self.slot(p, e)
                if n := sums.get(at, 0):
                    book[e] = [sums.get(at + 1 + i, 0) // n for i in range(self.width)]

    def slot(self, part: int, entry: int) -> int:
        """Place of an entry's count in the running sums; its components follow."""
        return (part * len(self.books[0]) + entry) * (self.width + 1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()

    def whole(self, vectors: np.ndarray) -> np.ndarray:
        """Whole numbers of vectors (rows): int64, or Python's own where squares could leave 53 bits."""
        q = np.floor(vectors.astype(np.float64) * self.scale)
        most = max(float(np.abs(q).max(initial=0)), *(abs(x) for book in self.books for entry in book for x in entry))
        if 8 * self.width * most * most < 1 << 53:
            return q.astype(np.int64)
        return np.array([[int(x) for x in row] for row in q.tolist()], dtype=object).reshape(q.shape)

    def assign(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row's parts, and the row's squared distance."""
        codes, error = np.zeros((len(q), self.parts), np.uint8), np.zeros(len(q), q.dtype)
        for p, book in enumerate(self.books):
            x = q[:, p * self.width : (p + 1) * self.width]
            if q.dtype == object:
                far = np.array([[sum((a - b) ** 2 for a, b in zip(row, entry)) for entry in book] for row in x], dtype=object).reshape(len(x), len(book))
                codes[:, p] = [min(range(len(book)), key=row.__getitem__) for row in far]
            else:
                c, y = np.array(book, np.float64), x.astype(np.float64)  # whole numbers below 2^53, so exact
                far = ((y * y).sum(1)[:, None] - 2 * (y @ c.T) + (c * c).sum(1)).astype(np.int64)
                codes[:, p] = far.argmin(1)
            error = error + far[np.arange(len(x)), codes[:, p]]
        return codes, error

    def changes(self, q: np.ndarray, codes: np.ndarray, last: np.ndarray | None) -> dict[int, int]:
        """Plus and minus contributions, by slot, of the parts whose entry is not the last one (None: there was none)."""
        out: dict[int, int] = {}
        for p in range(self.parts):
            moved = np.arange(len(q)) if last is None else np.flatnonzero(codes[:, p] != last[:, p])
            x = q[moved, p * self.width : (p + 1) * self.width]
            for sign, of in ((1, codes), (-1, last)):
                if of is None:
                    continue
                for e in np.unique(of[moved, p]).tolist():
                    rows = x[of[moved, p] == e]
                    at = self.slot(p, e)
                    for i, v in enumerate([len(rows), *rows.sum(0).tolist()]):
                        out[at + i] = out.get(at + i, 0) + sign * v
        return {k: v for k, v in out.items() if v}


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _round(joined: DataFrame, books: Codebooks, first: bool) -> DataFrame:
    """From row_, vec_ and last_ to row_, codes and, in the first row of each batch, the batch's contributions: the slots that change, and by how much."""
    slots_of, values_of = pa.list_(pa.int32()), pa.list_(pa.decimal128(38, 0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            if not batch.num_rows:
                continue
            q = books.whole(_matrix(batch.column("vec_")))
            codes, _ = books.assign(q)
            last = None if first else np.frombuffer(b"".join(batch.column("last_").to_pylist()), np.uint8).reshape(codes.shape)
            delta = books.changes(q, codes, last)
            rest = [None] * (batch.num_rows - 1)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            slots, values = ([list(x)] if delta else [None] for x in (delta, map(Decimal, delta.values())))
            yield pa.RecordBatch.from_arrays([batch.column("row_"), packed, pa.array(slots + rest, slots_of), pa.array(values + rest, values_of)], names=["row_", "codes", "slots", "changes"])

    return joined.mapInArrow(run, "row_ long, codes binary, slots array<int>, changes array<decimal(38, 0)>")


def running_sums(assigned: DataFrame, before: DataFrame | None, size: int) -> tuple[DataFrame, bool]:
    """(the running sums with a round's contributions added, written; whether there were any).

    Each task adds its batches' contributions up to one array, so it hands on a row a slot at most.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        total = [0] * size
        for batch in batches:
            for slots, values in zip(batch.column("slots").to_pylist(), batch.column("changes").to_pylist(), strict=True):
                for k, v in zip(slots, values, strict=True):
                    total[k] += int(v)
        found = {k: Decimal(v) for k, v in enumerate(total) if v}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.decimal128(38, 0))], names=["slot", "v"])

    change = materialize(assigned.select("slots", "changes").filter("slots is not null").mapInArrow(run, "slot int, v decimal(38, 0)"), "contributions")
    moved = not change.isEmpty()
    rows = change if before is None else before.unionByName(change)
    total = materialize(rows.groupBy("slot").agg(F.sum("v").cast("decimal(38, 0)").alias("v")), "running_sums")
    discard(change)
    return total, moved


@dataclass(frozen=True)
class Compressed:
    """rows: id, label_, codes (one byte a part), error; books: the codebooks, None where no row is left."""

    rows: DataFrame
    books: Codebooks | None


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Compressed:
    """Codes and final squared distances of all valid vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a code is one byte")
    spark = vectors.sparkSession
    finite = lambda x: F.coalesce((F.abs(x) <= F.lit(LARGEST)) & ~F.isnan(x), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id_"), F.col(label_col).alias("label_"), F.col(vector_col).alias("vec_"))
    rows = rows.filter(F.col("vec_").isNotNull() & (F.size("vec_") > 0) & (F.size("vec_") % parts == 0)).filter(F.forall("vec_", finite))
    sizes = rows.groupBy(F.size("vec_").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    id_kind, label_kind = ddl(rows.schema["id_"].dataType), ddl(rows.schema["label_"].dataType)
    if sizes is None:
        return Compressed(spark.createDataFrame([], f"id_ {id_kind}, label_ {label_kind}, codes binary, error long"), None)
    size, n = int(sizes["size"]), int(sizes["count"])
    rows = rows.filter(F.size("vec_") == size)
    starts = rows.orderBy(F.col("id_").asc_nulls_last(), "vec_").limit(entries).select("vec_").collect()  # entries rows
    books = Codebooks([[int(np.floor(float(x) * scale)) for x in r[0]] for r in starts], parts, scale)

    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * size * 4 // BUCKET_BYTES)))
    base = bucketed(rows.withColumn("row_", F.monotonically_increasing_id()).repartition(buckets, "row_"), buckets)
    last = sums = None
    for _ in range(rounds):
        joined = base.frame.select("row_", "vec_")
        if last:
            joined = joined.join(last.frame.select("row_", F.col("codes").alias("last_")).hint("merge"), "row_")
        now = bucketed(_round(joined, books, last is None), buckets)
        total, moved = running_sums(now.frame, sums, parts * entries * (books.width + 1))
        for old in (last and last.drop, sums and (lambda s=sums: discard(s))):
            if old:
                old()
        last, sums = now, total
        if not moved:  # nothing changes any more, in no later round either
            break
        books.update({r["slot"]: int(r["v"]) for r in total.collect()})  # parts * entries * (width + 1) rows
    if last:
        last.drop()
        discard(sums)

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, error = books.assign(books.whole(_matrix(batch.column("vec_"))))
                error = pa.array([min(int(e), MOST_LONG) for e in error.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id_"), batch.column("label_"), pa.array([c.tobytes() for c in codes], pa.binary()), error], names=["id_", "label_", "codes", "error"])

    out = materialize(base.frame.select("id_", "label_", "vec_").mapInArrow(final, f"id_ {id_kind}, label_ {label_kind}, codes binary, error long"), "codes")
    base.drop()
    return Compressed(out, books)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error: the sum of error over equal labels, nulls together."""
    kind = rows.schema["label_"].dataType
    total = F.least(F.sum(F.col("error").cast("decimal(38, 0)")), F.lit(MOST_LONG).cast("decimal(38, 0)")).cast("long")
    sums = materialize(rows.groupBy(F.col("label_").alias("of_")).agg(total.alias("label_error")), "label_errors")
    sent = F.broadcast(sums) if sums.count() <= SENT_LABELS else sums
    return rows.join(sent, F.col("label_").eqNullSafe(F.col("of_").cast(kind))).drop("of_")


def digest(found: Compressed) -> DataFrame:
    """Per vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    sha = found.books.sha256() if found.books else None
    return with_label_errors(found.rows).select(F.col("id_").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))
