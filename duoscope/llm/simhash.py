"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits, each set where over half of the text's shingle hashes (XXH64, seed 42, with repeats) have it.
Texts without words have fingerprint 0. Fingerprints link at `distance` or fewer differing bits.

Candidates: cut the bits into m segments on a ring. If at most d bits differ, some segment starts a run of
consecutive segments whose cumulative differences never pass d/m a segment (the pigeonring principle), so the first
ceil(m/d) - 1 segments of that run are equal. These are the join key; the rest of the chain is tested before the full
distance. A key that more than `crowd` fingerprints share is not paired out: there each fingerprint gives the 65 values
within one bit (d = 2), and fingerprints with a value in common are linked to the least of them, which is exact and linear.

Null texts count as empty. Ties go to the smallest id; null ids sort first among those and are never a representative unless all ids
of a group are null. Rows that repeat an id give a row each. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import ddl, slices, text_bytes, two_columns
from duoscope.llm.graph import components
from duoscope.runtime import materialize

SEGMENTS = 16
DISTANCE = 2
CROWD = 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    words = text_bytes(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        h = np.array([hashed(joined, seed)], np.uint64)
    else:
        h = np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts[:n], ends[width - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_, fp), fp as a signed long."""
    rows = two_columns(docs, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_"):
            fp = np.array([fingerprint(t, width) for t in batch.column("text_").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id_"), pa.array(fp)], names=["id_", "fp"])

    return rows.mapInArrow(run, f"id_ {ddl(rows.schema['id_'].dataType)}, fp long")


def chain_holds(m: int, d: int) -> Column:
    """Whether the chain of segments of x = a xor b from segment i (columns a, b, i) keeps within its budget at each length.

    Turned so that the chain starts at bit 0, its first k segments differ in the low bits. The sums only grow, so each budget is tested at
    the longest chain that it holds for.
    """
    size = 64 // m
    turned = F.expr(f"(shiftrightunsigned(a ^ b, i * {size}) | shiftleft(a ^ b, 64 - i * {size}))")
    out = F.bit_count(turned) <= d
    for budget in range(d):
        k = max(k for k in range(1, m + 1) if k * d // m == budget)
        out = out & (F.bit_count(turned.bitwiseAND(F.lit((1 << (k * size)) - 1))) <= budget)
    return out


def links(fps: DataFrame, m: int = SEGMENTS, d: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs at distance d or less."""
    if 64 % m or not 1 <= d < m:
        raise ValueError("segments must divide 64 and be more than the distance")
    size, equal = 64 // m, -(-m // d) - 1
    mask = (1 << (size * equal)) - 1
    mask = mask - (1 << 64) if mask >> 63 else mask
    ring = lambda at: F.shiftrightunsigned("fp", at).bitwiseOR(F.shiftleft("fp", 64 - at)) if at else F.col("fp")
    keys = fps.select("fp", F.posexplode(F.array(*[ring(i * size).bitwiseAND(F.lit(mask)) for i in range(m)])).alias("i", "key"))
    counts = keys.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(keys.join(counts, ["i", "key"]), "keys")
    left, right = shared.filter(F.col("n") <= crowd), shared.filter(F.col("n") <= crowd)
    pairs = left.select("i", "key", F.col("fp").alias("a")).join(right.select("i", "key", F.col("fp").alias("b")), ["i", "key"]).filter("a < b")
    near = pairs.filter(chain_holds(m, d)).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= d).select("a", "b")
    return near.unionByName(crowded(shared.filter(F.col("n") > crowd).select("fp").distinct(), d))


def crowded(fps: DataFrame, d: int) -> DataFrame:
    """Links among fingerprints of crowded keys by shared neighbours: two words within 2r bits share a word within r bits of both.

    Here r is 1, so only distance 2 is taken; other distances are refused.
    """
    if d != 2:
        raise ValueError("crowded keys are linked exactly for distance 2 only")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    near = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    least = near.groupBy("z").agg(F.min("fp").alias("m"), F.max("fp").alias("most")).filter("m < most").select("z", "m")
    return near.join(least, "z").filter("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", m: int = SEGMENTS, d: int = DISTANCE, width: int = 3, crowd: int = CROWD) -> DataFrame:
    """Per row: id, fp (long), component_id (smallest id reachable over links, itself included)."""
    rows = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id_").alias("least")), "distinct")
    found = components(links(distinct, m, d, crowd))
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(smallest, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id_").alias(id_col), "fp", "component_id")


def hex_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay: of each component the one with the smallest id (rows repeating that id stay together).

    Documents whose id is null stay only where their whole component has null ids.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    keep = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("keep_")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["keep_"]), "left_semi")
