"""A deterministic sharded WARC writer and its reader.

Records are sorted by page id within shards, and shards are ranges of ids that hold about shard_bytes each; the ranges come from
exact counts, so equal tables give equal files. An id (or null) that holds more is dealt to shards of its own by a hash of url and payload; only
rows alike in all three stay in one shard, which a task streams. Files roll once they hold roll_bytes compressed. Each record is a gzip member
whose headers (lengths, block and payload digests, record ids) are made anew. Of pages with equal payloads of least_bytes or more
the one with the greatest id is a response and the others revisit it.

A task writes under a temporary name of its own and reports its files; the reports of committed tasks form a manifest, by which files
are renamed. A task that is run again writes other names, and renaming twice does nothing. Writing to a folder that holds an archive replaces it:
files of equal names are replaced, others of the old manifest go. Readers hold each file against its digest in the manifest.

Null html is an empty payload; null urls are empty; null ids sort first, and an id of null revisits like another. Rows that repeat an id
and payload are alike: if the id is the greatest of its payload they are all responses. Other columns are ignored. An empty table
gives no files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm.common import slices
from duoscope.operators.windows import running_total
from duoscope.runtime import discard, fresh_path, materialize

SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
LEAST_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
_MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"
_CRLF = b"\r\n"


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else f"file://{uri}")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    value = record.rpartition(":")[2].rstrip(">")
    return None if value == "null" else int(value)


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n".encode()
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(head + block + _CRLF + _CRLF) + pack.flush()


def page_record(page_id: int | None, url: str, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """A response, or a revisit where payload is None; size and sha1 (hex) are those of the full payload."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    headers = [
        ("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", " ".join(url.split())),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if payload is None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    return member(headers, block)


def info_record(name: str) -> bytes:
    block = b"software: duoscope\r\nformat: WARC File Format 1.1\r\n"
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def shard_plan(sizes: DataFrame, shard_bytes: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many shards null ids take, and (start, spread) of ranges of ids in order: a range holds about shard_bytes by exact sums of size over (id_, size)
    and is one shard, but an id that alone holds more has a range of its own that is dealt to `spread` shards.

    Sums are taken over cells of 2^k ids; cells with too much are taken apart again, all in one pass a level. Cells are packed by running totals over
    range-sorted cells; the driver sees two numbers a range, as arrays.
    """
    low, high, total, unknown = sizes.agg(F.min("id_"), F.max("id_"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("id_").isNull(), F.col("size"))), F.lit(0))).first()
    starts, spread = [], []
    if low is not None:
        bits = max(10, (4 * (int(total) // shard_bytes + 1)).bit_length())
        shift = max(0, (int(high) - int(low)).bit_length() - bits)
        rows, levels, done = sizes.filter(F.col("id_").isNotNull()), [], None
        while True:
            cells = materialize(rows.groupBy(F.shiftright("id_", shift).alias("cell")).agg(F.sum("size").alias("size")), "cells")
            levels.append(cells)
            full = (F.col("size") > shard_bytes) & F.lit(shift > 0)
            kept = cells.filter(~full).select(F.shiftleft("cell", shift).alias("start"), "size")
            done = kept if done is None else done.unionByName(kept)
            over = cells.filter(full).select("cell")
            if over.isEmpty():
                break
            rows = rows.join(over.withColumnRenamed("cell", "cell_"), F.shiftright("id_", shift) == F.col("cell_"), "left_semi")
            shift = max(0, shift - bits)
        held = running_total(done, "size", [F.asc("start")], "upto").withColumns({"k": F.expr(f"(upto - size) div {shard_bytes}"), "alone": F.col("size") > shard_bytes})
        found = held.groupBy("k", "alone").agg(F.min("start").alias("start"), F.max(F.when(F.col("alone"), F.ceil(F.col("size") / shard_bytes)).otherwise(1)).alias("spread")).orderBy("start").toArrow()
        starts, spread = found.column("start").to_numpy(), found.column("spread").to_numpy()
        for cells in levels:
            discard(cells)
    return -(-int(unknown) // shard_bytes), np.array(starts, np.int64), np.array(spread, np.int64)


class _Shard:
    """The files of one shard, under temporary names."""

    def __init__(self, fs: pyarrow.fs.FileSystem, folder: str, shard: int, roll_bytes: int) -> None:
        self.fs, self.folder, self.shard, self.roll, self.done, self.out = fs, folder, shard, roll_bytes, [], None

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            self.path = f"{self.folder}/{self.name}"
            self.out, self.records, self.bytes, self.sha = self.fs.open_output_stream(self.path, compression=None), 0, 0, hashlib.sha256()
            self._put(info_record(self.name))
        self._put(record)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)
        self.sha.update(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.path, self.records, self.bytes, self.sha.hexdigest()))
            self.out = None


def _write(batches: Iterable[pa.RecordBatch], out_dir: str, roll_bytes: int) -> Iterator[pa.RecordBatch]:
    fs, root = file_system(out_dir)
    folder = f"{root}/_temporary/{uuid.uuid4().hex}"
    shard: _Shard | None = None

    def report(files: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*files, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "temporary", "records", "bytes", "sha256"])

    for batch in slices(batches, "html_"):
        for row in batch.to_pylist():
            if shard is None or shard.shard != row["shard"]:
                if shard is None:
                    fs.create_dir(folder, recursive=True)
                else:
                    shard.close()
                    yield report(shard.done)
                shard = _Shard(fs, folder, row["shard"], roll_bytes)
            payload = None if row["is_revisit"] else row["html_"].encode("utf-8", "replace")
            shard.add(page_record(row["id_"], row["url_"], payload, row["size"], row["sha"], row["m"]))
    if shard is not None:
        shard.close()
        yield report(shard.done)


def _publish(batches: Iterable[pa.RecordBatch], out_dir: str) -> Iterator[pa.RecordBatch]:
    """Renames temporary files. Where one is gone, an earlier attempt has renamed it."""
    fs, root = file_system(out_dir)
    there = lambda path: fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound
    for batch in batches:
        for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
            target = f"{root}/{name}"
            if there(temporary):
                if there(target):
                    fs.delete_file(target)
                fs.move(temporary, target)
            elif not there(target):
                raise FileNotFoundError(target)
        yield batch


def _remove(batches: Iterable[pa.RecordBatch], out_dir: str) -> Iterator[pa.RecordBatch]:
    fs, root = file_system(out_dir)
    for batch in batches:
        for name in batch.column("name").to_pylist():
            if fs.get_file_info(f"{root}/{name}").type != pyarrow.fs.FileType.NotFound:
                fs.delete_file(f"{root}/{name}")
        yield batch


def write_warc(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the pages to out_dir, a folder that all executors reach, and returns the manifest of its files."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("id_"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url_"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html_")
    ).withColumns({"sha": F.sha1(F.col("html_").cast("binary")), "size": F.octet_length("html_").cast("long")})
    groups = rows.filter(F.col("size") >= least_bytes).groupBy("sha").agg(F.max("id_").alias("m"), F.count(F.lit(1)).alias("n"), F.count("id_").alias("known")).filter("n > 1")
    groups = materialize(groups.select("sha", "m", (F.col("known") > 0).alias("has_id")), "payloads")  # its size on disk tells Spark whether to broadcast it
    unknown, starts, spread = shard_plan(rows.select("id_", (F.col("size") + 512).alias("size")), shard_bytes)
    shards = max(1, unknown + int(spread.sum()))
    shared = spark.sparkContext.broadcast((starts, spread, unknown + np.cumsum(spread) - spread))  # three numbers for each range

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, wide, first = shared.value
        for batch in batches:
            seed = batch.column("seed").to_numpy(zero_copy_only=False)
            shard = seed % max(1, unknown)  # of null ids
            known = batch.column("id_").is_valid().to_numpy(zero_copy_only=False)
            at = np.searchsorted(start, batch.column("id_").drop_null().to_numpy(), side="right") - 1
            shard[known] = first[at] + seed[known] % wide[at]
            yield batch.select([k for k, name in enumerate(batch.schema.names) if name != "seed"]).append_column("shard", pa.array(shard))

    marked = rows.join(groups, "sha", "left").select(
        "id_", "url_", F.when(F.col("has_id") & ~F.col("id_").eqNullSafe(F.col("m")), F.lit("")).otherwise(F.col("html_")).alias("html_"), "sha", "size", "m",
        F.coalesce(F.col("has_id") & ~F.col("id_").eqNullSafe(F.col("m")), F.lit(False)).alias("is_revisit"),
        F.xxhash64("sha", "url_").bitwiseAND(F.lit((1 << 63) - 1)).alias("seed"),
    )
    kinds = "id_ long, url_ string, html_ string, sha string, size long, m long, is_revisit boolean"
    dealt = marked.mapInArrow(place, f"{kinds}, shard long").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "id_", "sha", "url_")
    written = materialize(dealt.mapInArrow(lambda b: _write(b, out_dir, roll_bytes), _MANIFEST), "written")
    fs, root = file_system(out_dir)
    there = lambda path: fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound
    old = materialize(spark.read.parquet(f"{out_dir}/_manifest").select("name"), "old") if there(f"{root}/_manifest") else None
    new = written.repartition(max(1, min(64, shards)), "name").mapInArrow(lambda b: _publish(b, out_dir), _MANIFEST).drop("temporary")
    new.write.mode("overwrite").parquet(f"{out_dir}/_manifest")
    manifest = spark.read.parquet(f"{out_dir}/_manifest")
    if old is not None:
        old.join(manifest, "name", "left_anti").mapInArrow(lambda b: _remove(b, out_dir), "name string").count()
        discard(old)
    if there(f"{root}/_temporary"):
        fs.delete_dir(f"{root}/_temporary")
    for done in (groups, written):
        discard(done)
    return manifest


class _Hashed:
    """A stream that is hashed as it is read."""

    def __init__(self, stream) -> None:
        self.stream, self.sha = stream, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.sha.update(data)
        return data


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    data = b""
    while data or (data := stream.read(1 << 20)):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data and not (data := stream.read(1 << 20)):
                raise ValueError("the last gzip member is cut short")
            out.append(unpack.decompress(data))
            data = unpack.unused_data
        yield b"".join(out)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(_CRLF + _CRLF)
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != _CRLF + _CRLF:
        raise ValueError(f"record {headers.get('WARC-Record-ID')}: wrong length")
    return headers, rest[:n]


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def _read(batches: Iterable[pa.RecordBatch], out_dir: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    fs, root = file_system(out_dir)
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.string()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    for names in batches:
        for name, sha in zip(names.column("name").to_pylist(), names.column("sha256").to_pylist(), strict=True):
            rows: list[tuple] = []
            held = 0
            with fs.open_input_stream(f"{root}/{name}", compression=None) as opened:
                stream = _Hashed(opened)
                for record in members(stream):
                    headers, block = parse(record)
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(_CRLF + _CRLF)
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    full = headers["WARC-Type"] == "response"
                    if base32_sha1(block) != headers["WARC-Block-Digest"].removeprefix("sha1:") or full and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"record {headers['WARC-Record-ID']}: wrong digest")
                    rows.append((page_of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, headers["WARC-Type"], None if full else page_of(headers["WARC-Refers-To"]), payload.decode() if full and payloads else None))
                    held += len(payload) if payloads else 200
                    if held > 1 << 21:
                        yield batch_of(rows)
                        rows, held = [], 0
            if stream.sha.hexdigest() != sha:
                raise ValueError(f"{name}: not the file of the manifest")
            if rows:
                yield batch_of(rows)


def read_warc(spark: SparkSession, out_dir: str, payloads: bool = True) -> DataFrame:
    """A row for each page record of the manifest's files, with lengths and digests checked."""
    files = spark.read.parquet(f"{out_dir}/_manifest").select("name", "sha256")
    return files.repartition(max(1, min(10_000, files.count()))).mapInArrow(lambda b: _read(b, out_dir, payloads), _READ)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to a new folder beside the checkpoints and reads them back, without payloads."""
    out_dir = fresh_path(pages.sparkSession, "warc")
    write_warc(pages, out_dir, **options)
    return read_warc(pages.sparkSession, out_dir, payloads=False)
