"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. A window is `window`
consecutive words of an item, or a whole item with fewer. The automaton reads words as two letters each, the two halves of the word's number among
the items' words: that keeps it to two nodes a word, with few branches at each. A document is scanned once; matches give word ranges, and these
give offsets in the original text.

Null and empty texts have no words; null item ids are named ''. Items of the same text all count. Rows that repeat an id give
a row each. Very long texts are scanned whole, and a very long item is cut into windows like any other (it makes a block larger than block_chars by
what it has over). Input columns other than the named ones, whatever their names, are ignored. Empty tables give no rows or no hits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import claim, ddl, sha256, slices, text_bytes, two_columns
from duoscope.runtime import discard, materialize

WINDOW = 13
#: Characters of items in one automaton. It bounds what is broadcast and what a worker holds; more items are scanned block by block.
BLOCK_CHARS = 1_500_000

_TO_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_ORIGINAL_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    return text_bytes(text).lower().translate(_TO_SPACE).split()


def windows(item_words: list[str], window: int) -> list[list[str]]:
    if len(item_words) <= window:
        return [item_words] if item_words else []
    return [item_words[i : i + window] for i in range(len(item_words) - window + 1)]


class Windows(NamedTuple):
    """The automaton of all windows, and the letters of the items' words."""

    letters: dict[bytes, str]
    found: ahocorasick.Automaton


_BUILT: dict[str, Windows] = {}
_OTHER = "\x01\x01"  # any other word


def letters_of(number: int) -> str:
    """Two letters of different ranges, so that nothing matches across words. The first is below the surrogates for up to 13 million words."""
    return chr(0x200 + (number >> 8)) + chr(0x100 + (number & 0xFF))


def automaton(items: Iterable[tuple[str, str]], window: int) -> Windows:
    """Each window carries its number of words and the ids of its items."""
    letters: dict[bytes, str] = {}
    found: dict[str, tuple[int, set[str]]] = {}
    for item_id, text in items:
        own = [letters.get(w) or letters.setdefault(w, letters_of(len(letters))) for w in words(text)]
        for w in windows(own, window):
            found.setdefault("".join(w), (len(w), set()))[1].add(item_id)
    out = ahocorasick.Automaton()
    for key in list(found):
        n, ids = found.pop(key)
        out.add_word(key, (n, tuple(sorted(ids))))
    if len(out):
        out.make_automaton()
    return Windows(letters, out)


def _merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words, end exclusive, that the given ranges cover."""
    order = np.argsort(first, kind="stable")
    out: list[tuple[int, int]] = []
    for a, b in zip(first[order].tolist(), last[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan(text: str | None, own: Windows) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, covered word ranges, ids of the items found."""
    found = words(text)
    if not found or not own.letters:
        return len(found), [], set()
    letters = own.letters.get
    matches = list(own.found.iter("".join([letters(w, _OTHER) for w in found])))
    if not matches:
        return len(found), [], set()
    last = np.array([(m[0] + 1) // 2 for m in matches])
    first = last - np.array([m[1][0] for m in matches])
    return len(found), _merged(first, last), {i for m in matches for i in m[1][1]}


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, hit_share: tuple[int, int] = (1, 20), block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents, with all their columns, that are not contaminated. No shuffle; several blocks are scanned one after another."""
    columns = [F.col(c) for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    found = decontaminate(rows, benchmark, "id_", "text_", item_id, item_text, window, hit_share, block_chars)
    return found.filter(~F.col("contaminated")).select("id_.*")


_STATE = "n_words long, ranges array<int>, items array<string>"


def _pass(batches: Iterable[pa.RecordBatch], items, window: int, key: str) -> Iterator[pa.RecordBatch]:
    claim("decontamination", _BUILT.clear)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton(items.value, window)
    found = _BUILT[key]
    for batch in slices(batches, "text_"):
        n, ranges, names = [], [], []
        before = (batch.column("ranges").to_pylist(), batch.column("items").to_pylist()) if "ranges" in batch.schema.names else None
        for i, text in enumerate(batch.column("text_").to_pylist()):
            count, own, ids = scan(text, found)
            if before and before[0][i]:
                flat = np.array(before[0][i] + [x for r in own for x in r]).reshape(-1, 2)
                own, ids = _merged(flat[:, 0], flat[:, 1]), ids | set(before[1][i])
            n.append(count)
            ranges.append([x for r in own for x in r])
            names.append(sorted(ids))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id_"), batch.column("text_"), pa.array(n, pa.int64()), pa.array(ranges, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
            names=["id_", "text_", "n_words", "ranges", "items"],
        )


def _spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in slices(batches, "text_"):
        hit, spans, digests = [], [], []
        for text, ranges, items in zip(batch.column("text_").to_pylist(), batch.column("ranges").to_pylist(), batch.column("items").to_pylist(), strict=True):
            own = [m.span() for m in _ORIGINAL_WORD.finditer(text)] if ranges else []
            pairs = list(zip(ranges[::2], ranges[1::2], strict=True))
            hit.append(sum(b - a for a, b in pairs))
            spans.append([{"start": own[a][0], "end": own[b - 1][1]} for a, b in pairs])
            digests.append(sha256(",".join(items)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id_"), batch.column("n_words"), pa.array(hit, pa.int64()), batch.column("items"), pa.array(spans, kind), pa.array(digests)],
            names=["id_", "n_words", "n_hit", "items", "spans", "items_sha256"],
        )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, hit_share: tuple[int, int] = (1, 20), block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted ids), spans (original code points), items_sha256, contaminated.

    contaminated: n_hit > 0 and n_hit / n_words >= hit_share. Documents are scanned where they lie, with no shuffle.
    The benchmark's size is summed first; beyond block_chars it is dealt by hash into blocks that one automaton each can
    hold, and the documents' rows carry what was found from block to block.
    """
    spark = docs.sparkSession
    tests = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("words")).filter("words is not null")
    chars = tests.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * int(chars) // block_chars) if chars > block_chars else 1)
    out = two_columns(docs, id_col, text_col)
    kind = ddl(out.schema["id_"].dataType)
    for k in range(blocks):
        block = tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k)
        items = spark.sparkContext.broadcast([tuple(r) for r in block.collect()])
        out = _run(out, items, window, kind)
        if k < blocks - 1:  # written, so that no two automatons are held at a time
            out = materialize(out, "block")
            if k:
                discard(last)
            last = out
    done = out.mapInArrow(_spans, f"id_ {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, items_sha256 string")
    return done.select(
        F.col("id_").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", "items_sha256",
        ((F.col("n_hit") > 0) & (F.lit(hit_share[1]) * F.col("n_hit") >= F.lit(hit_share[0]) * F.col("n_words"))).alias("contaminated"),
    )


def _run(df: DataFrame, items, window: int, kind: str) -> DataFrame:
    key = uuid.uuid4().hex
    return df.mapInArrow(lambda batches: _pass(batches, items, window, key), f"id_ {kind}, text_ string, {_STATE}")
