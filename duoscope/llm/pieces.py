"""SentencePiece encoding and decoding by a shared-prefix forward pass over a trie of marked words.

The vocabulary file is read as it is (its path is a parameter). White space is marked, the text is cut before each run of marks, and
the distinct marked words of a slice are sorted: their sorted order walks their trie depth-first, so each word goes on from the
forward states that it shares with the word before. The forward state of a prefix is the last piece of the prefix's best
segmentation and where that piece begins; going back over these gives the segmentation.

For a unigram model the best segmentation is that of the greatest sum of scores (Viterbi). For a merge (BPE) model scores are
merge ranks and don't add up, so the state is the one piece whose joint with the state before it survives merging: a sequence of
pieces is the merged form of its text if each neighbouring pair is. Characters outside the vocabulary become bytes where
the model has byte pieces and are unknown otherwise; nothing merges across them.

Null texts give null pieces. Empty texts have none. Very long words are taken whole. Rows that repeat an id give a row each.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from duoscope.llm.common import claim, ddl, sha256, slices, two_columns

TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Marked words whose pieces a worker remembers from slice to slice, in characters.
REMEMBER_CHARS = 8_000_000
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Vocabulary:
    """Pieces, scores and kinds of a model file, and the marked words' segmentation."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.text = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or i == self.unknown else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_byte(i) or i == self.unknown or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {i: model.get_score(i) for i in plain}
        self.is_merged = all(s <= 0 and s == int(s) for s in self.scores.values())
        self.longest = max(map(len, self.ids), default=1)
        self._joints: dict[tuple[str, str], bool] = {}
        self._halves: dict[str, tuple[str, str] | None] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._chars = 0

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the last merge of a piece joins; None for one character."""
        if piece not in self._halves:
            parts = list(piece)
            while len(parts) > 2:
                at = self._best(parts)
                if at is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[piece]

    def _best(self, parts: list[str]) -> int | None:
        """Where the merge with the greatest score is, the first of equal ones."""
        best, at = -np.inf, None
        for i in range(len(parts) - 1):
            k = self.ids.get(parts[i] + parts[i + 1])
            if k is not None and self.scores[k] > best:
                best, at = self.scores[k], i
        return at

    def joint(self, a: str, b: str) -> bool:
        """Whether pieces a, b stay apart when a + b is merged from its characters."""
        key = (a, b)
        if key not in self._joints:
            parts = list(a + b)
            while (at := self._best(parts)) is not None:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._joints[key] = parts == [a, b]
        return self._joints[key]

    def reachable(self, piece: str) -> bool:
        return len(piece) == 1 or (h := self.halves(piece)) is not None and h[0] + h[1] in self.ids

    def encode_sorted(self, units: list[str]) -> dict[str, tuple[int, ...]]:
        """Segments of sorted distinct marked words. states[i]: (start of the last piece of the first i characters, that piece or None, score)."""
        out: dict[str, tuple[int, ...]] = {}
        states: list[tuple[int, str | None, float]] = [(0, None, 0.0)]
        before = ""
        step = self._merge_state if self.is_merged else self._score_state
        for unit in units:
            shared = len(os.path.commonprefix((before, unit)))
            del states[shared + 1 :]
            for end in range(shared + 1, len(unit) + 1):
                states.append(step(unit, end, states))
            before = unit
            ids: list[int] = []
            end = len(unit)
            while end:
                start, piece, _ = states[end]
                ids += [self.ids[piece]] if piece is not None else self._fallback(unit[start:end])[::-1]
                end = start
            out[unit] = tuple(ids[::-1])
        return out

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def _merge_state(self, unit: str, end: int, states: list) -> tuple[int, str | None, float]:
        for start in range(max(0, end - self.longest), end):  # the longest piece that fits is nearly always the one; it is unique
            piece = unit[start:end]
            if piece in self.ids:
                last = states[start][1]
                if (start == 0 or last is None or self.joint(last, piece)) and self.reachable(piece):
                    return start, piece, 0.0
        return end - 1, None, 0.0

    def _score_state(self, unit: str, end: int, states: list) -> tuple[int, str | None, float]:
        best: tuple[int, str | None, float] = (end - 1, None, states[end - 1][2] - 1e3)
        for start in range(max(0, end - self.longest), end):
            k = self.ids.get(unit[start:end])
            if k is not None and states[start][2] + self.scores[k] > best[2]:
                best = (start, unit[start:end], states[start][2] + self.scores[k])
        return best

    def keys(self, text: str) -> list[str]:
        """The marked words of a text, each without its first mark."""
        if not text:
            return []
        parts = text.split(" ")
        if "" in parts or MARK in text:  # runs of marks belong to the word after them
            return [u[1:] for u in _UNIT.findall(MARK + text.replace(" ", MARK))]
        return parts

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text."""
        cut = [None if t is None else self.keys(t) for t in texts]
        every = set().union(*(c for c in cut if c))
        new = every - self._known.keys()
        if new:
            self._chars += sum(map(len, new))
            if self._chars > REMEMBER_CHARS:
                self._known, self._joints, self._halves, new = {}, {}, {}, every
                self._chars = sum(map(len, new))
            self._known |= {u[1:]: ids for u, ids in self.encode_sorted(sorted(MARK + k for k in new)).items()}
        known = self._known.__getitem__
        return [None if c is None else np.fromiter(chain.from_iterable(map(known, c)), np.int32) for c in cut]

    def decode(self, ids) -> str:
        data = b"".join(map(self.text.__getitem__, ids))
        return data[data[:1] == b" " :].decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    claim("pieces", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = f"{TOKENIZERS}/{MODEL}") -> DataFrame:
    """Per row: id and pieces (array of ids). The model file must be at that path on every executor."""
    rows = two_columns(docs, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for batch in slices(batches, "text_"):
            found = own.encode_many(batch.column("text_").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id_"), pa.array(found, pa.list_(pa.int32()))], names=["id_", "pieces"])

    return rows.mapInArrow(run, f"id_ {ddl(rows.schema['id_'].dataType)}, pieces array<int>").withColumnRenamed("id_", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", model: str = f"{TOKENIZERS}/{MODEL}") -> DataFrame:
    """Per row: id and text. Null pieces give a null text."""
    rows = encoded.selectExpr(f"`{id_col}` as id_", f"cast(`{pieces_col}` as array<int>) as pieces_")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column("pieces_").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id_"), pa.array(texts, pa.string())], names=["id_", "text"])

    return rows.mapInArrow(run, f"id_ {ddl(rows.schema['id_'].dataType)}, text string").withColumnRenamed("id_", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = f"{TOKENIZERS}/{MODEL}") -> DataFrame:
    """Per row: id, n_pieces, pieces_sha256 (of the ids as little-endian 32-bit integers), text_sha256 of the decoded text, exact (it equals the text).

    Encodes and decodes each slice in one pass, so no ids are moved. Null texts give nulls.
    """
    rows = two_columns(docs, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for batch in slices(batches, "text_"):
            texts = batch.column("text_").to_pylist()
            found = own.encode_many(texts)
            back = [None if x is None else own.decode(x.tolist()) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id_"), pa.array([None if x is None else len(x) for x in found], pa.int64()),
                    pa.array([None if x is None else hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in found], pa.string()),
                    pa.array([None if x is None else sha256(x) for x in back], pa.string()), pa.array([None if t is None else t == b for t, b in zip(texts, back, strict=True)], pa.bool_()),
                ],
                names=["id_", "n_pieces", "pieces_sha256", "text_sha256", "exact"],
            )

    kind = ddl(rows.schema["id_"].dataType)
    return rows.mapInArrow(run, f"id_ {kind}, n_pieces long, pieces_sha256 string, text_sha256 string, exact boolean").withColumnRenamed("id_", id_col)
