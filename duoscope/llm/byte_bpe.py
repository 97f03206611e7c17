"""Operator 13: byte-level BPE. Boundaries of pre-tokens come from a scan over transition functions, ids from cached pair merging.

Pre-tokens are those of the pattern of the public rank files: contractions, letters, numbers or other marks with one space before them,
and white space. No regular expression looks for them. Each code point gets a class (letter, number, space, ...) from one array; what the
pattern looks ahead to (the letters of a contraction, whether white space goes on) is folded into the class by shifted comparisons. A class is
a function on the eight states of a small automaton; there are few distinct compositions of these functions, they are enumerated once, and
composing two is one look-up. Composition is associative, so the functions' prefixes are found blockwise for all texts of a batch at once.

Results by definition:
* Null text: as the empty text, no tokens. Empty table: no rows. Rows that repeat an id stay apart. Only the id and the text are read, so extra
  columns of any name do not matter. Pairs of equal rank merge from the left.
* Very long texts are taken in windows that end at a boundary, so memory follows the window; the ids of one row, and a single pre-token longer
  than a window, are held whole.
* What the pattern does not match does not exist: every code point is in one of its alternatives.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from duoscope.llm.common import claim, ddl, slices, two_columns

#: Where the rank file lies; the same path on every executor.
RANKS = "byte_bpe_50k.tiktoken"
#: Code points that are split at a time.
WINDOW = 1 << 20
#: The cache of merged pre-tokens is emptied before the next texts once it has so many entries or ids.
CACHE_ENTRIES, CACHE_IDS = 1_000_000, 8_000_000
#: Pre-tokens of up to ROW_BYTES bytes are merged together, ROWS at a time; longer ones each by a heap. NONE: no rank.
ROW_BYTES, ROWS, NONE = 40, 8192, 1 << 30

# Classes of code points. The last three depend on what follows.
LETTER, NUMBER, OTHER, SPACE, SHORT, LONG, LAST_SPACE, LAST_OTHER_SPACE = range(8)
# States: what the code point before belongs to. DONE: a token that is complete; JOINS: a space that goes with what follows; ONE, TWO: letters left of a contraction.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINS, IN_SPACE, ONE, TWO = range(8)


def step(state: int, kind: int) -> tuple[int, bool]:
    """The automaton: the state after a code point, and whether a token begins at it."""
    if state == TWO:
        return ONE, False
    if state == ONE:
        return DONE, False
    if kind in (LETTER, NUMBER):
        to = IN_LETTERS if kind == LETTER else IN_NUMBERS
        return to, state not in (to, JOINS)
    if kind in (OTHER, SHORT, LONG):
        if state in (IN_OTHERS, JOINS):
            return IN_OTHERS, False
        return {OTHER: IN_OTHERS, SHORT: ONE, LONG: TWO}[kind], True
    if kind == SPACE:
        return IN_SPACE, state != IN_SPACE
    return (JOINS if kind == LAST_SPACE else DONE), True


def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the classes' functions: (number of each class's function, its value at DONE by number, table of compositions).

    Classes 8 to 15 are those of a text's first code point: they act as from DONE whatever came before.
    """
    own = [tuple(step(s, k)[0] for s in range(8)) for k in range(8)] + [(step(DONE, k)[0],) * 8 for k in range(8)]
    known = {f: i for i, f in enumerate(dict.fromkeys(own))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in own:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    every = list(known)
    table = np.array([[known[tuple(g[x] for x in f)] for g in every] for f in every], dtype=np.uint8 if len(every) <= 256 else np.uint16)
    return np.array([known[f] for f in own], dtype=table.dtype), np.array([f[DONE] for f in every], dtype=np.uint8), table


def prefixes(x: np.ndarray, table: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive prefix compositions of the functions numbered x: within blocks side by side, over the blocks' totals, then both together."""
    n = len(x)
    if n <= block:
        out = x.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], x[i]]
        return out
    size = table.shape[0]
    flat = table.ravel()
    blocks = n // block
    cols = np.ascontiguousarray(x[: blocks * block].reshape(blocks, block).T)
    for i in range(1, block):
        cols[i] = flat[cols[i - 1].astype(np.intp) * size + cols[i]]
    totals = prefixes(cols[-1], table, block)
    before = totals[:-1].astype(np.intp) * size
    for i in range(block):
        cols[i, 1:] = flat[before + cols[i, 1:]]
    out = np.empty(n, x.dtype)
    out[: blocks * block] = cols.T.ravel()
    for i in range(blocks * block, n):
        out[i] = table[out[i - 1], x[i]]
    return out


def code_point_kinds() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point, as the tokenizer's own tables have them; read from its library once a worker."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, named in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        reader = tiktoken.Encoding("kinds", pat_str=named, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[code_points(bytes(reader.encode_ordinary(every)).decode())] = kind
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def classes(points: np.ndarray, firsts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The class of each code point of texts laid end to end; firsts: where each (not empty) text begins."""
    n = len(points)
    kind = kinds[points]
    ends = np.zeros(n + 3, bool)  # the place after a text's last code point
    ends[firsts[1:]] = ends[n] = True
    follow = np.concatenate([points, np.zeros(3, np.uint32)])
    last = (kind == SPACE) & ~ends[1 : n + 1] & (np.append(kind, SPACE)[1:] != SPACE)
    out = kind.copy()
    out[last] = np.where(points[last] == 32, LAST_SPACE, LAST_OTHER_SPACE)
    at = np.flatnonzero(points == 39)
    one, two = follow[at + 1], follow[at + 2]
    in_one = ~ends[at + 1]
    in_two = in_one & ~ends[at + 2]
    out[at[in_one & np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    out[at[in_two & long]] = LONG
    out[firsts] += 8
    return out


class Splitter:
    """Finds where pre-tokens begin."""

    def __init__(self) -> None:
        self.kinds = code_point_kinds()
        self.number, self.at_done, self.table = monoid()
        self.begins = np.array([[step(s, k % 8)[1] for k in range(16)] for s in range(8)])
        self.begins[:, 8:] = True

    def starts(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin, of texts laid end to end (none empty)."""
        kind = classes(points, firsts, self.kinds)
        state = self.at_done[prefixes(self.number[kind], self.table)]
        return np.flatnonzero(self.begins[np.concatenate([[DONE], state[:-1]]), kind])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: always the pair of the lowest rank merges, the leftmost first. In time n log n, by a heap over a linked list."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # by where a part begins; end 0: it is no part any more
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != to:
            continue
        end[i], end[j] = to, 0
        if to < n:
            left[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (k := left[i]) >= 0 and (r := ranks.get(piece[k:to])) is not None:
            heapq.heappush(heap, (r, k, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Merger:
    """Merges many pre-tokens at a time: one row of an array each, one merge of every row a step."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        joined = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pairs = np.array([p for p, _ in joined], np.int64)
        self.whole = np.array([r for _, r in joined], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that two tokens make, NONE if they make none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.whole[at], NONE)

    def short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids laid end to end, and how many each of the pre-tokens (of similar sizes) has."""
        n, most = len(pieces), max(map(len, pieces))
        size = np.fromiter(map(len, pieces), np.int64, n)
        ids = self.of_byte[np.frombuffer(b"".join(p.ljust(most, b"\0") for p in pieces), np.uint8).reshape(n, most)]
        ids[np.arange(most) >= size[:, None]] = -1
        after, prior = (np.tile(np.arange(most, dtype=np.int32) + d, (n, 1)) for d in (1, -1))
        low = np.full((n, most), NONE, np.int32)
        low[:, :-1] = np.where(ids[:, 1:] >= 0, self.rank(ids[:, :-1], ids[:, 1:]), NONE)
        rows = np.arange(n)
        while len(rows):
            at = low[rows].argmin(1)
            found = low[rows, at]
            go = found < NONE
            rows, at, found = rows[go], at[go], found[go]
            gone = after[rows, at]
            then, before = after[rows, gone], prior[rows, at]
            ids[rows, at], ids[rows, gone] = found, -1
            low[rows, at] = low[rows, gone] = NONE
            after[rows, at] = then
            k = (then < most) & (ids[rows, np.minimum(then, most - 1)] >= 0)
            prior[rows[k], then[k]] = at[k]
            low[rows[k], at[k]] = self.rank(found[k], ids[rows[k], then[k]])
            k = before >= 0
            low[rows[k], before[k]] = self.rank(ids[rows[k], before[k]], found[k])
        return ids[ids >= 0], (ids >= 0).sum(1)

    def many(self, pieces: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """Blocks of (pre-tokens, their ids laid end to end, how many each has), not in the order given."""
        known = [p for p in pieces if p in self.ranks]
        yield known, np.array([self.ranks[p] for p in known], np.int32), np.ones(len(known), np.int64)
        rest = sorted((p for p in pieces if p not in self.ranks), key=len)
        n_short = bisect.bisect_right(rest, ROW_BYTES, key=len)
        for i in range(0, n_short, ROWS):
            some = rest[i : min(i + ROWS, n_short)]
            yield some, *self.short(some)
        for p in rest[n_short:]:
            ids = np.array(merge(p, self.ranks), np.int32)
            yield [p], ids, np.array([len(ids)])


class Merged:
    """Cache of merged pre-tokens: from bytes to a number, and by number the place of the ids in one array."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.merger = Merger(ranks)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens laid end to end, and how many each has."""
        if len(self.ends) > CACHE_ENTRIES or len(self.flat) > CACHE_IDS:
            self.clear()
        number = self.number
        if new := [p for p in set(pieces) if p not in number]:
            flat, sizes = [self.flat], []
            for some, ids, size in self.merger.many(new):
                number.update(zip(some, range(len(number), len(number) + len(some))))
                flat.append(ids)
                sizes.append(size)
            self.flat = np.concatenate(flat)
            self.ends = np.append(self.ends, np.cumsum(np.concatenate(sizes)) + (self.ends[-1] if len(self.ends) else 0))
        named = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        begin = np.where(named > 0, self.ends[named - 1], 0)
        size = self.ends[named] - begin
        return gather(self.flat, begin, size), size


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin:begin + size] for each, laid end to end."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class ByteVocabulary:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = Splitter()
        self.merged = Merged(ranks)
        most = max(ranks.values()) + 1
        self.text: list[bytes | None] = [None] * most
        for token, i in ranks.items():
            self.text[i] = token
        self.size = np.array([len(t or b"") for t in self.text], np.int64)

    def _ids(self, text: str, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids, and how many each pre-token has."""
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        cut = at[np.append(starts, len(points))].tolist()
        data = text.encode("utf-8", "replace")
        return self.merged.ids([data[a:b] for a, b in zip(cut, cut[1:])])

    def encode_one(self, text: str) -> np.ndarray:
        """A long text, window by window; each window ends where its last pre-token but three code points begins."""
        out, window = [], WINDOW
        while text:
            part = text[:window]
            points = code_points(part)
            starts = self.split.starts(points, np.zeros(1, np.int64))
            if len(part) < len(text):
                starts = starts[starts < len(points) - 3]
                if len(starts) < 2:
                    window *= 2
                    continue
                part, points, starts = part[: starts[-1]], points[: starts[-1]], starts[:-1]
            out.append(self._ids(part, points, starts)[0])
            text, window = text[len(part) :], WINDOW
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Short texts are laid end to end and split in one scan."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        some, chars = [], 0

        def flush() -> None:
            if some:
                text = "".join(texts[i] for i in some)
                firsts = np.cumsum([0] + [len(texts[i]) for i in some])
                points = code_points(text)
                starts = self.split.starts(points, firsts[:-1])
                ids, size = self._ids(text, points, starts)
                edge = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, firsts)]
                for i, a, b in zip(some, edge, edge[1:]):
                    out[i] = ids[a:b]
                some.clear()

        for i, text in enumerate(texts):
            if text and len(text) > WINDOW // 2:
                out[i] = self.encode_one(text)
            elif text:
                if chars + len(text) > WINDOW:
                    flush()
                    chars = 0
                some.append(i)
                chars += len(text)
        flush()
        return out

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token ends."""
        return np.cumsum(self.size[ids], dtype=np.int64)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))


_LOADED: dict[str, ByteVocabulary] = {}


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def vocabulary(path: str) -> ByteVocabulary:
    claim("byte_bpe", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = ByteVocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """Per row: id, ids (array of token ids) and ends (the byte of the text at which each token ends). A null text has none."""
    rows, path = two_columns(docs, id_col, text_col), ranks or ranks_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in slices(batches, "text_"):
            ids = own.encode_many(batch.column("text_").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id_"), pa.array(ids, pa.list_(pa.int32())), pa.array([own.ends(x) for x in ids], pa.list_(pa.int64()))], names=["id_", "ids", "ends"])

    return rows.mapInArrow(run, f"id_ {ddl(rows.schema['id_'].dataType)}, ids array<int>, ends array<long>").withColumnRenamed("id_", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", first: int = 0, last: int | None = None, ranks: str | None = None) -> DataFrame:
    """Per row of encode(): id and data, the bytes first (0-based) to last (exclusive; none: the end) of the text.

    ends tell which tokens hold those bytes, and only these are decoded.
    """
    rows, path = encoded.selectExpr(f"`{id_col}` as id_", "ids", "ends"), ranks or ranks_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                ids, ends = (batch.column(c)[i].values.to_numpy() for c in ("ids", "ends"))
                to = int(ends[-1]) if len(ends) else 0
                to = to if last is None else min(last, to)
                if first >= to:
                    out.append(b"")
                    continue
                a, b = int(np.searchsorted(ends, first, side="right")), int(np.searchsorted(ends, to))
                skip = first - (int(ends[a - 1]) if a else 0)
                out.append(own.decode(ids[a : b + 1].tolist())[skip : skip + to - first])
            yield pa.RecordBatch.from_arrays([batch.column("id_"), pa.array(out, pa.binary())], names=["id_", "data"])

    return rows.mapInArrow(run, f"id_ {ddl(rows.schema['id_'].dataType)}, data binary").withColumnRenamed("id_", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256 (of the decoded bytes).

    Encodes and decodes each slice in one pass, so no ids are moved.
    """
    rows, path = two_columns(docs, id_col, text_col), ranks or ranks_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in slices(batches, "text_"):
            found = [x.tolist() for x in own.encode_many(batch.column("text_").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id_"), pa.array(map(len, found), pa.int64()), pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in found], pa.string()),
                ],
                names=["id_", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"id_ {ddl(rows.schema['id_'].dataType)}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id_", id_col)
