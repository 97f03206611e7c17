r"""Secret scans with structural confirmation.

Base spans are found by three patterns: `assign` (a named value of 8 characters or more), `access` (AKIA keys of 16
or more) and `hex` (runs of 32 or more). The method adds spans that are reported only once their bytes parse:

* `jwt`: three base64url parts whose first is a JSON object with an "alg" and whose second is a JSON object;
* `pem`: a private key block whose base64 body is one DER sequence or an OpenSSH key blob, or, after header lines that say so, encrypted blocks;
* `der`: bare base64, in one run or wrapped over lines, that decodes to a private key's DER (nested lengths must add up) or an OpenSSH key blob;
* `hexkey`: a hex run that decodes to such bytes.

Spans are in code points, end exclusive. Spans of one kind don't overlap; those of different kinds may, and are all reported, by start and then by
kind as listed. Null and empty texts and empty tables have none. Very long texts are searched whole, in time in proportion to their length; JSON
nested deeper than the parser goes confirms nothing. Rows that repeat an id give a row each. Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import ddl, slices, text_bytes, two_columns

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "hexkey")
BASE = KINDS[:3]

#: On bytes whose A-Z are lower-cased: the first letters then prune the search.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_ANY_HEX = re.compile(rb"[0-9A-Fa-f]{32,}")
_DOTTED = re.compile(rb"[A-Za-z0-9_.-]{8,}+")
#: Possessive, so that nothing is tried twice.
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----\s*+((?:[A-Za-z-]++:[^\r\n]*+\r?\n)*+)([A-Za-z0-9+/=\s]++)-----END \1-----")
_BASE64 = re.compile(rb"[A-Za-z0-9+/]{40,}={0,2}")
#: Full lines, then a last one.
_WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/=])(?:[A-Za-z0-9+/]{40,76}+\r?\n[ \t]*+)++(?:[A-Za-z0-9+/]{1,76}+={0,2})?")
#: Object identifiers of password-based encryption: PKCS #5, PKCS #12.
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_CIPHER_BLOCK = 8
_ASSIGN_LEAST, _ACCESS_LEAST, _TOKEN_LEAST = 8, 16, 32


def unbase64(data: bytes, url: bool = False) -> bytes | None:
    data = data.rstrip(b"=")
    try:
        return base64.b64decode(data + b"=" * (-len(data) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_parts(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) elements that fill data exactly, or None where a length doesn't add up."""
    parts, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + n > len(data):
            return None
        parts.append((tag, data[at : at + n]))
        at += n
    return parts


def is_private_der(data: bytes) -> bool:
    """PKCS#1, PKCS#8 or SEC1: one sequence that starts with a small version number and goes on as such a key does, or encrypted PKCS#8."""
    outer = der_parts(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = der_parts(outer[0][1])
    if inner and [t for t, _ in inner] == [0x30, 0x04]:
        way = der_parts(inner[0][1])
        return bool(way) and way[0][0] == 0x06 and way[0][1].startswith(_PASSWORD_BASED)
    if not inner or inner[0][0] != 0x02 or len(inner[0][1]) != 1 or inner[0][1][0] > 1:
        return False
    tags = [t for t, _ in inner]
    if len(inner) >= 9 and tags[:9] == [0x02] * 9:
        return True
    if len(inner) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
        kind = der_parts(inner[1][1])
        return bool(kind) and kind[0][0] == 0x06
    return len(inner) >= 2 and tags[1] == 0x04 and all(t in (0xA0, 0xA1) for t in tags[2:])


def is_openssh(data: bytes) -> bool:
    """The magic, then cipher, key derivation and its options as counted strings, a number of keys and that many public keys."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def counted() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(counted() is None for _ in range(3)) or at + 4 > len(data):
        return False
    n = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= n <= 64 and all(counted() for _ in range(n)) and bool(counted())


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_private_der(data) or is_openssh(data))


def is_signed_token(data: bytes) -> bool:
    head, body, signature = data.split(b".")
    try:
        header = json.loads(unbase64(head, url=True) or b"")
        if not (isinstance(header, dict) and isinstance(header.get("alg"), str)):
            return False
        return isinstance(json.loads(unbase64(body, url=True) or b""), dict) and bool(unbase64(signature, url=True))
    except (ValueError, RecursionError):
        return False


def signed_tokens(raw: bytes) -> Iterator[tuple[int, int]]:
    """Spans of confirmed tokens: in each run of token characters, a part from its first eyJ on with the two parts after it. Each part is tried three times at most."""
    for run in _DOTTED.finditer(raw):
        if b"eyJ" not in run[0]:
            continue
        parts = run[0].split(b".")
        ends = list(accumulate(len(p) + 1 for p in parts))
        k = 0
        while k + 2 < len(parts):
            at = parts[k].find(b"eyJ")
            if at >= 0 and parts[k + 1].startswith(b"eyJ") and is_signed_token(b".".join((parts[k][at:], parts[k + 1], parts[k + 2]))):
                yield run.start() + ends[k] - 1 - len(parts[k]) + at, run.start() + ends[k + 2] - 1
                k += 3
            else:
                k += 1


def is_pem_body(headers: bytes, body: bytes) -> bool:
    data = unbase64(b"".join(body.split()))
    if b"ENCRYPTED" in headers and b"DEK-Info:" in headers:
        return bool(data) and len(data) % _CIPHER_BLOCK == 0
    return is_key(data)


def key_bytes(data: bytes) -> int:
    """How many bytes a DER sequence that starts data says that it has; 0 if none starts there."""
    if data[:1] != b"\x30" or len(data) < 6:
        return 0
    width = data[1] & 0x7F
    if data[1] < 0x80:
        return 2 + width
    return 2 + width + int.from_bytes(data[2 : 2 + width], "big") if 1 <= width <= 4 else 0


def wrapped_keys(raw: bytes) -> Iterator[tuple[int, int]]:
    """Spans of keys over several lines of base64. A sequence's own length says where its last line ends; an OpenSSH blob goes on to the end."""
    for block in _WRAPPED.finditer(raw):
        body = b"".join(block[0].split())
        data = unbase64(body[: len(body.rstrip(b"=")) // 4 * 4])
        chars = -(-key_bytes(data or b"") // 3) * 4
        for n in (chars, len(body)):
            if 0 < n <= len(body) + 3 and is_key(unbase64(body[:n])):
                left = n = min(n, len(body))
                end = block.start()
                for line in block[0].splitlines(keepends=True):
                    own = len(line.strip())
                    if own >= left:
                        end += line.index(line.strip()) + left
                        break
                    left -= own
                    end += len(line)
                yield block.start(), end
                break


def find(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of UTF-8, by start and then kind as listed."""
    out: list[tuple[int, int, str]] = []
    low = raw.lower()
    if any(x in low for x in _NAMES):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(low) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(raw) if m.end() - m.start() >= _ACCESS_LEAST]
    if b"-----BEGIN " in raw:
        out += [(*m.span(), "pem") for m in _PEM.finditer(raw) if is_pem_body(m[2], m[3])]
    if b"eyJ" in raw:
        out += [(*at, "jwt") for at in signed_tokens(raw)]
    gaps = np.flatnonzero(np.frombuffer(b" %b " % raw, np.uint8) <= 32)  # white space and control characters
    bare: list[tuple[int, int]] = []
    for k in np.flatnonzero(np.diff(gaps) > _TOKEN_LEAST).tolist():  # no run of 32 characters lies outside a long token
        a, b = int(gaps[k]), int(gaps[k + 1]) - 1
        out += [(*m.span(), "hex") for m in _HEX.finditer(raw, a, b)]
        out += [(*m.span(), "hexkey") for m in _ANY_HEX.finditer(raw, a, b) if not len(m[0]) % 2 and is_key(bytes.fromhex(m[0].decode()))]
        bare += [m.span() for m in _BASE64.finditer(raw, a, b)]
    if bare:
        whole = list(wrapped_keys(raw)) if b"\n" in raw else []
        inside = lambda a: (k := bisect_right(whole, (a, len(raw)))) > 0 and a < whole[k - 1][1]
        out += [(*at, "der") for at in whole] + [(a, b, "der") for a, b in bare if not inside(a) and is_key(unbase64(raw[a:b]))]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """find() in code points."""
    raw = text_bytes(text)
    found = find(raw)
    if found and len(raw) != len(text):
        starts = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points begun up to each byte
        at = lambda i: int(starts[i - 1]) if i else 0
        return [(at(a), at(b), k) for a, b, k in found]
    return found


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in slices(batches, "text_"):
        found = [spans(t) for t in batch.column("text_").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id_"), pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in x] for x in found], kind)], names=["id_", "found"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and found, the array of (kind, start, end) by start and then kind. No shuffle."""
    rows = two_columns(docs, id_col, text_col)
    kind = ddl(rows.schema["id_"].dataType)
    return rows.mapInArrow(_rows, f"id_ {kind}, found array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id_", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents' ids and texts with each found span replaced by the mark; overlapping spans count as one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_"):
            out = []
            for text in batch.column("text_").to_pylist():
                parts, at, reach = [], 0, 0
                for a, b, _ in spans(text):
                    if a >= reach:
                        parts += [text[at:a], mark]
                    reach = at = max(reach, b)
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("id_"), pa.array(out, pa.string())], names=["id_", "text_"])

    rows = two_columns(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id_ {ddl(rows.schema['id_'].dataType)}, text_ string").withColumnsRenamed({"id_": id_col, "text_": text_col})


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and digests of base spans, and all spans as text."""
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(F.filter("found", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), text("found").alias("spans"),
    )


