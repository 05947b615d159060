"""Secret scans: patterns first, then structural confirmation of what they can't tell.

Base kinds come from patterns alone. Further spans are reported only if their bytes parse: base64 or hex that decodes
to a DER structure whose nested lengths all fit, key files between their marker lines, and signed tokens whose first
part decodes to a JSON header that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy
from .pieces import slices

#: Kinds in the order that breaks ties of start.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem", "der")

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_access = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 24 or more is a maximal run, as one that is dropped ends where the next can't begin.
_hex = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_base64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
#: Looked for ahead, so that a token within a run of parts is found too; a part starts where letters of its kind start.
_jwt = re.compile(r"(?<![A-Za-z0-9_-])(?=(eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+))")
_marker = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,64}+)-----")
_header = re.compile(r"[A-Za-z0-9-]+:[^\n]*\n")


def decoded(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64 with or without padding; None if it isn't any."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_ends(data: bytes, at: int, end: int) -> int | None:
    """Where the element at ``at`` ends, if its length and those of all nested elements fit; else None. However deep, each byte is met once."""
    ends: list[int] = []  # of the elements that are open
    while True:
        limit = ends[-1] if ends else end
        if limit - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or limit - at < n:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80 or (n > 1 and data[at] == 0):
                return None  # not the shortest form
            at += n
        if at + size > limit:
            return None
        if tag & 0x20:
            ends.append(at + size)
        else:
            at += size
        while ends and at == ends[-1]:
            ends.pop()
        if not ends:
            return at


def is_der(data: bytes | None) -> bool:
    """A sequence over all the bytes that holds an integer or an object identifier, alone or in its first sequence."""
    if not data or len(data) < 16 or data[0] != 0x30 or der_ends(data, 0, len(data)) != len(data):
        return False
    at = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    if data[at] == 0x30:
        at += 2 + (data[at + 1] & 0x7F if data[at + 1] & 0x80 else 0)
    return at < len(data) and data[at] in (0x02, 0x06)


def is_openssh(data: bytes | None) -> bool:
    """The key format with its magic and length-prefixed cipher, kdf and options."""
    magic = b"openssh-key-v1\0"
    if not data or not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if len(data) - at < 4:
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return False
    return len(data) - at >= 4


def is_key(label: str, body: str) -> bool:
    """What stands between two marker lines: DER or the OpenSSH format; with header lines, cipher text of whole blocks that they describe."""
    body, headers, at = body.replace("\r\n", "\n").lstrip(), [], 0
    while m := _header.match(body, at):
        headers.append(m[0])
        at = m.end()
    data = decoded("".join(body[at:].split()))
    if headers:
        return bool(data) and len(data) % 8 == 0 and any(h.startswith("Proc-Type:") and "ENCRYPTED" in h for h in headers) and any(h.startswith("DEK-Info:") for h in headers)
    return is_der(data) or (label.endswith("PRIVATE KEY") and is_openssh(data))


def pem_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of key files: a marker line of a key or certificate whose next marker ends the same, with a body that parses."""
    out, begun = [], None
    for m in _marker.finditer(text):
        if m[1] == "END" and begun and begun[2] == m[2] and is_key(m[2], text[begun.end() : m.start()]):
            out.append((begun.start(), m.end()))
        begun = m if m[1] == "BEGIN" and ("PRIVATE KEY" in m[2] or "CERTIFICATE" in m[2]) else None
    return out


def is_token(text: str) -> bool:
    """Header and payload are JSON objects and the header names its algorithm."""
    head, body, _ = text.split(".")
    try:
        head, body = (json.loads(decoded(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every span in a text, sorted; places are code points."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    for m in _hex.finditer(text):
        out.append((m.start(), 2, m.end()))
        if len(m[0]) % 2 == 0 and is_der(bytes.fromhex(m[0])):
            out.append((m.start(), 5, m.end()))
    if "eyJ" in text:
        at = 0
        for m in _jwt.finditer(text):
            if m.start() >= at and is_token(m[1]):
                at = m.end(1)
                out.append((m.start(), 3, at))
    keys = pem_blocks(text) if "-----BEGIN" in text else []
    out += [(a, 4, b) for a, b in keys]
    starts = [a for a, _ in keys]
    for m in _base64.finditer(text):  # a sequence begins with the letter M
        a = m.start() + len(m[0]) - len(m[0].lstrip("+/_-"))  # a path's or a list's mark may stand before it
        if text[a] == "M" and not (starts and (k := bisect.bisect_right(starts, a)) and a < keys[k - 1][1]) and is_der(decoded(text[a : m.end()])):
            out.append((a, 5, m.end()))
    return sorted(out)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at, open_until = [], 0, -1
    for a, _, b in spans:
        if a > open_until:
            out += [text[at:a], mark]
        at = open_until = max(open_until, b)
    return "".join([*out, text[at:]])


def _scan(texts: DataFrame, kind: str, mark: str | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(KINDS)
        for batch in batches:
            for at, part in slices(batch.column(1)):
                found = [find(t) for t in part]
                ends = [0]
                for f in found:
                    ends.append(ends[-1] + len(f))
                flat = [s for f in found for s in f]
                struct = pa.StructArray.from_arrays([names.take(pa.array([k for _, k, _ in flat], pa.int32())), pa.array([a for a, _, _ in flat], pa.int32()), pa.array([b for _, _, b in flat], pa.int32())], names=["kind", "start", "end"])
                cols = [batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)]
                if mark is not None:
                    cols.append(pa.array([redacted(t, f, mark) for t, f in zip(part, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "spans", "clean"][: len(cols)])

    ship(texts.sparkSession)
    return texts.mapInArrow(tidy(run), f"id {kind}, spans array<struct<kind:string,start:int,end:int>>" + ", clean string" * (mark is not None))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and spans, an array of (kind, start, end) by start, then kind.

    Whole texts, in time that grows with their length whatever they hold; a null text has no spans, as an empty one.
    Repeated rows and null ids stay rows; further columns, whatever their names, are ignored; no rows give none. Rows
    stay where they are read: no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _scan(rows, rows.schema["id"].dataType.simpleString(), None).withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; all columns are kept. A null text stays null; ``chars_col``, if there, becomes the new length of changed texts."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = _scan(rows, rows.schema["id"].dataType.simpleString(), mark)
    changed = (F.size("spans") > 0) & F.col(f"id.`{text_col}`").isNotNull()
    cols = []
    for f in docs.schema.fields:
        old = F.col(f"id.`{f.name}`")
        if f.name == text_col:
            old = F.when(changed, F.col("clean")).otherwise(old)
        elif f.name == chars_col:
            old = F.when(changed, F.length("clean").cast(f.dataType)).otherwise(old)
        cols.append(old.alias(f.name))
    return out.select(*cols)


def span_digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256 and spans (all spans as text) from the spans of ``scan_secrets``."""
    spelled: Column = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(id_col, *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
