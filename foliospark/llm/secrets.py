"""Secret scans with structural confirmation.

Base patterns give candidate spans (assignments of credentials, access key ids, long hex
strings). Structural confirmation then decodes base64 and hex runs and reports those whose
bytes parse as a key: DER with nested lengths that fill the value exactly, length-prefixed
key blobs and containers of them, PEM bodies between their markers, and signed tokens whose
header is a JSON object that names an algorithm, whose claims are an object and whose
signature decodes. Confirmed spans are added; base spans always stay.

Defined cases: null texts are empty; offsets are code points, the end exclusive; matches of
one kind do not overlap, kinds may; a document row is one row out, also when ids repeat.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import slices

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "pem", "token", "der", "blob")
BASE = KINDS[:3]

# The base patterns of the scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*(?:KEY|CERTIFICATE))-----([A-Za-z0-9+/=\s]+?)-----END \1-----")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}(?![A-Za-z0-9+/_=-])")
_HEX_ANY = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?((?:[0-9A-Fa-f]{2}){24,})(?![0-9A-Za-z])")
#: A run of text without these cannot hold a base64 or hex candidate.
_LONG = re.compile(r"[A-Za-z0-9+/_-]{40}")

# Algorithm names of length-prefixed public key blobs, and the marker of private ones.
BLOB_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
BLOB_MAGIC = b"openssh-key-v1\x00"


def decoded(text: str) -> bytes | None:
    """Standard or URL-safe base64, padding optional; None if it isn't."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, body start and body end of the DER value at ``at``; None unless it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            return None
        size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def is_der(data: bytes) -> bool:
    """One SEQUENCE that fills the data, whose nested lengths fill it in turn, with an INTEGER, BIT or OCTET STRING in it."""
    top = _der_item(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    seen, todo = set(), [top[1:]]
    while todo:
        at, end = todo.pop()
        while at < end:
            item = _der_item(data, at, end)
            if not item or item[0] & 0x1F == 0x1F:
                return False
            tag, first, at = item
            if tag == 0x02 and first == at:
                return False
            seen.add(tag)
            if tag & 0x20:
                todo.append((first, at))
    return len(data) >= 24 and bool(seen & {0x02, 0x03, 0x04})


def _fields(data: bytes, at: int, count: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from ``at`` on (``count`` of them, or all up to the end) and where they end; None if one doesn't fit."""
    found: list[bytes] = []
    while at < len(data) if count is None else len(found) < count:
        if at + 4 > len(data):
            return None
        size, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if at + size > len(data):
            return None
        found.append(data[at : at + size])
        at += size
    return found, at


def is_blob(data: bytes) -> bool:
    """Length-prefixed fields that fill the data, the first an algorithm name; or a private key container of such blobs."""
    if data.startswith(BLOB_MAGIC):
        return is_container(data)
    read = _fields(data, 0)
    return read is not None and len(read[0]) >= 2 and read[0][0] in BLOB_NAMES


def is_container(data: bytes) -> bool:
    """Cipher, key derivation and its options, a count, that many public key blobs and the private part, which fill the data."""
    read = _fields(data, len(BLOB_MAGIC), 3)
    if read is None or read[1] + 4 > len(data) or not read[0][0] or not read[0][1]:
        return False
    count = int.from_bytes(data[read[1] : read[1] + 4], "big")
    if not 1 <= count <= 16:
        return False
    keys = _fields(data, read[1] + 4, count + 1)
    return keys is not None and keys[1] == len(data) and len(keys[0][-1]) >= 8 and all(not k.startswith(BLOB_MAGIC) and is_blob(k) for k in keys[0][:-1])


def _object(part: str) -> dict | None:
    """The JSON object that a base64url part holds."""
    try:
        value = json.loads(decoded(part) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_token(header: str, claims: str, signature: str) -> bool:
    """A header that names its algorithm, claims that are an object, and a signature that decodes (none only if the algorithm is none)."""
    named = (_object(header) or {}).get("alg")
    if not isinstance(named, str) or _object(claims) is None:
        return False
    return named.lower() == "none" if not signature else bool(decoded(signature))


def confirmed(text: str) -> list[tuple[int, int, str]]:
    """Spans whose decoded bytes have the structure of a key or a signed token."""
    spans = []
    if "-----BEGIN" in text:
        spans += [(m.start(), m.end(), "pem") for m in _PEM.finditer(text) if (b := decoded("".join(m[2].split()))) and (is_der(b) or is_blob(b))]
    if "eyJ" in text:
        spans += [(m.start(), m.end(), "token") for m in _TOKEN.finditer(text) if is_token(m[1], m[2], m[3])]
    if _LONG.search(text):
        for m in _BASE64.finditer(text):
            if data := decoded(m[0]):
                spans += [(m.start(), m.end(), kind) for kind, test in (("der", is_der), ("blob", is_blob)) if test(data)]
        for m in _HEX_ANY.finditer(text):
            data = bytes.fromhex(m[1])
            spans += [(m.start(1), m.end(), kind) for kind, test in (("der", is_der), ("blob", is_blob)) if test(data)]
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind, without those that are too short."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def scan_text(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), by start and then by kind as listed."""
    return sorted({*base_spans(text), *confirmed(text)}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in slices(batches):
        found = [[{"kind": k, "start": a, "end": b} for a, b, k in scan_text(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])


def find_secrets(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id and its spans (kind, start, end)."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, SCHEMA)
