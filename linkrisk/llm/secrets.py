"""Operator 9: secret scans with structural confirmation.

Base patterns (assignments, access keys, hex runs) are reported as they match. Beyond them, base64 and hex candidates are
decoded, and a span is reported only if what is decoded has the structure of a key: DER sequences whose nested lengths fill
their parents exactly, length-prefixed key blobs, or signed-token headers that parse as JSON with an algorithm.

Each row is scanned on its own within Arrow batches: no shuffle, whole texts.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The base patterns, and the order of kinds within one start.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "signed_token", "pem_key", "der_key", "key_blob")

#: Tried once per run of token characters, and only where two more parts follow: linear in the text.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.)[A-Za-z0-9_-]*?(eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+)")
#: Header lines hold no marker, so what one marker's search reads ends before the next marker.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY-----((?:\s*+[A-Za-z][A-Za-z0-9-]*+:(?:(?!-----)[^\n])*+\n)*+)([A-Za-z0-9+/=\s]++)-----END \1PRIVATE KEY-----")
#: What the header lines of an encrypted PEM block say; its body has no structure but whole cipher blocks.
ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED\s+DEK-Info:\s*[A-Z0-9-]+,[0-9A-Fa-f]{16,}\s")
#: DER of the schemes that encrypt PKCS#8 keys: PKCS#5 and PKCS#12.
SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: base64 of what can start a key: DER's 0x30 with a long length, or a four-byte length with leading zeros.
BLOB = re.compile(r"(?<![A-Za-z0-9+/])(?:MI|MH|MG|MF|MC|MD|ME|MB|AAAA|b3BlbnNzaC)[A-Za-z0-9+/]{38,}={0,2}")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9A-Fa-f]{2}){31,}(?![0-9A-Fa-f])")
OPENSSH = b"openssh-key-v1\0"
KEY_NAMES = (b"ssh-", b"ecdsa-", b"sk-ssh-", b"sk-ecdsa-")

Span = tuple[str, int, int]


def unbase64(s: str) -> bytes:
    """The bytes of base64 in either alphabet, with or without padding; b"" if it is none."""
    s = re.sub(r"\s", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_parts(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly; None if lengths do not add up."""
    parts = []
    while start < end:
        if end - start < 2:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        parts.append((tag, at, at + size))
        start = at + size
    return parts


def is_der_key(data: bytes) -> bool:
    """One DER sequence, all of whose nested lengths fit, that holds integers, a bit string or octets as keys do."""
    outer = der_parts(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_parts(data, outer[0][1], outer[0][2])
    if not inner or len(inner) < 2:
        return False
    for tag, start, end in inner:
        if tag == 0x30 and der_parts(data, start, end) is None:
            return False
    tags = [x[0] for x in inner]
    integers = tags.count(0x02) == len(tags) >= 2
    wrapped = tags[0] == 0x30 and tags[1] == 0x03 or tags[:3] == [0x02, 0x30, 0x04]
    curve = tags[:2] == [0x02, 0x04]
    return integers or wrapped or curve or tags == [0x30, 0x04] and is_encrypted(data, *inner)


def is_encrypted(data: bytes, scheme: tuple[int, int, int], octets: tuple[int, int, int]) -> bool:
    """An encryption scheme of private keys and what it encrypted, which is not empty."""
    parts = der_parts(data, scheme[1], scheme[2])
    return bool(parts) and parts[0][0] == 0x06 and data[parts[0][1] : parts[0][2]].startswith(SCHEMES) and octets[2] > octets[1]


def is_key_blob(data: bytes) -> bool:
    """Length-prefixed fields, the first of which names a key kind, or the header of a private-key container."""
    if data.startswith(OPENSSH):
        return True
    at, fields = 0, 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data) or at + 4 > len(data):
            return False
        if not fields and not data[4 : 4 + size].startswith(KEY_NAMES):
            return False
        at, fields = at + 4 + size, fields + 1
    return fields >= 2


def is_signed_token(text: str) -> bool:
    """header.claims.signature: header and claims are JSON objects, the header names an algorithm."""
    header, claims, _ = text.split(".")
    try:
        head, body = json.loads(unbase64(header)), json.loads(unbase64(claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Where signed tokens stand; three parts that are none may be followed by ones that begin at the second of them."""
    at = 0
    while m := TOKEN.search(text, at):
        good = is_signed_token(m[1])
        if good:
            yield m.span(1)
        at = m.end() if good else text.index(".", m.start(1)) + 1


def base_spans(text: str) -> list[Span]:
    """The base matches, leftmost and non-overlapping within each kind."""
    spans = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(spans)


def confirmed_spans(text: str) -> list[Span]:
    """Spans whose decoded content has a key's structure."""
    spans = []
    if "eyJ" in text:
        spans += [("signed_token", *span) for span in signed_tokens(text)]
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            data = unbase64(m[3])
            if is_der_key(data) or is_key_blob(data) or ENCRYPTED.search(m[2]) and data and len(data) % 8 == 0:
                spans.append(("pem_key", *m.span()))
    for m in BLOB.finditer(text):
        data = unbase64(m[0])
        if is_der_key(data):
            spans.append(("der_key", *m.span()))
        elif is_key_blob(data):
            spans.append(("key_blob", *m.span()))
    spans += [("der_key", *m.span()) for m in HEX_DER.finditer(text) if is_der_key(bytes.fromhex(m[0]))]
    return spans


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[Span], mask: str) -> str:
    """``text`` with each run of overlapping spans put out by ``mask``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, clean_text string"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: str | None = None) -> DataFrame:
    """``key``, counts of the base kinds, their digest, all ``spans`` (kind:start:end), and ``clean_text`` if a mask is given.

    A null text counts as empty: no spans. Texts are scanned whole whatever their length; repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                content = value.as_py() or ""
                base = base_spans(content)
                spans = ordered(base + confirmed_spans(content))
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                clean = None if mask is None else redacted(content, spans, mask) if spans else content
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), clean))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["key", *(x.split()[0] for x in SCHEMA.split(", "))])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def redact(docs: DataFrame, mask: str = "[secret]", text: str = "text") -> DataFrame:
    """``docs`` with each secret in ``text`` put out by ``mask``; all other columns as they are, null texts null.

    Texts are scanned whole; repeated rows give repeated results; an empty table gives an empty one.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for v in batch.column(at):
                content = v.as_py()
                spans = ordered(base_spans(content) + confirmed_spans(content)) if content else []
                texts.append(redacted(content, spans, mask) if spans else content)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The query's rows: counts, digest and spans per document."""
    return scan(docs).drop("clean_text")
