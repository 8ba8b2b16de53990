"""Secret scan: patterns, confirmed and extended by the structure of what they encode.

Base kinds are patterns over the text.  The structural kinds decode base64 or hex candidates and report a span only if
the bytes have the structure of a secret:

* ``token``: a signed token, three base64url parts whose first is a JSON header with ``alg`` and whose second is JSON;
* ``der``: a private key in DER (also between PEM lines): the fields of PKCS#1, DSA, SEC1 or PKCS#8, encrypted or not,
  with tags and lengths that fill their parents exactly;
* ``ssh``: an OpenSSH private key container whose length-prefixed fields fill the data exactly;
* ``encoded``: printable text that itself holds a base secret;
* ``public``: a public key in DER (algorithm and bit string, or modulus and exponent) or in the SSH wire format.

Certificates, signatures and other DER are no kind.  Base64 is looked for in runs of its characters from 22 on; where a
run as a whole is nothing, its parts in the standard alphabet, in the URL alphabet and without any mark are tried, and so
are the joined lines of one block.  Rows: repeated rows are separate, further columns are not carried.

Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns, least lengths and order of the base kinds (fixed values of the contract).
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "der", "ssh", "encoded", "public")

#: A header starts at the edge of a run, so that a run is read once.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]{9,})\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
BASE64, HEX_DATA = re.compile(r"[A-Za-z0-9+/_-]{22,}={0,2}"), re.compile(r"[0-9A-Fa-f]{32,}")
#: Lines of one block; the last may be shorter.
LINES = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}\r?\n)+[A-Za-z0-9+/]+={0,2}")
#: Parts of a run: of the standard alphabet, of the URL alphabet, of both.
PARTS = [re.compile(p + "{22,}={0,2}") for p in ("[A-Za-z0-9+/]", "[A-Za-z0-9_-]", "[A-Za-z0-9]")]
CONTAINER, INTEGER, BITS, OCTETS, OBJECT_ID = 0x30, 0x02, 0x03, 0x04, 0x06


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, leftmost and non-overlapping per kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def from_base64(text: str) -> bytes | None:
    raw = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(raw) % 4 == 1:
        return None
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of consecutive DER fields that fill ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            size = int.from_bytes(data[at : at + wide], "big")
            at += wide
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def sequence(data: bytes) -> list[tuple[int, bytes]] | None:
    """The fields of the one DER sequence that ``data`` is."""
    outer = der_fields(data)
    return der_fields(outer[0][1]) if outer and len(outer) == 1 and outer[0][0] == CONTAINER else None


def is_algorithm(field: tuple[int, bytes]) -> bool:
    """A sequence of an object id and, perhaps, parameters."""
    inner = der_fields(field[1]) if field[0] == CONTAINER else None
    return bool(inner) and inner[0][0] == OBJECT_ID and len(inner[0][1]) > 0 and len(inner) <= 2


def der_kind(data: bytes) -> str | None:
    """``der`` for a private key, ``public`` for a public key, else None."""
    fields = sequence(data) if len(data) >= 16 and data[0] == CONTAINER else None
    if not fields or len(fields) < 2:
        return None
    tags, version = [t for t, _ in fields], fields[0][1]
    if tags[0] == INTEGER and version in (b"\0", b"\1"):
        if set(tags[:9]) == {INTEGER} and (len(tags) == 9 or (len(tags) == 10 and tags[9] == CONTAINER)):
            return "der"  # PKCS#1
        if tags == [INTEGER] * 6:
            return "der"  # DSA
        if version == b"\1" and tags[1] == OCTETS and set(tags[2:]) <= {0xA0, 0xA1} and len(fields[1][1]) >= 16:
            return "der"  # SEC1
        if len(tags) >= 3 and tags[2] == OCTETS and is_algorithm(fields[1]) and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
            return "der"  # PKCS#8
    if is_algorithm(fields[0]) and len(tags) == 2:
        if tags[1] == OCTETS and len(fields[1][1]) >= 16:
            return "der"  # encrypted PKCS#8
        if tags[1] == BITS and len(fields[1][1]) > 1:
            return "public"
    if tags == [INTEGER] * 2 and len(fields[0][1]) >= 64 and len(fields[1][1]) <= 4:
        return "public"  # modulus and exponent; the two numbers of a signature are alike in size
    return None


def wire_fields(data: bytes) -> list[bytes] | None:
    """Length-prefixed fields that fill ``data`` exactly."""
    at, fields = 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or size > len(data) - at - 4:
            return None
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return fields


SSH_MAGIC = b"openssh-key-v1\0"


def ssh_kind(data: bytes) -> str | None:
    """``ssh`` for a private key container, ``public`` for a public key, else None."""
    if data.startswith(SSH_MAGIC):
        rest, head = data[len(SSH_MAGIC) :], []
        for _ in range(3):
            size = int.from_bytes(rest[:4], "big")
            if len(rest) < 4 or size > len(rest) - 4:
                return None
            head.append(rest[4 : 4 + size])
            rest = rest[4 + size :]
        keys = int.from_bytes(rest[:4], "big")
        fields = wire_fields(rest[4:]) if len(rest) > 4 else None
        whole = fields is not None and keys > 0 and len(fields) == keys + 1
        return "ssh" if whole and re.fullmatch(rb"[a-z0-9@.-]+", head[0]) and all(fields) else None
    fields = wire_fields(data)
    named = fields and len(fields) >= 2 and re.fullmatch(rb"(ssh-|ecdsa-sha2-|sk-)[ -~]+", fields[0])
    return "public" if named and all(fields) else None


def is_encoded_secret(data: bytes) -> bool:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return False
    return all(c.isprintable() or c in "\t\r\n" for c in text) and bool(base_spans(text))


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".")
    parts = [from_base64(head), from_base64(body)]
    try:
        header, claims = (json.loads(p.decode()) for p in parts if p is not None)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, (dict, list))


def kind_of(data: bytes | None) -> str | None:
    """What some decoded bytes are."""
    if not data:
        return None
    return der_kind(data) or ssh_kind(data) or ("encoded" if is_encoded_secret(data) else None)


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    out, at = [], 0
    while m := TOKEN.search(text, at):
        found = is_signed_token(m[0])
        if found:
            out.append((m.start(), m.end(), "token"))
        at = m.end() if found else m.end(1)
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            data = from_base64(m[2])
            kind = data and (der_kind(data) or ssh_kind(data))
            if kind:
                out.append((m.start(), m.end(), kind))
    known = [(s, e) for s, e, _ in out]

    def fresh(start: int, end: int) -> bool:
        return not any(s <= start and end <= e for s, e in known)

    for m in LINES.finditer(text) if "\n" in text else ():
        kind = kind_of(from_base64(m[0])) if fresh(m.start(), m.end()) else None
        if kind:
            out.append((m.start(), m.end(), kind))
            known.append((m.start(), m.end()))
    for m in BASE64.finditer(text):
        if not fresh(m.start(), m.end()):
            continue
        kind = kind_of(from_base64(m[0]))
        if kind:
            out.append((m.start(), m.end(), kind))
            continue
        for pattern in PARTS:
            parts = [(p.start(), p.end(), kind_of(from_base64(p[0]))) for p in pattern.finditer(m[0]) if p.end() - p.start() < len(m[0])]
            parts = [(m.start() + s, m.start() + e, k) for s, e, k in parts if k]
            if parts:
                out += parts
                break
    for m in HEX_DATA.finditer(text):
        kind = kind_of(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])) if fresh(m.start(), m.end()) else None
        if kind:
            out.append((m.start(), m.end(), kind))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(set(spans), key=lambda x: (x[0], order[x[2]], x[1])))


def secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined, base kinds first
    at equal starts).  Null is an empty text: no spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[], [], []], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                for k, kind in enumerate(BASE_KINDS):
                    counts[k].append(sum(x[2] == kind for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + structural_spans(text)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string"))
    longs = [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
    texts = [T.StructField(k, T.StringType()) for k in ("base_sha256", "spans")]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *longs, *texts]))
