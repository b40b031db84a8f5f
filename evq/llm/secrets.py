"""Secrets in texts: plain patterns, and structural confirmation of encoded ones.

Spans are half-open ranges of code points, by kind:

- assign: a password, secret, token or API key with its value; access: an access key id; hex: a long lower-case hex run.
  These are found by pattern alone.
- jwt: three base64url parts of which the first decodes to a JSON object that names an algorithm and the second to a
  JSON object. pem: a private-key block whose body decodes to one of the encodings below. key: a bare base64 or hex run
  that does. An encoding is confirmed by parsing it: a DER value whose nested lengths add up exactly and that has the
  members of a PKCS#1, PKCS#8, encrypted PKCS#8 or SEC1 private key, or an OpenSSH key container with its length-prefixed
  fields. A run that does not parse is not reported.

A null or empty text has no spans; overlapping spans of different kinds are all reported.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.llm.tokens import texts_of

# Kinds in their order, and the patterns of the base kinds.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Every run that an access key id, a hex run or a bare key could lie in; the least of them has 20 characters.
LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
#: Up to the matching end mark: headers may hold hyphens. No other block begins in between, so each is read once.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----BEGIN ))*?)-----END \1-----")
HEADER = re.compile(r"^[ \t]*[A-Za-z][A-Za-z0-9-]*:.*$", re.M)
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
OPENSSH = b"openssh-key-v1\0"


def der(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) values that ``data`` consists of, or None if lengths don't add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at:at + width]), at + width
        if at + size > len(data):
            return None
        out.append((tag, data[at:at + size]))
        at += size
    return out


def private_key(data: bytes) -> str | None:
    """Which private-key encoding the bytes are, or None."""
    if data.startswith(OPENSSH):
        return "openssh" if _openssh(data[len(OPENSSH):]) else None
    outer = der(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE or not (inner := der(outer[0][1])):
        return None
    tags = [tag for tag, _ in inner]
    if len(inner) >= 9 and set(tags[:9]) == {INTEGER} and inner[0][1] in (b"\0", b"\1"):
        return "pkcs1"
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and inner[0][1] in (b"\0", b"\1") and _algorithm(inner[1][1]):
        return "pkcs8"
    if tags == [SEQUENCE, OCTETS] and _algorithm(inner[0][1]):
        return "pkcs8-encrypted"
    if tags[:2] == [INTEGER, OCTETS] and inner[0][1] == b"\1" and set(tags[2:]) <= {0xA0, 0xA1} and 16 <= len(inner[1][1]) <= 66:
        return "sec1"
    return None


def _algorithm(data: bytes) -> bool:
    parts = der(data)
    return bool(parts) and parts[0][0] == OID and len(parts[0][1]) >= 3


def _openssh(data: bytes) -> bool:
    """Cipher, key derivation, its options, the number of keys, then public keys and the private part by length."""
    at, fields = 0, 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at:at + 4])
        if fields == 3:
            if not 1 <= size <= 16:
                return False
            at, fields = at + 4, fields + 1
            continue
        if at + 4 + size > len(data):
            return False
        at, fields = at + 4 + size, fields + 1
    return at == len(data) and fields >= 6


def unbase64(text: str) -> bytes | None:
    plain = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def pem_key(body: str) -> bool:
    """Whether the text between the marks of a private-key block is one, also with line breaks written as \\n and \\r."""
    body = re.sub(r"\\+n", "\n", re.sub(r"\\+r|\r", "", body)).replace("\\/", "/").strip()
    if ":" not in body:
        return bool((data := unbase64(body)) and private_key(data))
    head, blank, rest = re.sub(r"\n[ \t]+\n", "\n\n", body).partition("\n\n")  # the headers of an encrypted block end with an empty line
    data = unbase64(rest if blank else HEADER.sub("", head))
    return bool(data and (private_key(data) or ("DEK-Info" in body and len(data) % 8 == 0)))


def _object(part: str) -> dict | None:
    data = unbase64(part)
    if not data or not data.lstrip().startswith(b"{"):
        return None
    try:
        found = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of every span, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    long = LONG.search(text)
    if long:
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "." in text:
        out += [(m.start(), 3, m.end()) for m in JWT.finditer(text)
                if isinstance((_object(m[1]) or {}).get("alg"), str) and _object(m[2]) is not None]
    blocks = []
    if "-----BEGIN" in text:
        blocks = [(m.start(), m.end()) for m in PEM.finditer(text) if pem_key(m[2])]
    out += [(a, 4, b) for a, b in blocks]
    if long:
        for m in ENCODED.finditer(text):
            if any(a <= m.start() < b for a, b in blocks):
                continue
            run = m[0]
            tries = [unbase64(run)]
            if len(run) % 2 == 0 and re.fullmatch("[0-9A-Fa-f]+", run):
                tries.append(bytes.fromhex(run))
            if any(data and private_key(data) for data in tries):
                out.append((m.start(), 5, m.end()))
    return sorted(out)


SPANS = "array<struct<kind: string, start: int, end: int>>"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans (kind, start, end) of every row, by start and then by the order of the kinds."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for i, j, texts in texts_of(batch):
                found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t)] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("key")[i:j], pa.array(found, kind)], names=["key", "spans"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("key", key)


def listed(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of these kinds, joined by commas."""
    own = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` (overlapping ones as one) replaced by ``mask``; null texts stay null."""
    fields = docs.schema.fields
    place = [f.name for f in fields].index(text)

    def clean(value: str | None) -> str | None:
        found = spans(value) if value else []
        if not found:
            return value
        out, at, stop = [], 0, 0
        for a, _, b in found:
            if a >= stop:
                out += [value[at:a], mask]
            at = stop = max(stop, b)
        return "".join([*out, value[at:]])

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            kind = columns[place].type
            columns[place] = pa.array([clean(x) for x in columns[place].to_pylist()], kind)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
