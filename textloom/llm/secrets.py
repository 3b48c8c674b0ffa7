"""Secret scans with structural confirmation.

Three base kinds are found by pattern alone (assign, access, hex). Further candidates, runs of base64 or hex, armoured
keys and dotted tokens, are reported only if what they encode holds together: DER whose nested lengths fill their
parents to the byte and which carries key material, SSH keys whose length-prefixed fields add up, tokens whose first
part is a JSON header that names an algorithm.

Whole texts, however long, are scanned as UTF-8 bytes; spans are code points, end exclusive. A null text is an empty
one; rows only map, so repeated rows, null ids and further columns have no effect on one another; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table
from .shingles import utf8

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "armour", "b64key", "hexkey")

#: On bytes in lower case (ASCII), so that letters match in either case.
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_TOKEN = re.compile(rb"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
_ARMOUR = re.compile(rb"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
_BLANK = re.compile(rb"\n[ \t\r]*\n")
_CRC = re.compile(rb"\n[ \t]*=[A-Za-z0-9+/]{4}\s*\Z")
_B64 = re.compile(rb"[A-Za-z0-9+/]{40,}+={0,2}")
#: What may stand between the lines of wrapped base64, its last line, and base64 in the alphabet of URLs.
_EOL = re.compile(rb"\r?\n[\x20\t]*+")
_LAST = re.compile(rb"\r?\n[\x20\t]*+[A-Za-z0-9+/]++={0,2}")
_URL64 = re.compile(rb"[A-Za-z0-9_-]{40,}+={0,2}")
#: How encoded keys begin: a DER sequence with a long length, OpenSSH's container, a field of an algorithm's name.
_KEY_START = re.compile(rb"(?=M[IE]|b3BlbnNzaC1rZXktdjE|AAAA[BCDE])")
_OPENSSH = b"openssh-key-v1\0"
_HEXKEY = re.compile(rb"[0-9a-fA-F]{64,}")


def der_fills(data: bytes, start: int, end: int, depth: int = 0) -> int:
    """How many DER values lie in data[start:end], nested ones included, if they fill it to the byte; else 0."""
    n = 0
    while start < end:
        if end - start < 2 or depth > 32:
            return 0
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return 0
            size, at = int.from_bytes(data[at : at + k], "big"), at + k
            if size < 0x80:
                return 0
        if at + size > end:
            return 0
        n += 1
        if tag & 0x20:
            inner = der_fills(data, at, at + size, depth + 1)
            if not inner and size:
                return 0
            n += inner
        start = at + size
    return n


def is_der_key(data: bytes) -> bool:
    """A DER sequence that fills data and holds an integer or object identifier near its start, as encodings of keys do."""
    return len(data) >= 24 and data[0] == 0x30 and der_fills(data, 0, len(data)) >= 3 and (0x02 in data[2:8] or 0x06 in data[2:12])


def _is_openssh(data: bytes) -> bool:
    """Cipher, key derivation and its options, the number of keys, so many public keys, and the private part, to the last byte."""
    at, fields, keys = len(_OPENSSH), 0, 0
    while fields < 4 + keys:
        if at + 4 > len(data):
            return False
        size, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if fields == 3:
            keys = size
            if not 1 <= keys <= 64:
                return False
        elif at + size > len(data) or fields < 2 and not size:
            return False
        else:
            at += size
        fields += 1
    if at + 4 > len(data):
        return False
    size = int.from_bytes(data[at : at + 4], "big")
    return size > 0 and at + 4 + size == len(data)


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields to the last byte, the first an algorithm's name; or OpenSSH's own container."""
    if data.startswith(_OPENSSH):
        return _is_openssh(data)
    at = fields = 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        field = data[at + 4 : at + 4 + size]
        if len(field) != size or fields == 0 and not re.match(rb"(?:sk-)?(?:ssh|ecdsa)-[a-z0-9-]+", field):
            return False
        at, fields = at + 4 + size, fields + 1
    return at == len(data) and fields >= 2


def _unpad(run: bytes, url: bool = False) -> bytes | None:
    run = run.rstrip(b"=")
    if len(run) % 4 == 1:
        return None
    try:
        return (base64.urlsafe_b64decode if url else base64.b64decode)(run + b"=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return None


def is_token(run: bytes) -> bool:
    head = _unpad(run.split(b".")[0], url=True)
    try:
        fields = json.loads(head) if head is not None else None
    except (ValueError, RecursionError):
        return False
    return isinstance(fields, dict) and isinstance(fields.get("alg"), str)


def is_pgp_key(data: bytes) -> bool:
    """An OpenPGP packet of a secret key or subkey that lies in data whole, of a known version."""
    if len(data) < 8 or not data[0] & 0x80:
        return False
    if data[0] & 0x40:
        tag, k = data[0] & 0x3F, data[1]
        if k < 192:
            at, size = 2, k
        elif k < 224:
            at, size = 3, ((k - 192) << 8) + data[2] + 192
        elif k == 255:
            at, size = 6, int.from_bytes(data[2:6], "big")
        else:
            return False
    else:
        tag, k = (data[0] & 0x3C) >> 2, data[0] & 3
        if k == 3:
            at, size = 1, len(data) - 1
        else:
            at = 1 + (1 << k)
            size = int.from_bytes(data[1:at], "big")
    return tag in (5, 7) and size > 0 and at + size <= len(data) and data[at] in (2, 3, 4, 5, 6)


def _armoured(raw: bytes) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """(start, end, label, headers, body) of what lies between an END line and the last BEGIN line before it, if their labels are equal."""
    begin = None
    for m in _ARMOUR.finditer(raw):
        if m[1] == b"BEGIN":
            begin = m
        elif begin is not None and begin[2] == m[2]:
            body, headers = raw[begin.end() : m.start()], b""
            if b":" in body:
                # headers end at the blank line, or with the last line that has a colon
                cut = _BLANK.search(body, len(body) - len(body.lstrip()))
                at = cut.end() if cut and b":" in body[: cut.start()] else body.find(b"\n", body.rindex(b":")) + 1 or len(body)
                headers, body = body[:at], body[at:]
            yield begin.start(), m.end(), m[2], headers, body
            begin = None


def _is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or is_ssh_key(data))


def _wrapped(raw: bytes) -> Iterator[tuple[int, int]]:
    """Runs of base64 that go on over line breaks, if they may begin a key."""
    start = end = -1
    for m in [*_B64.finditer(raw), None]:
        gap = m and end >= 0 and _EOL.match(raw, end)
        if gap and gap.end() == m.start():
            end = m.end()
            continue
        if start >= 0 and raw[start : start + 1] in b"MA" or start >= 0 and raw.startswith(b"b3Bl", start):
            last = _LAST.match(raw, end)
            if last or b"\n" in raw[start:end]:
                yield start, last.end() if last else end
        if m:
            start, end = m.start(), m.end()


def _glued(run: bytes, at: int) -> list[tuple[int, int]]:
    """Keys in DER inside a run of base64, with other characters before or after: the length at a key's start says where it ends."""
    out, free = [], 0
    for m in _KEY_START.finditer(run):
        head = _unpad(run[m.start() : m.start() + 8])
        if m.start() < free or not head or head[0] != 0x30 or len(head) < 6:
            continue
        k = head[1] & 0x7F if head[1] & 0x80 else 0
        # a key opens with a number or another sequence
        if k > 3 or head[2 + k] not in (0x02, 0x30):
            continue
        size = 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])
        chars = -(-size * 4 // 3)
        if size < 48 or m.start() + chars > len(run):
            continue
        data = _unpad(run[m.start() : m.start() + -(-chars // 4) * 4])
        if data is None or len(data) < size:
            data = _unpad(run[m.start() : m.start() + chars])
        if data and is_der_key(data[:size]):
            out.append((at + m.start(), at + m.start() + chars))
            free = m.start() + chars
    return out


def scan(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span in a text's UTF-8 bytes, by start, then kind; base kinds overlap others freely."""
    found = []
    for m in _ASSIGN.finditer(raw.lower()):
        if m.end(1) - m.start(1) >= 8:
            found.append((m.start(), 0, m.end()))
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(raw)]
    if b"eyJ" in raw:
        found += [(m.start(), 3, m.end()) for m in _TOKEN.finditer(raw) if is_token(m[0])]
    armoured = []
    if b"PRIVATE KEY" in raw:
        for start, end, label, headers, body in _armoured(raw):
            data = _unpad(re.sub(rb"\s", b"", _CRC.sub(b"", body)))
            # an encrypted body is opaque: its header stands for its structure
            opaque = data and b"-" not in body and b"ENCRYPTED" in label + headers
            if opaque or (data is not None and is_pgp_key(data) if label.endswith(b"BLOCK") else _is_key(data)):
                found.append((start, 4, end))
                armoured.append((start, end))
    taken = list(armoured)

    def keep(start: int, end: int) -> None:
        if not any(a <= start < b for a, b in taken):
            found.append((start, 5, end))
            taken.append((start, end))

    for start, end in _wrapped(raw) if b"\n" in raw else ():
        if _is_key(_unpad(re.sub(rb"\s", b"", raw[start:end]))):
            keep(start, end)
    for m in _B64.finditer(raw):
        whole = (m[0][:1] in b"MA" or m[0].startswith(b"b3Bl")) and _is_key(_unpad(m[0]))
        for start, end in [(m.start(), m.end())] if whole else _glued(m[0], m.start()):
            keep(start, end)
    if b"_" in raw or b"-" in raw:
        for m in _URL64.finditer(raw):
            if (b"_" in m[0] or b"-" in m[0]) and _KEY_START.match(m[0]) and _is_key(_unpad(m[0], url=True)):
                keep(m.start(), m.end())
    for m in _HEXKEY.finditer(raw):
        if m[0][:2] in (b"30", b"00") and len(m[0]) % 2 == 0 and _is_key(bytes.fromhex(m[0].decode())):
            found.append((m.start(), 6, m.end()))
    return sorted(found)


def _points(raw: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    if not found or raw.isascii():
        return found
    upto = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(upto[a]), k, int(upto[b])) for a, k, b in found]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        data, off = data.tobytes(), offsets.tolist()
        rows = []
        for a, b in zip(off[:-1], off[1:], strict=True):
            raw = data[a:b]
            spans = _points(raw, scan(raw))
            base = [s for s in spans if s[1] < len(BASE_KINDS)]
            rows.append(([sum(s[1] == k for s in base) for k in range(3)], hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
        counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
