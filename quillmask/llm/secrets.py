"""Secret scans with structural confirmation.

Pattern matches alone are reported as they are (kinds ``assign``, ``access`` and ``hex``). Beyond them, runs of base64 or
hexadecimal text, PEM blocks and dotted tokens are candidates only: they are decoded, and reported when what comes out has
the structure of a key (nested DER lengths that add up, a private key's fields, an OpenSSH container) or of a signed token
(a JSON header that names an algorithm, a JSON payload, a signature). A key may stand behind a path in the same run of characters: its outer length says where it begins. It may be wrapped
over lines of equal length.

Rows are independent, so the scan is one pass without a shuffle, and each text is read a fixed number of times, whatever stands in it: time and memory are in proportion to its length.
A null or empty text has no spans; a null identifier, repeated rows and an empty table pass through; spans of equal place are in the order of their kinds; further columns, of any name, are not
looked at and not returned.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw, table

#: Fixed values of the contract: the kinds in order, and the base patterns.
KINDS = ("assign", "access", "hex", "pem", "key", "jwt")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

MARK = re.compile(rb"-----(BEGIN|END) ((?:[A-Z0-9]{1,16} ){0,4}PRIVATE KEY)-----")
BODY = re.compile(rb"[A-Za-z0-9+/=\s:,.-]*")
#: Lines of base64 of one length with a last one that may be shorter.
WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{48,96}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/]{1,96}={0,2}(?![A-Za-z0-9+/=])")
#: How the base64 of a DER sequence may begin.
_SEQUENCE = re.compile(rb"(?<![A-Za-z0-9])M[A-P]")
JWT = re.compile(rb"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Runs this long may hold a key: 48 bytes in base64, 32 in hexadecimal.
KEY_CHARS = 64
_RUN = re.compile(rb"[A-Za-z0-9+/_-]{%d,}={0,2}" % KEY_CHARS)
_HEX = re.compile(rb"[0-9a-fA-F]+")
_IS_LOW_HEX = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
_IS_KEYISH = bytes(1 if chr(c).isascii() and (chr(c).isalnum() or c in b"+/_-") else 0 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

SPANS = "spans array<struct<kind:string,start:bigint,end:bigint>>"


def runs(flags: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of 1 of at least that length."""
    need, at = b"\x01" * least, 0
    while (s := flags.find(need, at)) >= 0:
        e = flags.find(b"\x00", s)
        e = len(flags) if e < 0 else e
        yield s, e
        at = e


def der_items(data: bytes, at: int, end: int, depth: int = 0) -> list | None:
    """The DER values that fill data[at:end] exactly, constructed ones nested; None if any length doesn't fit."""
    out = []
    while at < end:
        if depth > 12 or at + 2 > end:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                return None
        if at + n > end:
            return None
        if tag & 0x20:
            inner = der_items(data, at, at + n, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + n]))
        at += n
    return out


def is_key(data: bytes) -> bool:
    """Whether the bytes are a private key: PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or OpenSSH."""
    if data.startswith(b"openssh-key-v1\x00"):
        at = 15
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64
    if len(data) < 16 or data[0] != 0x30 or not (items := der_items(data, 0, len(data))) or len(items) != 1 or items[0][0] != 0x30:
        return False
    fields = items[0][1]
    tags = [t for t, _ in fields]
    if tags[:9] == [0x02] * 9 and fields[0][1] in (b"\x00", b"\x01"):
        return len(fields[1][1]) >= 32
    if tags[:3] == [0x02, 0x30, 0x04] and fields[0][1] in (b"\x00", b"\x01"):
        return bool(fields[1][1]) and fields[1][1][0][0] == 0x06
    if tags[:2] == [0x02, 0x04] and fields[0][1] == b"\x01":
        return len(fields[1][1]) >= 16
    return tags == [0x30, 0x04] and bool(fields[0][1]) and fields[0][1][0][0] == 0x06 and len(fields[0][1]) == 2


def unbase64(data: bytes) -> bytes | None:
    body = data.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def is_token(header: bytes, payload: bytes, signature: bytes) -> bool:
    try:
        head, load = json.loads(unbase64(header) or b""), json.loads(unbase64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(load, dict) or not isinstance(head.get("alg"), str) or not head["alg"]:
        return False
    return head["alg"].lower() == "none" or bool(unbase64(signature))


def der_size(start: bytes) -> int:
    """The bytes of the DER value whose first bytes these are, with its head; 0 if they are no such."""
    if len(start) < 2:
        return 0
    k = start[1] & 0x7F
    if start[1] < 0x80:
        return 2 + k
    return 2 + k + int.from_bytes(start[2 : 2 + k], "big") if 1 <= k <= 4 and len(start) >= 2 + k else 0


def key_at(run: bytes) -> int:
    """Where in a run of characters a key stands that ends with the run, -1 if there is none."""
    if _HEX.fullmatch(run) and len(run) % 2 == 0 and is_key(bytes.fromhex(run.decode())):
        return 0
    if (data := unbase64(run)) and is_key(data):
        return 0
    bare = run.rstrip(b"=")
    for m in _SEQUENCE.finditer(run, 1):  # only where the outer length says that the value ends with the run is anything decoded
        head = unbase64(bare[m.start() : m.start() + 8])
        if head and -(-4 * der_size(head) // 3) == len(bare) - m.start() >= KEY_CHARS and (data := unbase64(run[m.start() :])) and is_key(data):
            return m.start()
    return -1


def pem_blocks(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, body) of a BEGIN and the END of the same label that follows it as the next mark."""
    before = None
    for m in MARK.finditer(text):
        if m[1] == b"END" and before is not None and before[2] == m[2] and BODY.fullmatch(text, before.end(), m.start()):
            yield before.start(), m.end(), text[before.end() : m.start()]
        before = m if m[1] == b"BEGIN" else None


def wrapped_keys(text: bytes) -> Iterator[tuple[int, int]]:
    for m in WRAPPED.finditer(text):
        lines = m[0].split()
        if len({len(x) for x in lines[:-1]}) == 1 and len(lines[-1].rstrip(b"=")) <= len(lines[0]) and (data := unbase64(b"".join(lines))) and is_key(data):
            yield m.span()


def scan(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind as listed."""
    found: list[tuple[int, int, int]] = []
    low = text.translate(_LOWER)
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(s, 2, e) for s, e in runs(text.translate(_IS_LOW_HEX), LEAST["hex"])]
    taken: list[tuple[int, int]] = []
    if b"PRIVATE KEY-----" in text:
        for start, end, inner in pem_blocks(text):
            body = re.sub(rb"\A(?:\s*[A-Za-z-]+:[^\n]*\n)+", b"", inner)
            data = unbase64(re.sub(rb"\s+", b"", body))
            if data and (is_key(data) or (b"ENCRYPTED" in inner and len(data) % 8 == 0)):
                found.append((start, 3, end))
                taken.append((start, end))
    within = lambda at: bool(n := bisect_right(taken, (at, len(text)))) and at < taken[n - 1][1]
    keyish, keys = text.translate(_IS_KEYISH), []
    for s, _ in runs(keyish, KEY_CHARS):
        m = _RUN.match(text, s)
        if m and not within(s) and (at := key_at(m[0])) >= 0:
            found.append((s + at, 4, m.end()))
            keys.append((s + at, m.end()))
    taken = sorted(taken + keys)
    if any(text[e : e + 1] in (b" ", b"\t", b"\r", b"\n") for _, e in runs(keyish, 48)):
        found += [(s, 4, e) for s, e in wrapped_keys(text) if not within(s)]
    if b"eyJ" in text:
        found += [(m.start(), 5, m.end()) for m in JWT.finditer(text) if is_token(m[1], m[2], m[3])]
    found.sort()
    if text.isascii():
        return [(KINDS[k], s, e) for s, k, e in found]
    at, n, point = 0, 0, {}
    for to in sorted({x for s, _, e in found for x in (s, e)}):
        n += len(text[at:to].decode("utf-8", "surrogatepass"))
        at, point[to] = to, n
    return [(KINDS[k], point[s], point[e]) for s, k, e in found]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``spans`` for every row."""
    df = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema["id"].dataType.simpleString()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] if t else [] for t in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans)], ["id", "spans"])

    return df.mapInArrow(scanned, f"id {kind}, {SPANS}").withColumnRenamed("id", id_col)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s.kind.isin(*KINDS[:3]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
