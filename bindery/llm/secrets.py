"""Secret scan with structural confirmation.

Three patterns give the base spans. Encoded candidates (base64, base64url, hex, armoured blocks) are decoded and kept only
if the bytes parse: DER key encodings whose nested lengths close exactly, SSH key blobs whose length-prefixed fields fill
them, and signed tokens whose header is a JSON object that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import text_blocks

#: The order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
#: How base64url of a brace and what may follow it in an object that isn't empty starts: quote, blank, line end, carriage return, tab.
_HEADS = re.compile(r"e(?:yJ|yA|wo|w0|wk)")
_ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*KEY)-----")
_SSH_NAME = re.compile(rb"(ssh-|ecdsa-sha2-|sk-)[a-z0-9@.-]+$")

#: Bytes of a hex run as h, others of a base64 run as x, the rest as blanks: finds long runs without a pattern.
_RUNS = bytes(ord("h") if c in b"0123456789abcdef" else ord("x") if chr(c).isascii() and (chr(c).isalnum() or c in b"+/_-") else 32 for c in range(256))
_ONE_RUN = bytes.maketrans(b"h", b"x")
_WORDS = ("passw", "secret", "token", "api")


def _der(raw: bytes, at: int, end: int, depth: int = 0) -> list[int] | None:
    """Tags of the DER items that fill raw[at:end] exactly, those of nested sequences included; None if they don't."""
    tags = []
    while at < end:
        if end - at < 2 or depth > 8:
            return None
        tag, n, at = raw[at], raw[at + 1], at + 2
        if n & 128:
            k = n & 127
            if not 1 <= k <= 4 or end - at < k or raw[at] == 0:
                return None
            n, at = int.from_bytes(raw[at : at + k], "big"), at + k
        if n > end - at:
            return None
        tags.append(tag)
        if tag in (0x30, 0x31, 0xA0, 0xA1):
            if (inner := _der(raw, at, at + n, depth + 1)) is None:
                return None
            tags += inner
        at += n
    return tags


def is_der_key(raw: bytes) -> bool:
    """One sequence that fills the bytes and holds an object identifier or, as RSA keys do, several integers."""
    if len(raw) < 24 or raw[0] != 0x30:
        return False
    tags = _der(raw, 0, len(raw))
    return tags is not None and tags[0] == 0x30 and (0x06 in tags and (0x03 in tags or 0x04 in tags) or tags.count(0x02) >= 2)


def is_ssh_key(raw: bytes) -> bool:
    """An OpenSSH private key container, or a public blob of length-prefixed fields after its type's name."""
    if raw.startswith(b"openssh-key-v1\0"):
        raw, least = raw[15:], 3
        named = True
    else:
        least, named = 2, False
    at = n = 0
    while at < len(raw):
        if len(raw) - at < 4:
            return False
        size = int.from_bytes(raw[at : at + 4], "big")
        if named and n == 3:  # the number of keys stands between the options and the keys
            at, n = at + 4, n + 1
            continue
        if size > len(raw) - at - 4:
            return False
        if not named and n == 0 and not _SSH_NAME.match(raw[4 : 4 + size]):
            return False
        at, n = at + 4 + size, n + 1
    return n >= least


def _decode(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    """The JSON object that a base64url part holds."""
    raw = _decode(part)
    if not raw or not raw.startswith(b"{"):
        return None
    try:
        out = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of three base64url parts between dots, the first a JSON object with a text under "alg", the second JSON too.

    Every three neighbouring parts of a dotted run are tried; a header may start anywhere within its part, after letters that
    belong to something else.
    """
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 2:
            continue
        parts, at = run[0].split("."), run.start()
        for k in range(len(parts) - 2):
            head = parts[k]
            if len(head) >= 10 and len(parts[k + 1]) >= 2 and _HEADS.search(head):
                start = _header(head)
                if start is not None and _object(parts[k + 1]) is not None:
                    yield at + start, at + len(head) + len(parts[k + 1]) + len(parts[k + 2]) + 2
            at += len(head) + 1


_SIGNS = re.compile(rb'\\*["{}]')


def _opening(raw: bytes) -> int:
    """Where the JSON object that ends ``raw`` would begin, -1 if nowhere: quotes and braces are read from the end, where no text is
    open, so there is one place at most."""
    depth, quoted = 0, False
    if not raw.rstrip().endswith(b"}"):
        return -1
    for sign in reversed(list(_SIGNS.finditer(raw))):
        mark = sign[0][-1:]
        if mark == b'"':
            quoted ^= len(sign[0]) % 2 == 1
        elif not quoted:
            depth += 1 if mark == b"}" else -1
            if not depth:
                return sign.end() - 1
    return -1


def _header(head: str) -> int | None:
    """Where in ``head`` a base64url object with a text under "alg" starts that fills the rest. The part is decoded once for each of the
    three ways in which groups of four may lie up to its end."""
    found = []
    for over in (0, 2, 3):
        first = (len(head) - over) % 4
        raw = base64.urlsafe_b64decode(head[first:] + "=" * (-over % 4))
        at = _opening(raw)
        if at >= 0 and at % 3 == 0:
            start = first + at // 3 * 4
            said = _object(head[start:])
            if said and isinstance(said.get("alg"), str):
                found.append(start)
    return min(found, default=None)


def armoured(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, base64) of blocks between a key's BEGIN and the END that follows it.

    Line ends may be written as backslash and letter, as in JSON files; header lines with a colon are left out.
    """
    begun = None
    for m in _ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun and begun[2] == m[2]:
            body = text[begun.end() : m.start()].replace("\\n", "\n").replace("\\r", "\n")
            yield begun.start(), m.end(), "".join("".join(x for x in body.split("\n") if ":" not in x).split())
            begun = None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind; base spans and confirmed ones."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    runs = text.encode("utf-8", "surrogatepass").translate(_RUNS)
    if b"h" * 32 in runs:
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    long = b"x" * 40 in runs.translate(_ONE_RUN)
    decoded = []
    if long:
        decoded += [(m.start(), m.end(), bytes.fromhex(m[0][: len(m[0]) // 2 * 2])) for m in _LONG_HEX.finditer(text)]
        decoded += [(m.start(), m.end(), raw) for m in _BASE64.finditer(text) if (raw := _decode(m[0]))]
    if "-----BEGIN " in text:
        decoded += [(start, end, raw) for start, end, body in armoured(text) if (raw := _decode(body))]
    for start, end, raw in decoded:
        kind = "der" if is_der_key(raw) else "ssh" if is_ssh_key(raw) else None
        if kind:
            out.append((kind, start, end))
    if _HEADS.search(text):
        out += [("jwt", start, end) for start, end in signed_tokens(text)]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(out), key=lambda s: (s[1], order[s[0]], s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in text_blocks(batches):
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] if t else [] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col`` and ``spans`` array<struct<kind, start, end>>, in code points, end exclusive.

    One pass without a shuffle. Null and empty texts have no spans; ids may be null or repeated; other columns are
    ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_scan, "id long, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
