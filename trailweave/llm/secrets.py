"""Secret scan (operator 2): Aho-Corasick keyword prefilter, anchored patterns near hits, checksums.

One pass of an Aho-Corasick automaton over the lower-cased bytes finds all
keywords and token prefixes; a pattern is only tried where its keyword starts.
Runs of hexadecimal digits have no keyword: they are found by one byte-table
pass.  Tokens that embed a checksum or structure are validated before they count.

Defined cases: null and empty texts have no spans; spans are in code points
with an exclusive end; of spans of one kind the leftmost count; equal rows give equal
results; very long texts are read whole; an empty table gives no rows; other columns,
whatever their names, pass through in ``row``.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, replaced_text, spread, table

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(rb"(eyJ[0-9A-Za-z_-]{8,})\.(eyJ[0-9A-Za-z_-]{2,})\.[0-9A-Za-z_-]{16,}")
PEM = re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----([0-9A-Za-z+/=\s]+)-----END \1PRIVATE KEY-----")
#: Order of the kinds in the joined results.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))


def _base62(text: bytes) -> int:
    value = 0
    for c in text:
        value = value * 62 + _BASE62.index(c)
    return value


def _crc_tail(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the ones before them."""
    return _base62(m[2]) == zlib.crc32(m[1])


def _header(m: re.Match) -> bool:
    """The first part is base64url of a JSON object that names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


def _der(m: re.Match) -> bool:
    """The body is base64 of an ASN.1 sequence (or an armoured key)."""
    try:
        raw = base64.b64decode(b"".join(m[2].split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    return len(raw) >= 16 and (raw[0] == 0x30 or raw.startswith(b"openssh-key"))


#: Kind: pattern, check of a match.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "github": (GITHUB, _crc_tail),
    "npm": (NPM, _crc_tail),
    "jwt": (JWT, _header),
    "pem": (PEM, _der),
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def byte_spans(body: bytes, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start, then in the order of KINDS."""
    spans = []
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in automaton.iter(body.lower().decode("latin-1")):
        starts.setdefault(kind, []).append(end - n + 1)
    for kind, at in starts.items():
        pattern, check = RULES[kind]
        free = 0
        for start in sorted(at):
            if start >= free and (m := pattern.match(body, start)):
                free = m.end()  # a match that fails its check still takes its place
                if check(m):
                    spans.append((start, free, kind))
    runs = body.translate(_HEX)
    start = runs.find(b"x" * 24)
    while start >= 0:
        end = runs.find(b" ", start)
        end = len(runs) if end < 0 else end
        spans.append((start, end, "hex"))
        start = runs.find(b"x" * 24, end)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def char_spans(body: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if body.isascii() or not spans:
        return spans
    marks = sorted({x for s in spans for x in s[:2]})
    where, at, chars = {}, 0, 0
    for mark in marks:
        chars += len(body[at:mark].decode("utf-8", "replace"))
        where[mark] = chars
        at = mark
    return [(where[s], where[e], kind) for s, e, kind in spans]


def _worker(redact: bool):
    def make():
        automaton = _automaton()

        def one(body: bytes) -> dict:
            raw = byte_spans(body, automaton)
            spans = char_spans(body, raw)
            out = {"spans": [{"kind": k, "start": s, "end": e} for s, e, k in spans]}
            if redact:
                parts, at = [], 0
                for s, e, _ in raw:
                    if s >= at:
                        parts += [body[at:s], b"[SECRET]"]
                    at = max(at, e)
                out["redacted"] = b"".join([*parts, body[at:]]).decode("utf-8", "replace") if raw else body.decode("utf-8", "replace")
            return out

        return lambda bodies: [one(b) for b in bodies]

    return make


_SPANS = (
    "spans",
    T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
    pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])),
)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``id``, ``absent`` and ``spans`` (kind, start, end in code points) of each text."""
    return map_texts(df, id_col, text_col, _worker(False), [_SPANS])


def redact_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with ``[SECRET]`` in place of each secret."""
    out = map_texts(df, id_col, text_col, _worker(True), [_SPANS, ("redacted", T.StringType(), pa.string())])
    return replaced_text(df, out, text_col, F.col("redacted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs).select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


__all__ = ["find_secrets", "redact_secrets", "byte_spans", "query"]
