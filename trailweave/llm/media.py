"""Media columns with signature sniffing (operator 9).

``store`` writes payloads as 8-bit mono PCM in a WAVE container, one sample per
byte.  ``sniff`` reads stored media back without trusting a declared type: one
Aho-Corasick pass over the bytes locates magic numbers, validators confirm
structure and lengths at each, and what holds up is the true type or an
embedded (carved) object.

Lengths are those that the structure itself tells: chunks, frames, pages, sections or
a compressed stream that end where the next part, or a valid end mark, says so.  What is
cut short is not confirmed.  Bytes inside a confirmed object are not validated again at
marks of the same kind, so an archive of many entries is walked once.

Defined cases: null and empty texts are one block of zeros; media of no known
structure have type ``unknown`` and no payload; null media have no row values;
equal payloads give equal media; repeated rows are stored each; long texts are one
media value each, about 4 MB at a time; an empty table gives no rows; other columns,
whatever their names, pass through in ``row``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, slices, spread, table

BLOCK = 64
RATE = 8000
#: Magic numbers by type.
MAGIC = {
    "wav": b"RIFF", "png": b"\x89PNG\r\n\x1a\n", "gif": b"GIF8", "jpeg": b"\xff\xd8\xff", "pdf": b"%PDF-", "zip": b"PK\x03\x04", "gzip": b"\x1f\x8b\x08", "bmp": b"BM", "flac": b"fLaC", "ogg": b"OggS",
}


_SCAN_END = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]", re.S)
_PDF_END = re.compile(rb"startxref\s+(\d+)\s+%%EOF")


def padded(body: bytes, block: int = BLOCK) -> bytes:
    """The bytes with zeros up to a positive multiple of ``block``."""
    return body + bytes(-len(body) % block if body else block)


def wave(payload: bytes, rate: int = RATE) -> bytes:
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload + bytes(n % 2)


def _wav(raw: bytes, at: int) -> int:
    """Length of a RIFF/WAVE file at ``at``; 0 if its chunks do not add up."""
    if raw[at + 8 : at + 12] != b"WAVE" or len(raw) < at + 12:
        return 0
    end = at + 8 + struct.unpack_from("<I", raw, at + 4)[0]
    if end > len(raw):
        return 0
    pos, names = at + 12, []
    while pos + 8 <= end:
        names.append(raw[pos : pos + 4])
        size = struct.unpack_from("<I", raw, pos + 4)[0]
        pos += 8 + size + size % 2
    return end - at if pos == end and b"fmt " in names and b"data" in names else 0


def _png(raw: bytes, at: int) -> int:
    pos = at + 8
    while pos + 12 <= len(raw):
        size = struct.unpack_from(">I", raw, pos)[0]
        if pos + 12 + size > len(raw) or zlib.crc32(raw[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", raw, pos + 8 + size)[0]:
            return 0
        kind, pos = raw[pos + 4 : pos + 8], pos + 12 + size
        if kind == b"IEND":
            return pos - at
    return 0


def _gif(raw: bytes, at: int) -> int:
    if raw[at + 3 : at + 6] not in (b"87a", b"89a") or len(raw) < at + 13:
        return 0
    flags = raw[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while pos < len(raw):
        mark = raw[pos]
        if mark == 0x3B:
            return pos + 1 - at
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 <= len(raw):
            flags = raw[pos + 9]
            pos += 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        else:
            return 0
        while pos < len(raw) and raw[pos]:
            pos += raw[pos] + 1
        pos += 1
    return 0


def _jpeg(raw: bytes, at: int) -> int:
    pos = at + 2
    while pos + 4 <= len(raw) and raw[pos] == 0xFF:
        mark, size = raw[pos + 1], struct.unpack_from(">H", raw, pos + 2)[0]
        if size < 2 or mark in (0x00, 0xD8, 0xFF):
            return 0
        pos += 2 + size
        if mark == 0xDA:  # entropy-coded data up to the next marker that is no stuffing and no restart
            found = _SCAN_END.search(raw, pos)
            if not found:
                return 0
            pos = found.start()
            if raw[pos + 1] == 0xD9:
                return pos + 2 - at
    return 0


def _pdf(raw: bytes, at: int) -> int:
    """To the last end mark, before another header, whose ``startxref`` points at a cross-reference inside the file."""
    if not re.match(rb"\d\.\d", raw[at + 5 : at + 8]):
        return 0
    other = raw.find(b"%PDF-", at + 5)
    length = 0
    for m in _PDF_END.finditer(raw, at, other if other >= 0 else len(raw)):
        xref = at + int(m[1])
        if at < xref < m.start() and (raw.startswith(b"xref", xref) or re.match(rb"\d+ \d+ obj", raw[xref : xref + 24])):
            length = m.end() - at
    return length


def _zip(raw: bytes, at: int) -> int:
    """Local entries, then the central directory, then its end record, each where the one before says."""
    pos = at
    while raw[pos : pos + 4] == b"PK\x03\x04" and pos + 30 <= len(raw):
        flags, size, name, extra = struct.unpack_from("<H", raw, pos + 6)[0], *struct.unpack_from("<I", raw, pos + 18), *struct.unpack_from("<HH", raw, pos + 26)
        data = pos + 30 + name + extra
        if flags & 8:  # sizes follow the data: the central directory has them
            break
        pos = data + size
    end = raw.find(b"PK\x05\x06", pos)
    while end >= 0 and end + 22 <= len(raw):
        count, size, start, note = struct.unpack_from("<HIIH", raw, end + 10)
        if at + start + size == end and at + start >= pos and end + 22 + note <= len(raw):
            here, seen = at + start, 0
            while raw[here : here + 4] == b"PK\x01\x02" and here + 46 <= end:
                name, extra, comment = struct.unpack_from("<HHH", raw, here + 28)
                entry = at + struct.unpack_from("<I", raw, here + 42)[0]
                if raw[entry : entry + 4] != b"PK\x03\x04":
                    return 0
                here, seen = here + 46 + name + extra + comment, seen + 1
            return end + 22 + note - at if here == end and seen == count else 0
        end = raw.find(b"PK\x05\x06", end + 4)
    return 0


def _gzip(raw: bytes, at: int) -> int:
    engine, pos = zlib.decompressobj(31), at
    try:
        while pos < len(raw) and not engine.eof:
            engine.decompress(raw[pos : pos + 65536])
            pos += 65536
    except zlib.error:
        return 0
    return min(pos, len(raw)) - len(engine.unused_data) - at if engine.eof else 0


def _bmp(raw: bytes, at: int) -> int:
    if len(raw) < at + 26:
        return 0
    size, spare, start, head = struct.unpack_from("<IIII", raw, at + 2)
    return size if not spare and head in (12, 40, 108, 124) and 14 + head <= start <= size <= len(raw) - at else 0


def _crc(data: bytes, width: int, polynomial: int) -> int:
    """Checksum, most significant bit first, from zero."""
    table, crc, mask = _crc_table(width, polynomial), 0, (1 << width) - 1
    for x in data:
        crc = (crc << 8 & mask) ^ table[(crc >> (width - 8)) ^ x]
    return crc


@cache
def _crc_table(width: int, polynomial: int) -> tuple[int, ...]:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for x in range(256):
        c = x << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        out.append(c)
    return tuple(out)


def _flac_header(raw: bytes, pos: int) -> int:
    """Length of a frame's header at ``pos`` if its checksum holds, else 0."""
    if pos + 6 > len(raw) or raw[pos] != 0xFF or raw[pos + 1] & 0xFE != 0xF8:
        return 0
    size, rate, lead = raw[pos + 2] >> 4, raw[pos + 2] & 15, raw[pos + 4]
    number = 1 if lead < 0x80 else next((n for n, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8), (5, 0xF8, 0xFC), (6, 0xFC, 0xFE), (7, 0xFE, 0xFF)) if low <= lead < high), 0)
    end = pos + 4 + number + {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    return end + 1 - pos if number and size and rate != 15 and end < len(raw) and _crc(raw[pos:end], 8, 0x07) == raw[end] else 0


def _flac(raw: bytes, at: int) -> int:
    """Metadata blocks, then frames: one ends where its checksum holds and another begins, or nothing more does."""
    if raw[at + 4 : at + 5] not in (b"\0", b"\x80") or raw[at + 5 : at + 8] != b"\0\0\x22":
        return 0
    pos = at + 4
    while True:
        if pos + 4 > len(raw):
            return 0
        last, pos = raw[pos] & 0x80, pos + 4 + int.from_bytes(raw[pos + 1 : pos + 4])
        if last:
            break
    if pos > len(raw):
        return 0
    total = int.from_bytes(raw[at + 21 : at + 26]) & 0xFFFFFFFFF
    most = int.from_bytes(raw[at + 15 : at + 18]) or 1 << 20  # bytes of the longest frame
    done = 0
    while (head := _flac_header(raw, pos)) and (not total or done < total):
        # the frame's checksum leaves nothing over its own two bytes
        table, crc, end = _crc_table(16, 0x8005), 0, 0
        for i in range(pos, min(len(raw), pos + most)):
            crc = (crc << 8 & 0xFFFF) ^ table[(crc >> 8) ^ raw[i]]
            if not crc and i >= pos + head + 2 and (i + 1 == len(raw) or _flac_header(raw, i + 1) or not total or done + _flac_samples(raw, pos) >= total):
                end = i + 1
                break
        if not end:
            return 0
        done, pos = done + _flac_samples(raw, pos), end
    return pos - at if done and (not total or done >= total) else 0


def _flac_samples(raw: bytes, pos: int) -> int:
    """Samples of the frame at ``pos``."""
    size = raw[pos + 2] >> 4
    if size in (6, 7):
        lead = raw[pos + 4]
        at = pos + 4 + (1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length())
        return int.from_bytes(raw[at : at + size - 5]) + 1
    return 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)


def _ogg(raw: bytes, at: int) -> int:
    """Pages whose checksums hold, up to one that ends the last open stream."""
    pos, open_ = at, set()
    while raw[pos : pos + 4] == b"OggS" and pos + 27 <= len(raw) and raw[pos + 4] == 0:
        n = raw[pos + 26]
        end = pos + 27 + n + sum(raw[pos + 27 : pos + 27 + n])
        if end > len(raw) or _crc(raw[pos : pos + 22] + bytes(4) + raw[pos + 26 : end], 32, 0x04C11DB7) != struct.unpack_from("<I", raw, pos + 22)[0]:
            return 0
        stream = raw[pos + 14 : pos + 18]
        if raw[pos + 5] & 2:
            open_.add(stream)
        elif stream not in open_:
            return 0
        if raw[pos + 5] & 4:
            open_.discard(stream)
        pos = end
        if not open_:
            return pos - at
    return 0


VALID = {"wav": _wav, "png": _png, "gif": _gif, "jpeg": _jpeg, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "bmp": _bmp, "flac": _flac, "ogg": _ogg}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def objects(raw: bytes, found: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, start, length) of the media object at the start and of objects embedded behind it, by start."""
    out, upto = [], {}
    for end, (kind, n) in found.iter(raw.decode("latin-1")):
        start = end - n + 1
        if start >= upto.get(kind, 0) and (length := VALID[kind](raw, start)):
            out.append((kind, start, length))
            upto[kind] = start + length
    return sorted(out, key=lambda x: (x[1], -x[2], x[0]))


def samples(raw: bytes) -> bytes:
    """The data chunk of 8-bit mono PCM."""
    pos = 12
    while pos + 8 <= len(raw):
        size = struct.unpack_from("<I", raw, pos + 4)[0]
        if raw[pos : pos + 4] == b"data":
            return raw[pos + 8 : pos + 8 + size]
        pos += 8 + size + size % 2
    return b""


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """``row``, ``id``, ``absent``, ``n_bytes``, ``declared`` and ``media`` (the stored bytes) of each text."""
    def make():
        return lambda bodies: [{"n_bytes": len(b), "declared": declared, "media": wave(padded(b))} for b in bodies]

    return map_texts(df, id_col, text_col, make, [("n_bytes", T.LongType(), pa.int64()), ("declared", T.StringType(), pa.string()), ("media", T.BinaryType(), pa.binary())])


_FOUND = [
    ("type", T.StringType(), pa.string()), ("corrected", T.BooleanType(), pa.bool_()), ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()),
    ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("n_embedded", T.LongType(), pa.int64()), ("embedded", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string()),
]
#: Declared names of types.
TYPES = {
    "wav": "audio/wav", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip", "bmp": "image/bmp", "flac": "audio/flac", "ogg": "audio/ogg", "unknown": "application/octet-stream",
}


def described(raw: bytes | None, declared: str | None, found: ahocorasick.Automaton) -> dict | None:
    if raw is None:
        return None
    all_ = objects(raw, found)
    kind = all_[0][0] if all_ and all_[0][1] == 0 else "unknown"
    inner = [x for x in all_ if x[1]]
    payload = samples(raw) if kind == "wav" else b""
    data = np.frombuffer(payload, np.uint8)
    level = f"{data.mean():.3f}:{data.std():.3f}" if len(data) else "0:0"
    sha = hashlib.sha256(payload).hexdigest()
    return {
        "type": TYPES[kind], "corrected": TYPES[kind] != declared, "payload_bytes": len(payload), "payload_sha256": sha, "tail_crc32": zlib.crc32(payload[-BLOCK:]),
        "media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest(), "n_embedded": len(inner), "embedded": ",".join(f"{k}:{s}:{n}" for k, s, n in inner), "feature": f"{kind}:{len(payload)}:{level}:{len(inner)}",
    }


def sniff(df: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """The input without the media column, with ``found``: true type, lengths, digests, carved objects and a feature string."""
    rest = [c for c in df.columns if c != media_col]
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(declared_col).alias("declared"), F.col(media_col).alias("media"))
    found = T.StructType([T.StructField(n, t) for n, t, _ in _FOUND])
    kind = pa.struct([(n, t) for n, _, t in _FOUND])

    def run(batches):
        search = automaton()
        for batch in slices(batches, "media"):
            out = [described(m, d, search) for m, d in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, kind)], ["row", "found"])

    return source.mapInArrow(run, T.StructType([source.schema["row"], T.StructField("found", found)]))


def carve(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per embedded object: the input's other columns in ``row``, ``type``, ``start`` and the object's ``bytes``."""
    rest = [c for c in df.columns if c != media_col]
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(media_col).alias("media"))
    schema = T.StructType([source.schema["row"], T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("bytes", T.BinaryType())])

    def run(batches):
        search = automaton()
        for batch in slices(batches, "media"):
            hits = [(i, TYPES[k], s, raw[s : s + n]) for i, raw in enumerate(batch.column("media").to_pylist()) if raw for k, s, n in objects(raw, search) if s]
            if hits:
                at, kinds, starts, parts = zip(*hits, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at)), pa.array(kinds), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], ["row", "type", "start", "bytes"])

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = sniff(store(docs))
    return out.select(
        F.col("row.id").alias("doc_id"), F.col("row.n_bytes").alias("n_bytes"), *[F.col(f"found.{c}").alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "type", "corrected", "embedded")]
    )
