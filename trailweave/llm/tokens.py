"""Byte-level BPE encoding and decoding (operator 5).

Bytes are mapped to the characters of byte-level vocabularies, a match of the
splitting pattern goes to the merges of the ``tokenizers`` library, and ids come
back.  Decoding looks each id up in the reversed byte table and joins bytes, so
characters that are split over tokens come out whole.

Each worker keeps the ids of the matches it has seen (a bounded store), so the
merges run once per new match.

Defined cases: null and empty texts have no ids; special tokens in a text are
ordinary text; equal rows give equal results; very long texts are encoded whole; an
empty table gives no rows; other columns, whatever their names, pass through in ``row``.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

from .common import map_texts, spread, table

STORE = 600_000  #: most matches that a worker remembers
LONG = 64  #: longer matches are not remembered
#: Fixed value: the pattern of byte-level splitters.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same matches, found faster, for texts of the characters below.
PLAIN = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile("[^\t\n\r -~À-ÖØ-öø-ſ]")


@cache
def byte_chars() -> tuple[str, ...]:
    """The character of each byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(0x100 + extra))
            extra += 1
    return tuple(out)


@cache
def _to_chars() -> dict[int, str]:
    return dict(enumerate(byte_chars()))


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_to_chars())


class Store(dict):
    """Ids (little-endian unsigned 32-bit) of strings; fills itself.

    Once half of ``STORE`` is held the strings become the older half, which takes the place of the
    previous one; a string found there counts as seen anew, so frequent ones stay.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.encode(text)
        if len(text) <= LONG:
            if len(self) >= STORE // 2:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


def word_encoder(model: models.BPE):
    """Ids of one match by the model's merges, as bytes."""
    merge, space = model.tokenize, byte_chars()[0x20]

    def encode(word: str) -> bytes:
        # of printable ASCII only the space has another character
        chars = word.replace(" ", space) if word.isascii() and word.isprintable() else mapped(word.encode())
        ids = [t.id for t in merge(chars)]
        return struct.pack(f"<{len(ids)}I", *ids)

    return encode


class Cutter:
    """Splits a text into the pattern's matches and encodes each new match by ``word``."""

    def __init__(self, pattern: str, word):
        self.find = regex.compile(pattern).findall
        self.plain = PLAIN.findall if pattern == BYTE_LEVEL else self.find
        self.words = Store(word)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, (self.find if _UNUSUAL.search(text) else self.plain)(text)))


class RankCodec:
    """Ids by a rank file: the pattern's matches are merged separately."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.bytes = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
        self.lengths = np.zeros(max(self.bytes) + 1, np.int64)
        for i, raw in self.bytes.items():
            self.lengths[i] = len(raw)
        ranks = {raw: i for i, raw in self.bytes.items()}
        model = models.BPE({mapped(raw): i for raw, i in ranks.items()}, merges_of(ranks), ignore_merges=True)
        self.encode = Cutter(pattern, word_encoder(model)).encode

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes, body: bytes) -> np.ndarray:
        """Start of each token in code points; a token that starts inside a character has that character's offset."""
        starts = np.cumsum(lengths := self.lengths[np.frombuffer(ids, "<u4")]) - lengths
        leads = (np.frombuffer(body, np.uint8) & 0xC0) != 0x80
        return np.cumsum(leads)[starts] - 1 if len(starts) else starts

    def n_split(self, ids: bytes, body: bytes) -> int:
        """Tokens that start inside a character."""
        if body.isascii():
            return 0
        starts = np.cumsum(lengths := self.lengths[np.frombuffer(ids, "<u4")]) - lengths
        return int(((np.frombuffer(body, np.uint8)[starts] & 0xC0) == 0x80).sum())


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """The merge that made each token: the pair left when merges of lower rank have been applied to its bytes."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((mapped(parts[0]), mapped(parts[1])))
    return out


class FileCodec:
    """Ids by a ``tokenizers`` file, without special tokens; with the plain byte-level splitter each match is encoded once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        parts = json.loads(self.tokenizer.to_str())
        splitter = parts.get("pre_tokenizer") or {}
        plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space") and not parts.get("normalizer")
        self.encode = Cutter(BYTE_LEVEL, word_encoder(self.tokenizer.model)).encode if plain else self.whole

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@cache
def rank_codec(path: str, pattern: str) -> RankCodec:
    return RankCodec(path, pattern)


@cache
def file_codec(path: str) -> FileCodec:
    return FileCodec(path)


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``id``, ``absent``, ``ids`` (little-endian unsigned 32-bit), ``decoded`` bytes and ``n_split`` of each text."""
    def make():
        codec = rank_codec(path, pattern)

        def one(body: bytes) -> dict:
            ids = codec.encode(body.decode("utf-8", "replace"))
            return {"ids": ids, "decoded": codec.decode(ids), "n_split": codec.n_split(ids, body)}

        return lambda bodies: [one(b) for b in bodies]

    return map_texts(df, id_col, text_col, make, [("ids", T.BinaryType(), pa.binary()), ("decoded", T.BinaryType(), pa.binary()), ("n_split", T.LongType(), pa.int64())])


def token_offsets(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``id``, ``absent`` and arrays ``ids`` and ``offsets`` (code points) of each text."""
    def make():
        codec = rank_codec(path, pattern)

        def one(body: bytes) -> dict:
            ids = codec.encode(body.decode("utf-8", "replace"))
            return {"ids": np.frombuffer(ids, "<u4").tolist(), "offsets": codec.offsets(ids, body).tolist()}

        return lambda bodies: [one(b) for b in bodies]

    longs = T.ArrayType(T.LongType())
    return map_texts(df, id_col, text_col, make, [("ids", longs, pa.list_(pa.int64())), ("offsets", longs, pa.list_(pa.int64()))])


def decode_ids(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The input with ``decoded``: the bytes of an array of ids; unknown ids and nulls give no bytes."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        table = rank_codec(path, pattern).bytes
        for batch in batches:
            raw = [b"".join(table.get(i, b"") for i in ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select(F.col("id").alias("doc_id"), n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


__all__ = ["encode_texts", "token_offsets", "decode_ids", "query"]
