"""Deterministic sharded WARC writer and reader (operator 8).

Writing: records are range-sorted by id; ranges come from exact histograms of
bytes over ids, whose heavy bins are divided again until each holds at most a shard
or one id, so equal input gives equal shards, wherever its ids lie.  An id with more than a
shard's bytes is spread over several shards by a hash of the payload.  Each task writes one shard in
id order, one gzip member per record, and starts a new file when the compressed
size passes ``roll``.  Headers and digests are made anew.  A file is written under a
temporary name that holds the attempt and renamed when complete, so a task that runs
twice leaves the same files; the manifest of files, digests and ranges is
committed last, and readers go by the manifest alone.

Of records with equal payloads the one with the smallest id is a response, others
are revisits that refer to it.  This is decided on digests; payloads are shuffled
once, with the decisions, by range.  Digests of a thousandth of all rows or more are
joined by broadcast (at most a thousand), so one frequent payload does not meet in one task.

Defined cases: a null payload is empty; a null id orders before all others and
is read back as null; rows equal in id and payload are all responses if none has
a smaller id; a null url leaves out the target; control characters in a url are
percent-encoded; very long payloads are records of their own size; other
columns, whatever their names, are not carried; an empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_dir, spread, table

SHARD_BYTES = 16 << 20  #: payload bytes of a shard
ROLL = 32 << 20  #: compressed bytes at which a file ends
BINS = 4096  #: most bins of one range in one pass of the histogram
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
LEAST_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string, first_id long, last_id long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(name: str, url: str | None, payload: bytes, refers: str | None, date: str) -> bytes:
    """An uncompressed response record, or a revisit record if ``refers`` names a record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers:
        head += [f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(id_: int, digest_: str, nth: int = 0) -> str:
    """The record of a payload's ``nth`` row with an id."""
    return f"urn:x-page:{'null' if id_ == LEAST_ID else id_}:{digest_}:{nth}"


def _divided(sizes: DataFrame, cells: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """Bytes by (number of cell, bin) of cells (first id, width, step of a bin); ``sizes`` has ``id`` and ``size``."""
    start = np.array([c[0] for c in cells], np.int64)
    width, step = (np.array([c[i] for c in cells], np.uint64) for i in (1, 2))

    def run(batches):
        for batch in batches:
            ids, weights = batch.column("id").to_numpy(), batch.column("size").to_numpy()
            cell = np.searchsorted(start, ids, side="right") - 1
            far = ids.view(np.uint64) - start[cell].view(np.uint64)  # exact however far apart
            inside = (cell >= 0) & (far < width[cell])
            key, which = np.unique(cell[inside] * BINS + (far[inside] // step[cell[inside]]).astype(np.int64), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(which, weights[inside], len(key)).astype(np.int64))], ["key", "weight"])

    rows = sizes.mapInArrow(run, "key long, weight long").groupBy("key").agg(F.sum("weight")).collect()  # bins that hold rows
    return {divmod(key, BINS): weight for key, weight in rows}


def shards(sizes: DataFrame, shard_bytes: int) -> list[tuple[int, int, int]]:
    """(first id, number of the shard, shards that share the id) of ranges of at most about ``shard_bytes``, by id.

    As many rows as there are shards, and some bins beside them, reach the driver.
    """
    low, high, total = sizes.filter(F.col("id") != LEAST_ID).agg(F.min("id"), F.max("id"), F.sum("size")).first()
    no_id = sizes.filter(F.col("id") == LEAST_ID).agg(F.sum("size")).first()[0]
    done = [(LEAST_ID, 1, no_id)] if no_id else []
    open_ = [(low, high - low + 1, total)] if total else []
    while open_:
        heavy = [c for c in open_ if c[2] > shard_bytes and c[1] > 1]
        done += [c for c in open_ if c[2] <= shard_bytes or c[1] == 1]
        cells = [(first, width, -(-width // min(BINS, max(64, -(-4 * weight // shard_bytes))))) for first, width, weight in heavy]
        open_ = []
        if cells:
            for (i, n), weight in _divided(sizes, cells).items():
                first, width, step = cells[i]
                open_.append((first + n * step, min(step, width - n * step), weight))
            open_.sort()
    out, shard, filled = [], 0, 0
    for first, _, weight in sorted(done):
        parts = max(1, -(-weight // shard_bytes))
        if out and (filled + weight > shard_bytes or parts > 1):
            shard, filled = shard + out[-1][2], 0
        if not out or not filled:
            out.append((first, shard, parts))
        filled += weight
    return out


class Files:
    """Files of one shard at a time, under temporary names until they are whole."""

    def __init__(self, folder: str, roll: int, attempt: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.roll, self.attempt = roll, attempt
        self.out = None

    def add(self, shard: int, id_: int, raw: bytes) -> Iterator[tuple]:
        if self.out and (shard != self.shard or self.size >= self.roll):
            yield self.close()
        if not self.out:
            self.nth = self.nth + 1 if getattr(self, "shard", None) == shard else 0
            self.shard, self.size, self.records, self.first, self.sha = shard, 0, 0, id_, hashlib.sha256()
            self.final = f"shard-{shard:06d}-{self.nth:04d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.final}.{self.attempt}.tmp"
            self.out = self.store.open_output_stream(self.temporary, compression=None)
        member = gzip.compress(raw, LEVEL, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        self.last = id_

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        self.store.move(self.temporary, f"{self.folder}/{self.final}")
        return self.final, self.records, self.size, self.sha.hexdigest(), self.first, self.last


def write_archives(spark: SparkSession, df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, roll: int = ROLL, date: str = DATE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write a record per row into ``folder`` and return the committed manifest, one row per file."""
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("hash", F.xxhash64("payload"))
    narrow = materialize(spark, rows.select("id", (F.octet_length("payload") + 512).cast("long").alias("size"), F.unhex(F.sha2("payload", 256)).alias("key"), "hash"))
    ranges = shards(narrow, shard_bytes)
    edges = spark.sparkContext.broadcast(np.array(ranges, np.int64).reshape(-1, 3))  # a row per shard at most
    n_shards = ranges[-1][1] + ranges[-1][2] if ranges else 1

    @F.pandas_udf("int")
    def shard_of(id_: pd.Series, hash_: pd.Series) -> pd.Series:
        first, shard, parts = edges.value.T
        at = np.searchsorted(first, id_.to_numpy(), side="right") - 1
        return pd.Series((shard[at] + hash_.to_numpy() % parts[at]).astype(np.int32))

    # decisions, on digests: only rows that repeat an earlier payload are joined
    keys = narrow.filter(F.col("size") >= least + 512).groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("final"), F.count(F.lit(1)).alias("n")).filter("first <> final")
    often = F.col("n") >= max(1, narrow.count() // 1000)
    known = narrow.join(F.broadcast(keys.filter(often).select("key", "first")), "key", "left")  # at most a thousand rows
    rare = known.filter("first is null").drop("first").join(keys.filter(~often).select("key", "first"), "key")
    revisits = known.filter("first is not null").unionByName(rare).filter(F.col("id") != F.col("first")).select("id", "key", "first", "hash").distinct()
    pages = rows.select("id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first"), "hash")
    marks = revisits.select("id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("key").alias("payload"), "first", "hash")
    dealt = pages.unionByName(marks).withColumn("shard", shard_of("id", "hash")).drop("hash").repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "id", "kind", "payload", "url")
    target = folder.rstrip("/")
    store, path = fs.FileSystem.from_uri(target)
    store.create_dir(path, recursive=True)

    def run(batches):
        context = TaskContext.get()
        files = Files(target, roll, f"{context.partitionId()}-{context.taskAttemptId()}")
        at, last, nth, earlier, done = None, None, 0, {}, []
        for batch in batches:
            for id_, kind, url, payload, first, shard in zip(*(batch.column(c).to_pylist() for c in ("id", "kind", "url", "payload", "first", "shard")), strict=True):
                if id_ != at:
                    at, last, earlier = id_, None, {}
                if not kind:
                    earlier[payload] = first
                    continue
                nth, last = (nth + 1, payload) if payload == last else (0, payload)
                refers, named = earlier.get(hashlib.sha256(payload).digest()) if earlier else None, digest(payload)
                done += files.add(shard, id_, record(_name(id_, named, nth), url, payload, None if refers is None else _name(refers, named), date))
        if files.out:
            done.append(files.close())
        columns = list(zip(*done, strict=True)) if done else [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "records", "bytes", "sha256", "first_id", "last_id"])

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{target}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{target}/_manifest")


def members(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    """Uncompressed gzip members of a file, one after the other."""
    with store.open_input_stream(path, compression=None) as stream:
        engine, parts = zlib.decompressobj(31), []
        while chunk := stream.read(1 << 20):
            while chunk:
                parts.append(engine.decompress(chunk))
                chunk = engine.unused_data
                if engine.eof:
                    yield b"".join(parts)
                    engine, parts = zlib.decompressobj(31), []
        if parts and b"".join(parts):
            raise ValueError(f"{path} ends inside a record")


def parsed(raw: bytes) -> dict:
    """Fields of a record; lengths and digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != n or digest(payload) != named):
        raise ValueError(f"damaged payload {fields.get('WARC-Record-ID')}")
    number = lambda name: None if name is None or (x := name.strip("<>").split(":")[2]) == "null" else int(x)
    return {"id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": n, "payload_digest": named, "refers_to": number(fields.get("WARC-Refers-To"))}


READ = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the files that the manifest in ``folder`` names."""
    target = folder.rstrip("/")
    manifest = spark.read.schema(MANIFEST).parquet(f"{target}/_manifest")
    kinds = {"id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}

    def run(batches):
        store, path = fs.FileSystem.from_uri(target)
        for batch in batches:
            for name, n in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows = [parsed(raw) for raw in members(store, f"{path}/{name}")]
                if len(rows) != n:
                    raise ValueError(f"{name} holds {len(rows)} of {n} records")
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], list(kinds))

    # a task per shard
    shard = F.regexp_extract("file", r"shard-(\d+)", 1).cast("int")
    last = manifest.agg(F.max(shard)).first()[0] or 0
    return manifest.select("file", "records", shard.alias("shard")).repartitionById(last + 1, F.col("shard")).mapInArrow(run, READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    folder = scratch_dir(spark)
    write_archives(spark, pages, folder)
    return read_archives(spark, folder).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
