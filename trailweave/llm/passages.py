"""Repeated-passage removal by prefix-free parsing (operator 1).

A rolling hash picks *triggers*: the smallest k-byte hash in every span of
``window`` bytes.  All consecutive windows with the same trigger form one
*phrase*; since the trigger depends on the window's bytes alone, equal windows
always lie in phrases with the same trigger, wherever they stand.

* The **parse** is the sequence of phrase ids of each document.  Equal phrases
  are grouped over the corpus (smallest document per phrase): this settles every
  window of a repeated phrase at once and is all that highly repetitive text needs.
  A phrase has at most 64 windows: where ``window`` is so wide that a trigger may have
  more, they are told apart by their distance to the trigger, in steps of 64.
* The **dictionary** holds the distinct phrases that share a trigger but differ,
  which happens at the ends of repeated passages.  For these the suffixes of at
  least ``window`` bytes are sorted (a suffix array over the dictionary) and
  neighbours with a common prefix of ``window`` bytes form one class.  A trigger of
  more than ``HOT`` distinct phrases would put them all into one group: its phrases
  are dealt out window by window instead, by a hash of the window.

Documents are dealt to blocks of bounded size; each block sends one entry per
distinct phrase with its smallest document, so a passage that fills a third of
the corpus costs one entry per block.  All steps of a block read the same exchange and
see its phrases in the same order, so answers are a byte per entry.

Phrases are told apart by 128 bits (48 of the trigger, 80 of the phrase), windows of
phrases that share a trigger by their bytes, windows of hot triggers by two independent
64-bit hashes.

Defined cases: null, empty or short text has no window and is kept whole; a null id
orders before all others; rows with equal id count as one document, whatever their
texts; of equal texts that of the smallest id stays; long texts are parsed in
segments; an empty table gives no rows; other columns, whatever their names, pass
through in ``row``.
"""

from __future__ import annotations

import ctypes
from contextlib import suppress
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, replaced_text, table

TRIGGER = 19  #: bytes of a trigger
SEGMENT = 1 << 17  #: windows worked on at once; positions fit 20 bits
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 4 << 20
ENTRY_BYTES = 24
MASK = 64  #: most windows of a phrase
LOW = np.uint64(0xFFFF)
HOT = 256  #: distinct phrases of a trigger above which its windows are dealt out
NULL_ID = -(1 << 63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@cache
def _tables(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, powers of the base and of its inverse, of one of two independent rolling hashes."""
    rng = np.random.default_rng(20240501 + which)
    letters = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, dtype=np.uint64)
    base = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)[which]
    inverse = pow(base, -1, 1 << 64)
    n = 2 * SEGMENT

    def powers(b: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0] = 1
        done = 1
        while done < n:
            m = min(done, n - done)
            out[done : done + m] = out[:m] * np.uint64(pow(b, done, 1 << 64))
            done += m
        return out

    return letters, powers(base), powers(inverse)


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    """Running sums from which the hash of any span follows."""
    letters, up, _ = _tables(which)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * up[: len(data)], out=total[1:])
    return total


def _spans(total: np.ndarray, first: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    return _mix((total[end] - total[first]) * _tables(which)[2][first])


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    m = 1
    while 2 * m <= w:
        a = np.minimum(a[:-m], a[m:])
        m *= 2
    return np.minimum(a[: len(a) - (w - m)], a[w - m :]) if m < w else a


def phrases(data: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Phrases of concatenated documents (``data`` bytes, exclusive ``ends``).

    Returns 48 bits of the trigger's hash with 16 of the phrase, 64 more of the phrase, first window, last
    window, trigger position.
    """
    empty = (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    n = len(data)
    if n < window:
        return empty
    total = _sums(data, 0)
    kmer = _mix((total[k:] - total[:-k]) * _tables(0)[2][: n - k + 1])
    key = (kmer & ~np.uint64(0xFFFFF)) | np.arange(n - k + 1, dtype=np.uint64)
    at = (_sliding_min(key, window - k + 1) & np.uint64(0xFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(n + 1, np.int8)
    long = ends - starts >= window
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - window + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8)[: len(at)].astype(bool)
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    if window - k >= MASK:
        step = (at - np.arange(len(at))) // MASK
        new[1:] |= valid[1:] & (step[1:] != step[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return empty
    over = valid.copy()
    over[:-1] &= new[1:] | ~valid[1:]
    last = np.flatnonzero(over)
    pos = at[first]
    # triggers are small hashes by choice: mixed again, they spread over all buckets
    trigger = _mix(kmer[pos] + ((pos - first) // MASK).astype(np.uint64))
    extra = _spans(_sums(data, 1), first, last + window, 1)
    return (trigger & ~LOW) | (extra & LOW), _spans(total, first, last + window, 0), first, last, pos


def _walk(bodies: list, window: int, k: int):
    """Phrases of a block in pieces of at most ``SEGMENT`` bytes: (row numbers, window starts within the row, arrays of ``phrases``)."""
    def flush(group):
        data = np.concatenate([g[2] for g in group])
        ends = np.cumsum([len(g[2]) for g in group])
        a, b, first, last, pos = phrases(data, ends, window, k)
        piece = np.searchsorted(ends, first, side="right")
        base = np.concatenate([[0], ends[:-1]])[piece]
        rows = np.array([g[0] for g in group])[piece]
        shift = np.array([g[1] for g in group])[piece] - base
        return rows, shift, a, b, first, last, pos

    group, size = [], 0
    for row, body in enumerate(bodies):
        n = len(body)
        if n < window:
            continue
        for at in range(0, n - window + 1, SEGMENT - window):
            part = body[at : at + SEGMENT - 1]
            if size + len(part) >= SEGMENT:
                if group:
                    yield flush(group)
                group, size = [], 0
            group.append((row, at, part))
            size += len(part)
    if group:
        yield flush(group)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers, with bytes of equal weight side by side: high bytes then compress away."""
    return b"".join(x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns)


def _unpack(raws: list[bytes], *kinds: type) -> list[np.ndarray]:
    parts = [np.frombuffer(raw, np.uint8).reshape(len(kinds), 8, -1).transpose(0, 2, 1) for raw in raws if raw]
    if not parts:
        return [np.empty(0, kind) for kind in kinds]
    return [np.ascontiguousarray(np.concatenate([p[i] for p in parts])).reshape(-1).view(kind) for i, kind in enumerate(kinds)]


def _bucket(a: np.ndarray, n: int) -> np.ndarray:
    """Range of the trigger's hash, so that sorted hashes are sorted by bucket."""
    return ((a >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _changes(a: np.ndarray) -> np.ndarray:
    """True where a sorted array's value differs from the one before; the first always does."""
    return np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]])


def _distinct(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct (a, b), in order, has its smallest d; and which of them each entry is."""
    order = np.lexsort((d, b, a))
    new = _changes(a[order]) | _changes(b[order])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _cuts(key: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, start, end) of the runs of a sorted array."""
    if not len(key):
        return []
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [(int(key[s]), int(s), int(e)) for s, e in zip(at, [*at[1:], len(key)], strict=True)]


def _bodies(table: pa.Table) -> list[np.ndarray]:
    """Views of the texts' bytes, without copies."""
    found = []
    for chunk in table.column("body").chunks:
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        found += [raw[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return found


def _lean(table: pa.Table) -> pa.Table:
    """Gives freed memory back to the system after a group: workers live on between groups."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    return table


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").fill_null(NULL_ID).to_numpy()


@dataclass
class Block:
    """The phrases of a block's documents; all its steps see the distinct ones in the same order."""

    ids: np.ndarray
    bodies: list[np.ndarray]
    row: np.ndarray  #: of each occurrence
    start: np.ndarray  #: of its first window in the document
    count: np.ndarray  #: of its windows
    which: np.ndarray  #: distinct phrase
    lead: np.ndarray  #: of each distinct phrase, the occurrence of smallest document id
    a: np.ndarray
    b: np.ndarray
    d: np.ndarray  #: smallest document id

    @classmethod
    def of(cls, table: pa.Table, window: int, k: int) -> Block:
        ids, bodies = _ids(table), _bodies(table)
        parts = [(rows, first + shift, last - first + 1, a, b) for rows, shift, a, b, first, last, _ in _walk(bodies, window, k)]
        none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
        row, start, count, a, b = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none
        lead, which = _distinct(a, b, ids[row])
        return cls(ids, bodies, row, start, count, which, lead, a[lead], b[lead], ids[row[lead]])

    def text(self, i: int, window: int) -> np.ndarray:
        """The bytes of an occurrence."""
        return self.bodies[self.row[i]][self.start[i] : self.start[i] + self.count[i] + window - 1]

    def windows(self, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """(occurrence, number in it, two independent hashes) of every window of the occurrences ``at``."""
        parts, step = [], max(1, SEGMENT // (MASK + window))
        for s in range(0, len(at), step):
            some = at[s : s + step]
            count = self.count[some]
            data = np.concatenate([self.text(i, window) for i in some.tolist()])
            base = np.cumsum(count + window - 1) - (count + window - 1)
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            pos = np.repeat(base, count) + offset
            parts.append((np.repeat(some, count), offset, *(_spans(_sums(data, which), pos, pos + window, which) for which in (0, 1))))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def codes(self, blobs: dict[int, bytes], n_buckets: int) -> np.ndarray:
        """The answer for each distinct phrase, from those for each bucket."""
        return _aligned(self.a, blobs, n_buckets)


def _aligned(a: np.ndarray, blobs: dict[int, bytes], n_buckets: int) -> np.ndarray:
    """Answers for sorted entries; buckets that sent none have none to give."""
    codes = np.zeros(len(a), np.uint8)
    for key, s, e in _cuts(_bucket(a, n_buckets)):
        if key in blobs:
            codes[s:e] = np.frombuffer(blobs[key], np.uint8)
    return codes


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or adjacent spans of each row; ``width`` is over the largest end."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order] + row[order] * width, end[order] + row[order] * width
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.concatenate([np.ones(min(1, len(row)), bool), start[1:] > reach[:-1]])
    last = np.flatnonzero(np.concatenate([new[1:], np.ones(min(1, len(row)), bool)]))
    return row[new], start[new] - row[new] * width, reach[last] - row[new] * width


#: Answers about a block's entry: an earlier document in another block has it; its bytes, or its windows, are asked for.
EARLIER, ASKED, HOT_ASKED = 1, 2, 3
#: Kinds of rows between steps: answers on phrases, bytes of phrases, windows of hot triggers or answers on them, masks of windows.
CODES, SPELLED, WINDOWS, MASKS = 0, 1, 2, 3
_SENT = {"bucket": pa.int64(), "block": pa.int64(), "kind": pa.int32(), "entries": pa.binary(), "phrases": pa.list_(pa.binary())}
SENT = "bucket long, block long, kind int, entries binary, phrases array<binary>"


def _rows(rows: list[tuple]) -> pa.Table:
    """Rows (bucket, block, kind, entries, phrases) to send."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_SENT)
    return pa.table({name: pa.array(values, kind) for (name, kind), values in zip(_SENT.items(), columns, strict=True)})


def _of_kind(table: pa.Table, kind: int) -> list[dict]:
    return table.filter(pa.compute.equal(table.column("kind"), kind)).to_pylist()


def _elsewhere(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Entries of all blocks (hash, id), which distinct one each is, where those have their smallest document, and that document."""
    a, b, d = _unpack(blobs, np.uint64, np.uint64, np.int64)
    lead, which = _distinct(a, b, d)
    return a, d, which, lead, d[lead][which]


def repeated_passages(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, whole_characters: bool = False) -> DataFrame:
    """Bytes of each document covered by ``window``-byte strings that also start in a document of smaller id.

    Returns ``row`` (the input's other columns), ``id``, ``absent`` (the text is null), ``n_bytes``, ``n_removed``, ``n_spans``,
    ``spans`` (start and exclusive end in bytes) and ``kept`` (the other bytes; with
    ``whole_characters`` without what is left of a character that a span cuts).
    """
    k = min(TRIGGER, window)
    source = packed(df, id_col, text_col)
    size = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    n_buckets = max(1, -(-int(size * 2.1 / (window - k + 2)) * ENTRY_BYTES // BUCKET_BYTES))
    blocks = source.withColumn("block", F.pmod(F.xxhash64("id", "body"), F.lit(n_blocks)))

    def parse(table: pa.Table) -> pa.Table:
        """A block's distinct phrases with their smallest document, by ranges of triggers."""
        x, block = Block.of(table, window, k), table.column("block")[0].as_py()
        return _lean(_rows([(key, block, CODES, _pack(x.a[s:e], x.b[s:e], x.d[s:e]), None) for key, s, e in _cuts(_bucket(x.a, n_buckets))]))

    def group(table: pa.Table) -> pa.Table:
        """For each block that sent phrases of these triggers, an answer for each phrase, in the order sent."""
        blobs = table.column("entries").to_pylist()
        a, d, which, lead, least = _elsewhere(blobs)
        # distinct phrases are in order of their triggers
        new = _changes(a[lead] & ~LOW)
        trigger, of = np.flatnonzero(new), np.cumsum(new) - 1
        lowest, highest = np.minimum.reduceat(d[lead], trigger), np.maximum.reduceat(d[lead], trigger)
        hot = (np.bincount(of) > HOT)[of][which]
        codes = np.where(least < d, EARLIER, np.where((lowest == highest)[of][which], 0, np.where(hot, HOT_ASKED, ASKED))).astype(np.uint8)
        return _lean(_rows(answers(table, blobs, codes, CODES)))

    def answers(table: pa.Table, blobs: list[bytes], codes: np.ndarray, kind: int) -> list[tuple]:
        out, at = [], 0
        for bucket, block, blob in zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), blobs, strict=True):
            mine = codes[at : (at := at + len(blob) // ENTRY_BYTES)]
            if mine.any():
                out.append((bucket, block, kind, mine.tobytes(), None))
        return out

    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        """The bytes of the phrases asked for; of phrases of hot triggers, hashes of their windows; the answers for the last step."""
        got = right.to_pylist()
        if not got or not left.num_rows:
            return _lean(_rows([]))
        x, block = Block.of(left, window, k), left.column("block")[0].as_py()
        codes = x.codes({r["bucket"]: r["entries"] for r in got}, n_buckets)
        out = [(r["bucket"], block, CODES, r["entries"], None) for r in got]
        want = np.flatnonzero(codes == ASKED)
        for key, s, e in _cuts(_bucket(x.a[want], n_buckets)):
            at = want[s:e]
            out.append((key, block, SPELLED, _pack(x.a[at], at, x.d[at]), [x.text(i, window).tobytes() for i in x.lead[at].tolist()]))
        a, b, d = hot_windows(x, x.lead[codes == HOT_ASKED])[:3]
        out += [(n_buckets + key, block, WINDOWS, _pack(a[s:e], b[s:e], d[s:e]), None) for key, s, e in _cuts(_bucket(a, n_buckets))]
        return _lean(_rows(out))

    def hot_windows(x: Block, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct windows of the occurrences ``at`` (hashes, smallest id), and (occurrence, number in it, which) of all."""
        if not len(at):
            return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 4
        i, offset, a, b = x.windows(at, window)
        d = x.ids[x.row[i]]
        lead, which = _distinct(a, b, d)
        return a[lead], b[lead], d[lead], i, offset, which

    def settle(table: pa.Table) -> pa.Table:
        """Suffix array of the dictionary, cut at ``window`` bytes: windows that an earlier document has too."""
        out = [tuple(r[c] for c in _SENT) for r in _of_kind(table, CODES)]
        hot = table.filter(pa.compute.equal(table.column("kind"), WINDOWS))
        if hot.num_rows:
            blobs = hot.column("entries").to_pylist()
            _, d, _, _, least = _elsewhere(blobs)
            out += answers(hot, blobs, np.where(least < d, EARLIER, 0).astype(np.uint8), WINDOWS)
        spelled = _of_kind(table, SPELLED)
        blobs = [r["entries"] for r in spelled]
        a, index, d = _unpack(blobs, np.uint64, np.int64, np.int64)
        owner = np.repeat(np.array([r["block"] for r in spelled], np.int64), [len(x) // ENTRY_BYTES for x in blobs])
        texts = [x for r in spelled for x in r["phrases"]]
        mask = np.zeros(len(a), np.uint64)
        order = np.argsort(a, kind="stable")
        # whole trigger groups, about as many suffixes at a time as a segment has windows
        sizes = np.array([len(t) - window + 1 for t in texts], np.int64)[order]
        bounds = np.append(np.flatnonzero(_changes(a[order] & ~LOW)), len(order))
        done = np.concatenate([[0], np.cumsum(sizes)])
        start = 0
        while start < len(order):
            far = bounds[(bounds > start) & (done[bounds] - done[start] <= SEGMENT)]
            end = int(far[-1]) if len(far) else int(bounds[np.searchsorted(bounds, start, side="right")])
            part = order[start:end]
            data = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
            count = sizes[start:end]
            base = np.cumsum(count + window - 1) - (count + window - 1)
            piece = np.repeat(np.arange(len(part)), count)
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            suffix = np.lib.stride_tricks.sliding_window_view(data, window)[base[piece] + offset]
            _, cls = np.unique(np.ascontiguousarray(suffix).view(f"V{window}").reshape(-1), return_inverse=True)
            least = np.full(len(suffix), np.iinfo(np.int64).max)
            np.minimum.at(least, cls, d[part][piece])
            dup = least[cls] < d[part][piece]
            np.bitwise_or.at(mask, part[piece[dup]], np.uint64(1) << offset[dup].astype(np.uint64))
            start = end
        at = np.flatnonzero(mask)
        at = at[np.argsort(owner[at], kind="stable")]
        out += [(0, key, MASKS, _pack(index[at[s:e]], mask[at[s:e]]), None) for key, s, e in _cuts(owner[at])]
        return _lean(_rows(out))

    result_type = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def cover(left: pa.Table, right: pa.Table) -> pa.Table:
        """Spans that the answers cover, and what they leave of each document."""
        x = Block.of(left, window, k)
        codes = x.codes({r["bucket"]: r["entries"] for r in _of_kind(right, CODES)}, n_buckets)
        mask = np.zeros(len(x.a), np.uint64)
        index, bits = _unpack([r["entries"] for r in _of_kind(right, MASKS)], np.int64, np.uint64)
        np.bitwise_or.at(mask, index, bits)
        first = x.ids[x.row] == x.d[x.which]  # of the smallest document of the block that has the phrase
        whole = np.flatnonzero(~first | (codes[x.which] == EARLIER))
        row, start, end = [x.row[whole]], [x.start[whole]], [x.start[whole] + x.count[whole] + window - 1]
        some = np.flatnonzero(first & (mask[x.which] != 0))
        at, bit = np.nonzero((mask[x.which[some]][:, None] >> np.arange(MASK, dtype=np.uint64)) & np.uint64(1))
        a, _, d, i, offset, which = hot_windows(x, np.flatnonzero(first & (codes[x.which] == HOT_ASKED)))
        known = _aligned(a, {r["bucket"] - n_buckets: r["entries"] for r in _of_kind(right, WINDOWS)}, n_buckets)
        hit = np.flatnonzero((known[which] == EARLIER) | (d[which] < x.ids[x.row[i]]))
        for occurrence, nth in ((some[at], bit), (i[hit], offset[hit])):
            row.append(x.row[occurrence])
            start.append(x.start[occurrence] + nth)
            end.append(x.start[occurrence] + nth + window)
        longest = max(map(len, x.bodies), default=0)
        row, start, end = _merged(np.concatenate(row), np.concatenate(start), np.concatenate(end), longest + 2)
        cuts = np.searchsorted(row, np.arange(len(x.bodies) + 1)).tolist()
        out = []
        for body, s, e in zip(x.bodies, cuts[:-1], cuts[1:], strict=True):
            spans = list(zip(start[s:e].tolist(), end[s:e].tolist(), strict=True))
            at, keep = 0, []
            for low, high in spans:
                keep.append(body[at:low])
                at = high
            kept = b"".join([*keep, body[at:]])
            n_removed = len(body) - len(kept)
            if whole_characters and spans:
                kept = kept.decode("utf-8", "ignore").encode()
            out.append({"n_bytes": len(body), "n_removed": n_removed, "n_spans": len(spans), "spans": [{"start": low, "end": high} for low, high in spans], "kept": kept})
        return _lean(pa.table({"row": left.column("row"), "id": left.column("id"), "absent": left.column("absent"), "found": pa.array(out, result_type)}))

    entries = blocks.groupBy("block").applyInArrow(parse, SENT)
    answered = entries.groupBy("bucket").applyInArrow(group, SENT)
    spelled = blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(spell, SENT)
    settled = spelled.groupBy("bucket").applyInArrow(settle, SENT)
    found = "n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
    schema = T.StructType([source.schema["row"], source.schema["id"], source.schema["absent"], T.StructField("found", T.StructType.fromDDL(found))])
    final = blocks.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(cover, schema)
    return final.select("row", "id", "absent", "found.*")


def remove_repeats(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """The rows of ``df`` with repeated passages cut from the text.

    A character that a cut goes through is dropped whole; ``n_chars``, where it
    is a column, follows the text.
    """
    out = repeated_passages(spark, df, id_col, text_col, window, whole_characters=True)
    return replaced_text(df, out, text_col, F.col("kept").cast("string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
