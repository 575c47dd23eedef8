"""SimHash near-duplicates with vantage-point trees (operator 4).

1. Fingerprints: XXH64 of word shingles vote on 64 bits, one pass, no shuffle.
2. Distinct fingerprints are dealt to shards by a vantage-point tree that is
   built over a bounded sample: each node holds a pivot and a radius, and splits
   space by Hamming distance.  A fingerprint is *at home* in one shard and, by
   the triangle bound, *visits* each shard its ball of ``distance`` bits reaches.
3. In each shard a tree over the fingerprints at home answers all of them and
   all visitors, pruned by the same bound.  Links are merged inside the shard, so a
   shard returns at most one link per fingerprint however dense it is.
4. Links between shards are joined by alternating large-star and small-star
   steps, each written to the shared checkpoint folder.

Exact copies share a fingerprint and never form pairs: their group is an
aggregate (smallest id), joined back by fingerprint.

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; a null id never names a component if the component has an id (else
the component is null); repeated rows stay, each with its component; very long texts
are read whole; an empty table gives no rows; other columns, whatever their names,
are not carried (the pipeline's stage keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, join_by_rank, map_texts, materialize, slices, spread, table, text_or_empty

SEED = 42
SHARD = 32_768  #: distinct fingerprints at home in a shard
SAMPLE_PER_SHARD = 32
MOST_SHARDS = 1 << 14  #: bound of the broadcast tree; more data makes larger shards
LEAF = 96
COPY_SIZE, ALIKE = 5, 0.8  #: the pipeline's near-duplicates: words of a shingle, least Jaccard similarity
NEAR = 2  #: bits of their fingerprints that the trees reach
BANDS, BAND_ROWS = 36, 6
FACTORS, MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64) << np.uint64(1) | np.uint64(1)  #: odd
BLOCK = 16 << 20  #: bytes of candidate texts in a block


def shingle_hashes(body: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each of the lower-cased text's word shingles; a text of fewer words is one shingle."""
    words = body.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hash_(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    return np.array([hash_(joined[s:e], seed) for s, e in zip(starts, ends[size - 1 :], strict=False)], np.uint64)


def fingerprint(body: bytes, size: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of the lower-cased text's word shingles."""
    return voted(shingle_hashes(body, size, seed))


def voted(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``row``, ``id``, ``absent`` and ``fp`` (signed 64-bit) of every row."""
    def make():
        return lambda bodies: [{"fp": _signed(fingerprint(b, size))} for b in bodies]

    return map_texts(df, id_col, text_col, make, [("fp", T.LongType(), pa.int64())])


def _split(points: np.ndarray, pivot: np.uint64) -> tuple[np.ndarray, int]:
    """Distances to the pivot and the radius that halves them; radius -1 if all are equal."""
    d = np.bitwise_count(points ^ pivot).astype(np.int64)
    r = int(np.partition(d, len(d) // 2)[len(d) // 2])
    if r >= d.max():
        r = int(d.max()) - 1
    return d, r if r >= d.min() else -1


def top_tree(sample: np.ndarray, depth: int):
    """Nested (pivot, radius, inside, outside); a leaf is None."""
    if not depth or len(sample) < 2:
        return None
    pivot = sample[len(sample) // 2]
    d, r = _split(sample, pivot)
    if r < 0:
        return None
    return int(pivot), r, top_tree(sample[d <= r], depth - 1), top_tree(sample[d > r], depth - 1)


def route(tree, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, home) of each shard that each fingerprint's ball reaches."""
    out, stack, shard = [], [(tree, np.arange(len(fps)), np.ones(len(fps), bool))], 0
    while stack:
        node, at, home = stack.pop()
        if node is None:
            out.append((at, np.full(len(at), shard), home))
            shard += 1
            continue
        pivot, r, inside, outside = node
        d = np.bitwise_count(fps[at] ^ np.uint64(pivot)).astype(np.int64)
        left, right = d - reach <= r, d + reach > r
        stack.append((inside, at[left], home[left] & (d[left] <= r)))
        stack.append((outside, at[right], home[right] & (d[right] > r)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near_pairs(points: np.ndarray, queries: np.ndarray, reach: int):
    """Yields (point, query) index arrays of all pairs within ``reach`` bits, by a vantage-point tree."""
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF:
            pivot = points[p[len(p) // 2]]
            d, r = _split(points[p], pivot)
            if r >= 0:
                e = np.bitwise_count(queries[q] ^ pivot).astype(np.int64)
                stack.append((p[d <= r], q[e - reach <= r]))
                stack.append((p[d > r], q[e + reach > r]))
                continue
        step = max(1, (1 << 20) // len(p))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            i, j = np.nonzero(np.bitwise_count(points[p][:, None] ^ queries[part][None, :]) <= reach)
            if len(i):
                yield p[i], part[j]


def merged(n: int, pairs) -> np.ndarray:
    """Smallest index of each index's component; links are folded in as they come."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            low, high = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def shard_links(rows: pa.Table, reach: int) -> pa.Table:
    """At most one link (smaller, larger) for each fingerprint of a shard."""
    fps, home = rows.column("fp").to_numpy().view(np.uint64), rows.column("home").to_numpy()
    order = np.argsort(fps, kind="stable")
    fps, home = fps[order], home[order]
    at_home = np.flatnonzero(home)
    root = merged(len(fps), ((at_home[p], q) for p, q in near_pairs(fps[at_home], fps, reach)))
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return pa.table({"a": fps[root[linked]].view(np.int64), "b": fps[linked].view(np.int64)})


def components(spark: SparkSession, links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component."""
    scratch = scratch or Scratch(spark)
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        # large star: neighbours above a node are hung on the smallest node around it
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_by_rank(both.filter("v > u"), low, "u", 2 * edges.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours are hung on the smallest of them
        large = scratch.keep(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_by_rank(large, low, "u", large.count()).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.keep(small)
        # done when each node hangs on one root that hangs on nothing
        open_ = new.groupBy("u").count().filter("count > 1").select("u").union(new.select("v").distinct().join(new.select(F.col("u").alias("v")), "v", "left_semi")).limit(1).count()
        edges = new
        if not open_:
            roots = edges.select("v").distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))


def near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, reach: int = 2) -> DataFrame:
    """``id``, ``fp`` and ``component_id`` (smallest id reachable over links of at most ``reach`` bits) of every row."""
    docs, scratch = materialize(spark, fingerprints(df, id_col, text_col, size).select("id", "fp")), Scratch(spark)
    groups = scratch.keep(docs.groupBy("fp").agg(F.min("id").alias("least")))
    linked = components(spark, near_links(spark, groups, reach), scratch)
    least = linked.join(groups, linked["node"] == groups["fp"]).groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(least, "root").select(F.col("node").alias("fp"), "component")
    named = materialize(spark, groups.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    scratch.drop()
    return docs.join(named, "fp").select("id", "fp", "component_id")


def near_links(spark: SparkSession, groups: DataFrame, reach: int) -> DataFrame:
    """(a, b): links that join the distinct fingerprints (``fp``) of ``groups`` as those within ``reach`` bits do, by vantage-point trees."""
    n = groups.count()
    shards = min(MOST_SHARDS, max(1, -(-n // SHARD)))
    depth = (shards - 1).bit_length()
    sample = groups.select("fp").orderBy(F.xxhash64(F.lit("sample"), "fp"), "fp").limit(SAMPLE_PER_SHARD << depth) if depth else None
    tree = top_tree(np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64), depth) if depth else None
    sent = spark.sparkContext.broadcast(tree)

    def deal(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            at, shard, home = route(sent.value, fps.view(np.uint64), reach)
            yield pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(shard, pa.int64()), pa.array(home)], ["fp", "shard", "home"])

    dealt = groups.select("fp").mapInArrow(deal, "fp long, shard long, home boolean")
    return dealt.groupBy("shard").applyInArrow(lambda t: shard_links(t, reach), "a long, b long")


def bands(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` hashes, each of the minima of the shingles under ``BAND_ROWS`` hash functions."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 11):
        part = shingles[at : at + (1 << 11)]
        np.minimum(least, np.multiply.outer(FACTORS, part ^ (part >> np.uint64(31))).min(axis=1), out=least)
    return (least * MIX).reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * FACTORS[0]


def similar_links(sets: list[np.ndarray], least: float = ALIKE) -> np.ndarray:
    """Smallest index of each set's component over pairs of exact Jaccard similarity ``least`` or more.

    Such a pair shares a shingle among the first n - ceil(``least`` n) + 1 of each set's n, rarest of the
    group first, so only sets that meet there are compared: texts that merely stand in one group cost nothing.
    """
    lengths = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    _, every, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    every = rank[every]
    every = every[np.lexsort((every, owner))]
    ends = np.cumsum(lengths)
    nth = np.arange(len(every)) - np.repeat(ends - lengths, lengths)
    leads = np.flatnonzero(nth <= (lengths - np.ceil(least * lengths - 1e-9))[owner])  # places of the rarest shingles
    order = np.lexsort((owner[leads], every[leads]))
    listed, holders = every[leads][order], owner[leads][order]  # by shingle, the sets that lead with it, in order
    place = np.empty(len(leads), np.int64)
    place[order] = np.arange(len(leads))
    last = np.searchsorted(listed, every[leads], "right")
    until = np.searchsorted(owner[leads], np.arange(len(sets)), "right")
    mark, root, parts, begin = np.zeros(len(every), bool), np.arange(len(sets)), len(sets), 0
    for i, end in enumerate(until):
        low, n = place[begin:end] + 1, last[begin:end] - place[begin:end] - 1
        begin = end
        low, n = low[n > 0], n[n > 0]
        if parts == 1 or not len(n):
            continue
        others = holders[np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)]
        # a set of the same component needs no comparison, nor one of too different a size
        others = np.unique(others[root[others] != root[i]])
        others = others[np.minimum(lengths[others], lengths[i]) >= least * np.maximum(lengths[others], lengths[i])]
        if not len(others):
            continue
        mine = every[ends[i] - lengths[i] : ends[i]]
        mark[mine] = True
        n = lengths[others]
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(ends[others] - n - first, n)
        both = np.add.reduceat(mark[every[at]].astype(np.int64), first)
        mark[mine] = False
        joined = np.unique(root[np.append(others[both >= least * (n + lengths[i] - both)], i)])
        if len(joined) > 1:
            root[np.isin(root, joined)] = joined[0]
            parts -= len(joined) - 1
    return root


def _alike(rows: pa.Table) -> pa.Table:
    """A link (a, b) of each text to the first of its component within the group."""
    keys = rows.column("key").to_numpy()
    root = similar_links([np.unique(shingle_hashes(b, COPY_SIZE)) for b in rows.column("body").to_pylist()])
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": keys[root[linked]], "b": keys[linked]})


def drop_near_duplicates(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: texts linked by Jaccard similarity ``ALIKE`` or more of their sets of five-word shingles.

    Fingerprints of the same shingles are linked within ``NEAR`` bits by the operator's
    vantage-point trees.  Pairs at 0.8 differ in ten or so bits, a reach that leaves
    no tree to prune by, so texts that share one of ``BANDS`` hashes of
    ``BAND_ROWS`` minima are linked as well (by those alone a pair at 0.8 is missed once in 56,000,
    one more alike less often).  Groups of either kind of link are then settled by their exact sets.
    The row of smallest id stays, of equal ids that of smallest hash.  Of rows
    without an id, which none can stand for by name, one stays beside it.
    Null, empty and blank texts are one group.
    """
    source = df.select(F.monotonically_increasing_id().alias("tag"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), text_or_empty(text_col).cast("binary").alias("body"))
    schema = T.StructType([*source.schema, T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sign(batches):
        for batch in slices(batches, "body"):
            hashes = [shingle_hashes(b, COPY_SIZE) for b in batch.column("body").to_pylist()]
            fps = [_signed(voted(x)) for x in hashes]
            sets = [np.unique(x) for x in hashes]
            keys = [_signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in sets]
            signs = [bands(x).view(np.int64) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64()), pa.array(fps, pa.int64()), pa.array(signs, pa.list_(pa.int64()))], [*batch.schema.names, "key", "fp", "bands"])

    docs, scratch = materialize(spark, source.mapInArrow(sign, schema).drop("body")), Scratch(spark)
    texts = scratch.keep(docs.groupBy("key").agg(F.min(F.struct("tag", "fp")).alias("x")).select("key", "x.tag", "x.fp"))  # distinct sets, each with one row
    prints = scratch.keep(texts.groupBy("fp").agg(F.min("key").alias("least")))
    ends = [prints.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_key")) for x in ("a", "b")]
    by_print = near_links(spark, prints, NEAR).join(ends[0], "a").join(ends[1], "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    by_print = by_print.union(texts.join(prints, "fp").filter("least <> key").select("least", "key"))
    signed = docs.select("tag", "bands").join(texts, "tag").select("key", F.explode("bands").alias("band"))
    signed = scratch.keep(signed)
    shared = signed.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
    by_band = signed.join(shared, "band").filter("low <> key").select(F.col("low").alias("a"), F.col("key").alias("b"))
    near = components(spark, by_print.union(by_band), scratch)
    bodies = docs.select("tag", text_or_empty(f"row.`{text_col}`").cast("binary").alias("body"))
    near = scratch.keep(bodies.join(near.join(texts, near["node"] == texts["key"]).select("tag", "key", "root"), "tag").drop("tag"))
    # a large group is cut into blocks, and each pair of blocks meets in one task
    parts = near.groupBy("root").agg(F.ceil(F.sum(F.length("body")) / BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    dealt = near.join(parts, "root").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "key", "body")
    linked = components(spark, dealt.groupBy("root", "p", "q").applyInArrow(_alike, "a long, b long"), scratch)
    rows = docs.select("tag", "key", F.col(f"row.`{id_col}`").alias("id"), F.xxhash64("row").alias("hash"))
    rows = scratch.keep(rows.join(linked, rows["key"] == linked["node"], "left").select("tag", "id", "hash", F.coalesce("root", "key").alias("component")))
    kept = rows.groupBy("component", F.col("id").isNull()).agg(F.min(F.struct("id", "hash", "tag")).alias("least")).select("least.tag")
    gone = materialize(spark, rows.select("tag").join(kept, "tag", "left_anti"))
    scratch.drop()
    return docs.join(gone, "tag", "left_anti").select(*[F.col(f"row.`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = near_duplicates(spark, docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
