"""URL filter: host and path rules, then a character language-model ratio (operator 10).

URLs that a rule decides train two character models, one of accepted and one of
rejected URLs: variable-order Markov models over an alphabet of 32 symbols, blended
by Witten-Bell weights, so that an unseen context falls back to a shorter one.
Counts of contexts up to ``LONGEST`` symbols are gathered from all decided URLs.
Contexts of up to three symbols (32^4 numbers) are broadcast; all longer ones stay a
table, which the distinct grams of the URLs to be judged are joined to.
Other URLs are judged by the difference of the two log-likelihoods per
character, against a threshold calibrated on a held-out fifth of decided URLs.

The rules see host and path, the models the whole url.

Defined cases: a null url, or one without ``://``, has empty host and path; a null
or empty one scores 0; with no accepted or no rejected URL every score is 0 and the threshold
0, so that the verdict is ``allow``; equal urls get equal verdicts and repeated rows are judged each;
very long urls are read whole; an empty table gives no rows; other columns, whatever their names, are
not carried.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, spread, table

SYMBOLS = 32
START, OTHER = 31, 30
LONGEST = 6  #: symbols of the longest context
SCALE = 1 << 32  #: log-likelihoods are summed as integers, so that their order does not matter
BINS, SPAN = 800, 8.0  #: histogram of held-out scores, from -SPAN to SPAN
#: Rules of the registered query, as (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _alphabet() -> bytes:
    """Symbol of each byte: letters, digits together, the marks of hosts and paths, the rest together."""
    table = bytearray([OTHER] * 256)
    for i, c in enumerate(string.ascii_lowercase):
        table[ord(c)] = table[ord(c.upper())] = i
    for c in string.digits:
        table[ord(c)] = 26
    for i, c in enumerate("/.-"):
        table[ord(c)] = 27 + i
    return bytes(table)


ALPHABET = _alphabet()


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """The input with ``host`` and ``path``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _grams(texts: list[str], n: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Index of each character with its ``n - 1`` predecessors, and the text it belongs to."""
    raw = [(t or "").encode() for t in texts]
    lead = n - 1
    codes = np.frombuffer(b"".join(bytes([START]) * lead + r.translate(ALPHABET) for r in raw), np.uint8).astype(np.int64)
    lengths = np.array([len(r) for r in raw], np.int64)
    index = np.zeros(max(0, len(codes) - lead), np.int64)
    for i in range(n):
        index = index * SYMBOLS + codes[i : i + len(index)]
    first = np.cumsum(lengths + lead) - lengths - lead
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first, lengths)
    return index[at], np.repeat(np.arange(len(raw)), lengths)


def probabilities(counts: np.ndarray) -> np.ndarray:
    """Blended probability of each symbol after each context of three symbols."""
    lower = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(4):
        n = counts.reshape(-1, *[SYMBOLS] * (order + 1)).sum(axis=0)
        total, kinds = n.sum(axis=-1, keepdims=True), (n > 0).sum(axis=-1, keepdims=True)
        lower = np.broadcast_to(lower, n.shape)
        with np.errstate(invalid="ignore", divide="ignore"):
            lower = np.where(total > 0, (n + kinds * lower) / (total + kinds), lower)
    return lower.reshape(-1)


def witten_bell(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """``lower`` blended with ``n`` of ``total`` symbols seen after a context; itself where nothing was."""
    return np.where(total > 0, (n + kinds * lower) / np.maximum(total + kinds, 1), lower)


def gram_ratios(spark: SparkSession, training: DataFrame, grams: DataFrame) -> DataFrame | None:
    """(gram, ratio): the ``SCALE``d log-likelihood difference of each gram's last symbol, from ``body`` and ``good`` of URLs; None if one class has none."""
    lengths = range(4, LONGEST + 2)

    def count(batches):
        for batch in batches:
            texts, good = batch.column("body").to_pylist(), np.array(batch.column("good").to_pylist(), bool)
            for n in lengths:
                index, owner = _grams(texts, n)
                seen, which = np.unique(index, return_inverse=True)
                accepted = np.bincount(which, weights=good[owner], minlength=len(seen)).astype(np.int64)
                rejected = np.bincount(which, minlength=len(seen)) - accepted
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), n, np.int32)), pa.array(seen), pa.array(rejected), pa.array(accepted)], ["n", "gram", "bad", "good"])

    counted = training.mapInArrow(count, "n int, gram long, bad long, good long")
    sums = materialize(spark, counted.groupBy("n", "gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    counts = np.zeros((2, SYMBOLS**4))
    for _, gram, bad, good in sums.filter("n = 4").toLocalIterator():  # at most 32^4 rows
        counts[:, gram] = bad, good
    if not counts.any(axis=1).all():
        return None
    short = spark.sparkContext.broadcast([probabilities(c).astype(np.float32) for c in counts])
    contexts = sums.filter("n > 4").groupBy("n", F.shiftright("gram", 5).alias("context")).agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.when(F.col("bad") > 0, 1)).alias("bad_kinds"), F.count(F.when(F.col("good") > 0, 1)).alias("good_kinds")
    )
    contexts = materialize(spark, contexts)
    known = grams.select("gram").distinct()
    for n in lengths[1:]:
        known = known.withColumn("g", F.col("gram").bitwiseAND(F.lit((1 << 5 * n) - 1))).withColumn("c", F.shiftright("g", 5))
        seen = sums.filter(F.col("n") == n).select(F.col("gram").alias("g"), F.col("bad").alias(f"n{n}0"), F.col("good").alias(f"n{n}1"))
        after = contexts.filter(F.col("n") == n).select(F.col("context").alias("c"), F.col("bad").alias(f"total{n}0"), F.col("good").alias(f"total{n}1"), F.col("bad_kinds").alias(f"kinds{n}0"), F.col("good_kinds").alias(f"kinds{n}1"))
        known = known.join(seen, "g", "left").join(after, "c", "left").drop("g", "c")

    def rate(batches):
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            both = []
            for good in (0, 1):
                p = short.value[good][gram & (SYMBOLS**4 - 1)].astype(float)
                for n in lengths[1:]:
                    p = witten_bell(*(np.nan_to_num(batch.column(f"{c}{n}{good}").to_numpy(zero_copy_only=False).astype(float)) for c in ("n", "total", "kinds")), p)
                both.append(np.log(p))
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.rint((both[1] - both[0]) * SCALE).astype(np.int64))], ["gram", "ratio"])

    return materialize(spark, known.mapInArrow(rate, "gram long, ratio long"))


def calibrated(held: DataFrame) -> float:
    """The threshold of best balanced accuracy over ``score`` and ``good``; 0 if one class has none."""
    at = F.least(F.greatest(((F.col("score") + SPAN) * (BINS / (2 * SPAN))).cast("int"), F.lit(0)), F.lit(BINS - 1))
    rows = held.groupBy(at.alias("bin")).agg(F.count(F.when(~F.col("good"), 1)), F.count(F.when(F.col("good"), 1))).collect()  # BINS rows
    bad, good = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b, x, y in rows:
        bad[b + 1], good[b + 1] = x, y
    if not (bad.sum() and good.sum()):
        return 0.0
    # balanced accuracy of accepting from each bin upwards; the middle of the best bins
    right = np.cumsum(bad) / bad.sum() + 1 - np.cumsum(good) / good.sum()
    return float(np.flatnonzero(right >= right.max() - 1e-12).mean() * (2 * SPAN / BINS) - SPAN)


def filter_urls(spark: SparkSession, df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (null where a rule decides) of every row."""
    rule, verdict = rule_columns(rules)
    split = split_url(df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"))).select("id", "host", "path", F.coalesce("url", F.lit("")).alias("body"), rule.alias("rule"), verdict.alias("verdict"))
    keys = ["k", "l"]  # 128 bits of the text
    split = split.withColumns({"k": F.xxhash64("body"), "l": F.xxhash64(F.lit("text"), "body"), "good": F.col("verdict") == "allow", "held": F.pmod(F.xxhash64(F.lit("urls"), "body"), F.lit(5)) == 0})

    def spell(batches):
        for batch in batches:
            index, owner = _grams(batch.column("body").to_pylist(), LONGEST + 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(owner)) for c in keys), pa.array(index)], [*keys, "gram"])

    asked = split.filter("verdict is null or held").select(*keys, "body").dropDuplicates(keys)
    grams = materialize(spark, asked.mapInArrow(spell, "k long, l long, gram long"))
    ratios = gram_ratios(spark, split.filter("verdict is not null and not held").select("body", "good"), grams)
    if ratios is None:
        return split.select("id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(F.col("verdict").isNull(), 0.0).alias("score"))
    scores = materialize(spark, grams.join(ratios, "gram").groupBy(*keys).agg((F.sum("ratio") / SCALE / F.count(F.lit(1))).alias("score")))
    scored = split.join(scores, keys, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    threshold = calibrated(scored.filter("verdict is not null and held"))
    says = F.coalesce("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("id", "host", "path", "rule", says.alias("verdict"), F.when(F.col("verdict").isNull(), F.col("score")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url"))
    return filter_urls(spark, pages, RULES).withColumnRenamed("id", "page_id")
