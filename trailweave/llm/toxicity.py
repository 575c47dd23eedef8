"""Toxicity by a learned, weighted lexicon (operator 3).

Texts and lexicon are folded alike: lower case, homoglyphs and digit
substitutions become the letters they stand for.  Lexicon entries are word
stems with log-odds weights, learned from labelled rows; an Aho-Corasick
automaton finds them at word starts, the longest entry of a word counts, and
words that are, or stand in, an exception phrase (a word or word pair that
labelled clean texts use) do not.  A logistic curve over the summed weights and
their density per hundred words gives the score.

How heavy a stem has to be is chosen inside the training rows: each third of
them is scored by lexicons of the other two.

Learning uses at most ``sample`` labelled rows (by hash of the id; a documented
bound, so that the lexicon and what the driver sees stay bounded: a stem needs a
400th of the toxic rows); scoring covers every row and whole texts.  Labels,
language, source and id are not inputs of a score.

Defined cases: null and empty texts have no hits and get the score of such a
text; without toxic or without clean labels every score is 0; an id with several
labels counts as toxic if one of them is; equal texts get equal scores and
repeated rows are scored each; stems of equal weight stay both; long texts are
read whole, about 4 MB of text at a time; an empty table gives no rows; other
columns, whatever their names, pass through in ``row``.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, materialize, slices, spread, table, text_or_empty

SAMPLE = 20_000  #: most labelled rows to learn from
STEM = range(4, 11)  #: lengths of stems
THRESHOLD = 0.7
CLEAR = (0.6, 0.9, 1.2, 1.6, 2.2)  #: least weights of a stem to choose from
PARTS = 3  #: parts of the training rows that are scored by lexicons of the others

#: Letters that look like, or are typed for, other letters.
FOLDS = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
_FOLD = str.maketrans(FOLDS)
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case with homoglyphs and digit substitutions undone; full-width letters too."""
    text = text.lower().translate(_FOLD)
    if not text.isascii() and re.search("[！-～]", text):
        text = "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in text).lower().translate(_FOLD)
    return text


class Lexicon:
    """Stems with weights, and words or word pairs (space-joined) that do not count."""

    def __init__(self, stems: dict[str, float], exceptions: set[str], curve: tuple[float, float, float]):
        self.stems, self.exceptions, self.curve = stems, exceptions, curve
        self.automaton = None

    def __getstate__(self):
        return self.stems, self.exceptions, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def hits(self, text: str) -> list[tuple[int, str]]:
        """(start, stem) of the longest stem at each word start in folded text."""
        if not self.stems:
            return []
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for stem in self.stems:
                self.automaton.add_word(stem, stem)
            self.automaton.make_automaton()
        longest: dict[int, str] = {}
        for end, stem in self.automaton.iter(text):
            start = end - len(stem) + 1
            if (not start or not text[start - 1].isalnum()) and len(stem) > len(longest.get(start, "")):
                longest[start] = stem
        return sorted(longest.items())

    def phrases(self, text: str, start: int) -> list[str]:
        """The word at ``start`` in folded text, with the word before it and with the word after it."""
        word = _WORD.match(text, start)
        stop = start
        while stop and not _WORD.match(text, stop - 1):
            stop -= 1
        begin = stop
        while begin and _WORD.match(text, begin - 1):
            begin -= 1
        after = _WORD.search(text, word.end())
        found = [word[0]]
        if stop > begin:
            found.append(f"{text[begin:stop]} {word[0]}")
        if after:
            found.append(f"{word[0]} {after[0]}")
        return found

    def features(self, text: str) -> tuple[float, float, int]:
        """Log of the summed weights, log of their density per hundred words, and the number of hits."""
        return self.folded_features(fold(text))

    def folded_features(self, text: str) -> tuple[float, float, int]:
        total, n = 0.0, 0
        for start, stem in self.hits(text):
            if not (self.exceptions and not self.exceptions.isdisjoint(self.phrases(text, start))):
                total += self.stems[stem]
                n += 1
        return (math.log1p(total), math.log1p(100 * total / (text.count(" ") + text.count("\n") + 1)), n) if n else (0.0, 0.0, 0)

    def score(self, features: tuple[float, float, int]) -> float:
        if not self.stems:
            return 0.0
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * features[0] + c * features[1]))))


def _stems(text: str) -> set[str]:
    found = set()
    for word in set(_WORD.findall(fold(text))):
        found.update(word[:n] for n in STEM if n <= len(word))
        if len(word) < STEM[0]:
            found.add(word)
    return found


def _counted(df: DataFrame, count) -> DataFrame:
    """(key, toxic, part, n): rows of ``df`` (body, toxic, part) by the keys that ``count(text)`` gives."""
    def run(batches):
        total: Counter = Counter()
        for batch in slices(batches, "body"):
            for text, toxic, part in zip(*(batch.column(c).to_pylist() for c in ("body", "toxic", "part")), strict=True):
                total.update((key, toxic, part) for key in count(text))
        keys = list(total)
        columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([total[k] for k in keys], pa.int64())], ["key", "toxic", "part", "n"])

    return df.mapInArrow(run, "key string, toxic int, part int, n long").groupBy("key", "toxic", "part").agg(F.sum("n").alias("n"))


def _weights(toxic: np.ndarray, clean: np.ndarray, bad: float, good: float) -> np.ndarray:
    """Log-odds less two standard errors: what may be chance weighs nothing."""
    b, g = toxic + 0.1, clean + 0.5
    return np.log(b / (bad + 0.2)) - np.log(g / (good + 1)) - 2 * np.sqrt(1 / b + 1 / g)


def _selected(keys: list[str], weights: np.ndarray, clear: float) -> dict[str, float]:
    """Stems over ``clear``; one stands for its extensions unless an extension is clearly more telling."""
    weight = {k: w for k, w in zip(keys, weights.tolist(), strict=True) if w > clear}
    stems: dict[str, float] = {}
    for key in sorted(weight, key=lambda s: (len(s), s)):
        shorter = max((stems[key[:n]] for n in range(1, len(key)) if key[:n] in stems), default=None)
        if shorter is None or weight[key] > shorter + 1.0:
            stems[key] = weight[key]
    return stems


def _curve(rows: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression (ridge, Newton steps) of the label on two features."""
    data = rows.reshape(-1, 3)
    x, y = np.column_stack([np.ones(len(data)), data[:, 0], data[:, 1]]), data[:, 2]
    w = np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return tuple(float(v) for v in w)


def _judged(rows: np.ndarray) -> tuple[float, float]:
    """Balanced accuracy at the threshold, and log-likelihood, of the curve that fits ``rows``."""
    a, b, c = _curve(rows)
    p, toxic = 1 / (1 + np.exp(-np.clip(a + b * rows[:, 0] + c * rows[:, 1], -30, 30))), rows[:, 2] == 1
    accuracy = ((p >= THRESHOLD)[toxic].mean() + (p < THRESHOLD)[~toxic].mean()) / 2
    return round(float(accuracy), 9), float(np.log(np.where(toxic, p, 1 - p)).mean())


def learn(spark: SparkSession, df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Lexicon:
    """A lexicon from the rows of ``labels`` (id, ``toxic``) that are to be learned from."""
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = min(1.0, 0.9 * sample / n) if n else 1.0
    hashed = lambda word: F.xxhash64(F.lit(word), id_col)
    chosen = known.filter(F.pmod(hashed("toxicity"), F.lit(1 << 20)) < int(share * (1 << 20))).withColumn("part", F.pmod(hashed("part"), F.lit(PARTS)).cast("int"))
    # at most `sample` rows of three numbers: small enough to send to every executor
    rows = df.select(id_col, text_or_empty(text_col).alias("body")).join(F.broadcast(chosen), id_col).select("body", "toxic", "part")
    rows = materialize(spark, rows.repartition(max(8, spark.sparkContext.defaultParallelism)))
    sizes = np.zeros((2, PARTS))
    for r in rows.groupBy("toxic", "part").count().collect():
        sizes[r["toxic"], r["part"]] = r["count"]
    good, bad = sizes.sum(axis=1)
    if not bad or not good:
        return Lexicon({}, set(), (0.0, 0.0, 0.0))

    least = max(3, int(bad) // 400)
    often = _counted(rows.filter("toxic = 1"), _stems).groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)).alias(f"n{p}") for p in range(PARTS)]).filter(F.col("n") >= least)
    # stems of a 400th of the toxic rows each: at most 400 times as many as an average row has
    found = sorted(often.collect(), key=lambda r: r["key"])
    keys, at = [r["key"] for r in found], {r["key"]: i for i, r in enumerate(found)}
    toxic = np.array([[r[f"n{p}"] for p in range(PARTS)] for r in found], float).reshape(-1, PARTS)
    clean = np.zeros_like(toxic)
    wanted = spark.sparkContext.broadcast(frozenset(keys))
    for r in _counted(rows.filter("toxic = 0"), lambda text: _stems(text) & wanted.value).collect():
        clean[at[r["key"]], r["part"]] = r["n"]

    def lexicons(part: int | None) -> list[Lexicon]:
        """For each of ``CLEAR``, what the rows outside ``part`` teach."""
        others = [p for p in range(PARTS) if p != part]
        seen = toxic[:, others].sum(axis=1)
        weights = np.where(seen >= least, _weights(seen, clean[:, others].sum(axis=1), sizes[1, others].sum(), sizes[0, others].sum()), -np.inf)
        return [Lexicon(_selected(keys, weights, c), set(), (0.0, 0.0, 0.0)) for c in CLEAR]

    def measured(by_part: list[list[Lexicon]]) -> np.ndarray:
        """(row, lexicon, feature or label): at most ``sample`` rows of a few numbers."""
        sent = spark.sparkContext.broadcast(by_part)

        def run(batches):
            for batch in slices(batches, "body"):
                texts, parts = (batch.column(c).to_pylist() for c in ("body", "part"))
                values = [[x for lexicon in sent.value[p] for x in lexicon.folded_features(t)[:2]] for t, p in zip(map(fold, texts), parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column("toxic").cast(pa.float64())], ["x", "y"])

        got = rows.mapInArrow(run, "x array<double>, y double").collect()
        x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got])
        return np.concatenate([x.reshape(len(y), -1, 2), np.broadcast_to(y[:, None, None], (len(y), x.shape[1] // 2, 1))], axis=2)

    trials = measured([lexicons(p) for p in range(PARTS)])
    best = max(range(len(CLEAR)), key=lambda c: _judged(trials[:, c]))
    stems = lexicons(None)[best].stems
    first = spark.sparkContext.broadcast(Lexicon(stems, set(), (0.0, 0.0, 0.0)))

    def phrases(text):
        text = fold(text)
        return {p for start, _ in first.value.hits(text) for p in first.value.phrases(text, start)}

    by_class = _counted(rows, phrases).groupBy("key").agg(*[F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(c) for t, c in ((0, "good"), (1, "bad"))])
    exceptions = {r["key"] for r in by_class.filter((F.col("good") >= 3) & (F.col("good") * float(bad) > 4 * F.col("bad") * float(good))).collect()}
    final = Lexicon(stems, exceptions, (0.0, 0.0, 0.0))
    final.curve = _curve(measured([[final]] * PARTS)[:, 0])
    return final


def score(spark: SparkSession, df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``id``, ``absent``, ``score`` and ``hits`` of every row."""
    sent = spark.sparkContext.broadcast(lexicon)

    def make():
        lexicon = sent.value

        def work(bodies: list[bytes]) -> list[dict]:
            found = [lexicon.features(b.decode("utf-8", "replace")) for b in bodies]
            return [{"score": lexicon.score(f), "hits": f[2]} for f in found]

        return work

    return map_texts(df, id_col, text_col, make, [("score", T.DoubleType(), pa.float64()), ("hits", T.LongType(), pa.int64())])


def _fold_of(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def learn_from_folds(spark: SparkSession, df: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon that never saw labels of the held-out third."""
    return learn(spark, df, labels.select("doc_id", "toxic").filter(_fold_of("doc_id") != 1))


def drop_toxic(spark: SparkSession, df: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose score stays under the threshold."""
    lexicon = spark.sparkContext.broadcast(learn_from_folds(spark, df, labels))

    def run(batches):
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            keep = [lexicon.value.score(lexicon.value.features(t or "")) < THRESHOLD for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = score(spark, docs, learn_from_folds(spark, docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), (_fold_of("id") == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")
