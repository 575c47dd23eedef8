"""Line-first quality rules (operator 7).

Each line is judged on its own: lines without sentence punctuation, navigation
lines, boilerplate, lines of symbols and shouted lines fail and are removed.
A document goes if its base statistics fail or if removal costs it too much text.

Defined cases: null, empty and blank texts have no words and fail; a line
without a word neither counts nor fails; equal rows give equal results; very long
texts are read whole; an empty table gives no rows; other columns, whatever their
names, pass through in ``row``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, replaced_text, spread, table

WINDOW = 8
MOST_LOST = 0.4  #: share of word characters that removal may cost
SYMBOLS = b"#*$%&|<>"
#: Fixed value: phrases of page furniture, lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "click here", "read more", "sign up", "log in", "subscribe to",
    "share this", "follow us", "powered by", "copyright ©", "©", "javascript", "lorem ipsum",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_END = re.compile(r"""[.!?…。！？:;]["'”’)\]]*$""")
_BLANK = " \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window that stands in the text twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolling = np.zeros(n, np.uint64)
    for i in range(window):
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    order = np.argsort(rolling, kind="stable")
    same = rolling[order[1:]] == rolling[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    covered = np.zeros(len(words), bool)
    for i in np.flatnonzero(maybe).tolist():  # equal hashes are checked by the words
        key = tuple(words[i : i + window])
        if key in seen:
            covered[i : i + window] = True
            covered[seen[key] : seen[key] + window] = True
        else:
            seen[key] = i
    return int(covered.sum())


def line_fault(line: str) -> str:
    """The first rule that a line with words breaks, or nothing."""
    words = line.split()
    n = len(words)
    bars = line.count("|") + line.count("»") + line.count("•")
    if bars >= 3 and 3 * bars >= n // 2:
        return "navigation"
    marks = sum(map(line.count, "#*$%&|<>{}~^"))
    if 2 * marks > n and marks >= 3:
        return "symbols"
    low = line.lower()
    if n <= 25 and _BOILERPLATE.search(low):
        return "boilerplate"
    if line.isupper() and n >= 5 and line.count("!") * 3 >= n:
        return "shouting"
    if n >= 10 and len(set(words)) * 5 <= n:
        return "repetition"
    if n <= 3 and len(line.rstrip()) < 40 and not _END.search(line.rstrip()):
        return "punctuation"
    return ""


def judged(body: bytes) -> dict:
    words = body.split()
    text = body.decode("utf-8", "replace")
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    chars = len(text) - sum(map(text.count, _BLANK))
    n_words, repeats = len(words), repeated_words(words)
    failed = n_words < 20 or 100 * repeats > 30 * n_words
    lost, cleaned = 0, []
    for line in lines:
        if line_fault(line):
            lost += len(line) - sum(map(line.count, _BLANK))
        else:
            cleaned.append(line)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": sum(map(body.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeats,
        "base_failed": failed, "lost_chars": lost, "kept": not failed and lost <= MOST_LOST * chars, "cleaned": "\n".join(cleaned),
    }


_FIELDS = [
    *((n, T.LongType(), pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    ("base_failed", T.BooleanType(), pa.bool_()),
    ("lost_chars", T.LongType(), pa.int64()),
    ("kept", T.BooleanType(), pa.bool_()),
]


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``id``, ``absent``, base statistics, ``lost_chars`` and ``kept`` of each text."""
    def make():
        names = [f[0] for f in _FIELDS]
        return lambda bodies: [{n: r[n] for n in names} for r in map(judged, bodies)]

    return map_texts(df, id_col, text_col, make, _FIELDS)


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``df`` without their failing lines."""
    def make():
        return lambda bodies: [{"kept": r["kept"], "cleaned": r["cleaned"]} for r in map(judged, bodies)]

    out = map_texts(df, id_col, text_col, make, [("kept", T.BooleanType(), pa.bool_()), ("cleaned", T.StringType(), pa.string())])
    return replaced_text(df, out.filter("kept"), text_col, F.col("cleaned"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judge(docs).select(F.col("id").alias("doc_id"), *[f[0] for f in _FIELDS])
