"""Statistics of whole texts, shared by the quality rules and the classifier.

Words are maximal runs of characters other than space and the controls 9-13.
A null text is an empty one. Columns of any name besides ``text`` and the added
ones pass unchanged.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_MARKS = string.punctuation.encode()
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))

#: Integer statistics of a text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics of the classifier's vector.
SHAPES = ("word_length", "symbols", "upper", "digits", "repeats", "duplicate_lines", "doubled")
#: Shares of short texts are drawn towards usual values, as if so many usual words came before.
PRIOR_WORDS, PRIOR_LENGTH = 50, 5
#: Statistics of the quality rules' vector; none of them is constant over ordinary prose.
STYLES = ("log_word_length", "log_word_length_spread", "marks", "upper", "variety")


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, n, done = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            n += i + 3 - max(i, done)
            done = i + 3
    return n


def _without(data: bytes, of: bytes) -> int:
    """How many bytes of ``data`` are among ``of``."""
    return len(data) - len(data.translate(None, of))


def _arc(part: float, whole: float) -> float:
    """Variance-stabilised share."""
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def shapes(counts: tuple[int, ...], data: bytes, words: list[bytes], n_lines: int) -> list[float]:
    """``SHAPES`` of a text."""
    n, chars, symbols, dup_lines, repeats = counts
    doubled = sum(map(eq, words, words[1:]))
    chars_, n_ = chars + PRIOR_LENGTH * PRIOR_WORDS, n + PRIOR_WORDS
    return [
        math.log(chars_ / n_), _arc(symbols, chars_), _arc(_without(data, _UPPER), chars_), _arc(_without(data, _DIGITS), chars_),
        _arc(repeats, n_), _arc(dup_lines, n_lines + 3), _arc(doubled, n_),
    ]


def styles(counts: tuple[int, ...], data: bytes, words: list[bytes], n_lines: int) -> list[float]:
    """``STYLES`` of a text: mean and spread of the log of word lengths, shares of punctuation and capitals among the
    characters of words, and the log of the number of different words over that of words."""
    n, chars = counts[:2]
    if not n:
        return [0.0] * len(STYLES)
    lengths = Counter(map(len, words))
    mean = sum(k * math.log(size) for size, k in lengths.items()) / n
    spread = math.sqrt(sum(k * (math.log(size) - mean) ** 2 for size, k in lengths.items()) / n)
    variety = math.log(len(set(words))) / math.log(n) if n > 1 else 1.0
    return [mean, spread, _arc(_without(data, _MARKS), chars), _arc(_without(data, _UPPER), chars), variety]


Vector = Callable[[tuple[int, ...], bytes, list[bytes], int], list[float]]


def text_stats(text: str | None, vector: Vector = shapes) -> tuple[tuple[int, ...], list[float]]:
    """``COUNTS`` and the vector of a text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n, chars = len(words), len(text) - _without(data, _SPACE)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    counts = (n, chars, _without(data, _SYMBOLS), len(lines) - len(set(lines)), repeated_words(words))
    return counts, vector(counts, data, words, len(lines))


def with_stats(df: DataFrame, vector: Vector = shapes) -> DataFrame:
    """Adds ``COUNTS`` and ``vector`` for the column ``text`` and drops it. Other columns pass unchanged."""
    rest = [f for f in df.schema if f.name != "text"]
    counts_ = [T.StructField(c, T.LongType()) for c in COUNTS]
    schema = T.StructType([*rest, *counts_, T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [text_stats(t, vector) for t in b.column("text").to_pylist()]
            counts = zip(*(c for c, _ in stats), strict=True) if stats else [[] for _ in COUNTS]
            columns = [pa.array(c, pa.int64()) for c in counts] + [pa.array((v for _, v in stats), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), *columns], [*(f.name for f in rest), *COUNTS, "vector"])

    return df.select(*[F.col(f"`{f.name}`") for f in rest], "text").mapInArrow(run, schema)
