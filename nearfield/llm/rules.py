"""Quality rules by repetition coverage.

Every whole text is measured with rolling hashes over its word ids: which words lie in
an n-gram that occurs more than once, for several n, and which lines repeat an earlier
line. Coverage is a share of the characters inside words, so overlapping n-grams count
a character once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.words import MEMO_WORDS

SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
SPACE = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")

#: Highest share of word characters that duplicated n-grams of a length may cover.
MAX_COVER = {5: 0.30, 8: 0.28, 10: 0.26}
MAX_LINE_COVER = 0.30
MAX_SYMBOL_SHARE = 0.10
MIN_WORDS = 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, line_cover double, cover_5 double, cover_8 double, cover_10 double"
)


class Vocabulary(dict):
    """Ids of the words of one text and the number of code points of each."""

    def __init__(self):
        super().__init__()
        self.chars = np.zeros(1 << 16, np.int32)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        if i >= len(self.chars):
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.chars[i] = code_points(word)
        return i

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One id per pair of ids, equal exactly for equal pairs."""
    if not len(left):
        return left
    width = int(right.max()) + 1
    if int(left.max()) >= (1 << 62) // width:
        left = np.unique(left, return_inverse=True)[1]
        right = np.unique(right, return_inverse=True)[1]
        width = int(right.max()) + 1
    return left * width + right


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """An id per n-gram, rolled from halves: equal exactly where the n-grams are equal."""
    if n == 1 or len(ids) < n:
        return ids[: max(0, len(ids) - n + 1)]
    half = n // 2
    first = grams(ids, half)
    second = first if n - half == half else grams(ids, n - half)
    return joined(first[: len(ids) - n + 1], second[half : half + len(ids) - n + 1])


def repeated_words(ids: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words in n-grams that occur twice or more, the first included."""
    mask = np.zeros(len(ids), bool)
    if len(ids) <= n:
        return mask
    keys = grams(ids, n)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return mask
    twice = np.zeros(len(keys) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(text: bytes, vocabulary: Vocabulary) -> tuple:
    """n_words to cover_10 of the schema for one text."""
    words = text.split()
    n = len(words)
    ids = vocabulary.ids(words)
    chars = vocabulary.chars[ids]
    total = int(chars.sum())
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    line_cover, dup_lines = 0.0, 0
    if len(lines) > 1:
        seen: set[bytes] = set()
        lost = 0
        for line in lines:
            if line in seen:
                dup_lines += 1
                lost += code_points(line) - sum(map(line.count, SPACE))
            seen.add(line)
        line_cover = lost / total
    repeat = int(repeated_words(ids, 3).sum())
    cover = {k: float(chars[repeated_words(ids, k)].sum()) / total if repeat else 0.0 for k in MAX_COVER}
    failed = n < MIN_WORDS or 100 * repeat > 50 * n
    kept = not (
        failed
        or line_cover > MAX_LINE_COVER
        or symbols > MAX_SYMBOL_SHARE * total
        or any(cover[k] > most for k, most in MAX_COVER.items())
    )
    return n, total, symbols, dup_lines, repeat, failed, kept, line_cover, *cover.values()


def quality_rules(documents: DataFrame) -> DataFrame:
    """Repetition measures and the verdict of every document.

    ``documents`` needs ``doc_id`` and ``text``; other columns are ignored. One row comes
    back per input row, repeated rows included. A null or empty text has no words: all
    counts 0, base_failed true, kept false. A null doc_id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        types = [kinds[f.split()[1]] for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = [measure(value.as_buffer().to_pybytes() if value.is_valid else b"", vocabulary) for value in batch.column("text")]
            columns = list(zip(*rows)) if rows else [[] for _ in names[1:]]
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA)


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
