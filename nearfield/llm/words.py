"""Small helpers shared by the text operators: words and hashes inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of every word rule here: blank and \x09-\x0D. ``bytes.split`` without
#: arguments uses exactly these, ``bytes.lower`` changes A-Z only.
WORD = r"[^\x20\x09-\x0D]+"

#: A memo is emptied when it holds this many words, so a worker's memory is bounded
#: whatever the vocabulary.
MEMO_WORDS = 200_000

#: Bytes of texts that go to a worker at a time. Buffers of each task thread grow to a few
#: times that outside the JVM's heap, and the allocator keeps them for the thread.
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xC2B2AE3D27D4EB4F)
MIX_3 = np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    """Remembered 64-bit hashes of words given as bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def finish(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits of a hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    h ^= h >> np.uint64(29)
    h = h * MIX_2
    h ^= h >> np.uint64(32)
    return h


def give_back() -> None:
    """Return a worker's free memory to the system. Workers live on between tasks, and what
    their allocators keep counts as the executor's memory in all later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.pythonapi, "malloc_trim", None):  # glibc only
        trim(0)


def map_texts(rows: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over whole texts. Batches are bounded by bytes, not only by rows, as
    ten thousand long texts fill an executor; a session that sets its own bound keeps it.
    What a task's memory held goes when the task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    conf = rows.sparkSession.conf
    if BATCH_KEY not in conf.getAll:
        conf.set(BATCH_KEY, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with more underscores in front where a name is taken."""
    names, used = [], {name.lower() for name in taken}
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        names.append(name)
    return names


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text falls into the held-out part; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
