"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Packing looks only at lengths, and there are at most ``capacity`` of them. So the pieces
are counted by length, the plan is made once for the counts (a list of bin patterns, each
with the number of bins that use it), and every piece then finds its place from its rank
among the pieces of its length. The plan is bounded by the capacity, not by the data."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.tokens import encoder, tokenizer_path
from nearfield.llm.words import map_texts
from nearfield.session import stage

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that one task ranks; a length with more is spread by hash.
RANK_ROWS = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every whole document: its ids, then the end id, cut only where
    longer than the capacity. A null text is empty and gives one piece with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        try:
            for batch in batches:
                rows: list[list] = [[] for _ in range(5)]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), known.ids(batch.column("text"))):
                    data = np.append(ids, END_ID).astype("<u4")
                    for k, start in enumerate(range(0, len(data), capacity)):
                        part = data[start : start + capacity]
                        for column, value in zip(rows, (doc_id, k, start, len(part), zlib.crc32(part.tobytes()))):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = [f.split()[0] for f in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)
        finally:
            known.forget()

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(source, run, PIECES)


def two_fit(counts: np.ndarray, gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths whose sum is the largest that fits the gap, the larger first."""
    lengths = np.flatnonzero(counts[: gap + 1])
    if not len(lengths):
        return None
    partner = np.searchsorted(lengths, gap - lengths, side="right") - 1
    single = counts[lengths] < 2
    same = (partner >= 0) & (lengths[partner] == lengths) & single
    partner = np.where(same, partner - 1, partner)
    ok = partner >= 0
    if not ok.any():
        return None
    sums = np.where(ok, lengths + lengths[partner], -1)
    best = int(np.argmax(sums))
    a, b = int(lengths[best]), int(lengths[partner[best]])
    return max(a, b), min(a, b)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bin patterns (lengths, longest first) with the number of bins of each.

    A bin is filled greedily with the longest unpacked length that fits. If a gap stays,
    its smallest document is taken out and two unpacked ones go in where they fill the
    widened gap more tightly. A pattern is used as often as the counts allow, so each
    step uses up a length or all but one of it."""
    left = counts.astype(np.int64).copy()
    bins: list[tuple[list[int], int]] = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return bins
        pattern, gap = [], capacity
        taken = left.copy()
        while gap:
            fits = np.flatnonzero(taken[1 : gap + 1])
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            # one length as often as it fits: the same choice made again and again
            times = min(gap // length, int(taken[length]))
            pattern += [length] * times
            taken[length] -= times
            gap -= length * times
        while gap and len(pattern) > 1:
            smallest = pattern[-1]
            pair = two_fit(taken, gap + smallest)
            if pair is None or sum(pair) <= smallest:
                break
            taken[smallest] += 1
            pattern.pop()
            for length in pair:
                taken[length] -= 1
            gap += smallest - sum(pair)
            pattern = sorted([*pattern, *pair], reverse=True)
        used, need = np.unique(pattern, return_counts=True)
        times = int((left[used] // need).min())
        left[used] -= need * times
        bins.append((pattern, times))


class Slots:
    """For each length, the ranks at which a pattern's places begin."""

    def __init__(self, bins: list[tuple[list[int], int]], capacity: int):
        self.base = np.zeros(len(bins) + 1, np.int64)
        filled = np.zeros(capacity + 1, np.int64)
        rows = []
        for k, (pattern, times) in enumerate(bins):
            self.base[k + 1] = self.base[k] + times
            offset = 0
            for length in pattern:  # one place of the pattern: as many pieces as bins
                rows.append((length, filled[length], k, offset))
                filled[length] += times
                offset += length
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.start, self.bin, self.offset = table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy()
        self.first = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        order = np.argsort(lengths, kind="stable")
        values, at = np.unique(lengths[order], return_index=True)
        for length, rows in zip(values, np.split(order, at[1:])):
            lo, hi = self.first[length], self.first[length + 1]
            slot = lo + np.searchsorted(self.start[lo:hi], ranks[rows], side="right") - 1
            sequence[rows] = self.base[self.bin[slot]] + ranks[rows] - self.start[slot]
            offset[rows] = self.offset[slot]
        return sequence, offset


def ranked(cut: DataFrame, total: int) -> DataFrame:
    """Rank from 0 of each piece among those of its length.

    A length is spread over hash parts; ranks inside a part start where the smaller parts
    end, so no task meets a whole hot length."""
    parts = max(1, -(-total // RANK_ROWS))
    spread = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(parts)))
    sizes = spread.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    rows = spread.withColumn("inside", F.row_number().over(inside) - 1)
    return rows.join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents; one row per piece with its sequence and place there.

    ``documents`` needs ``doc_id`` and ``text``; other columns are ignored. Repeated rows
    are packed as often as they come; a null doc_id stays null. An empty table gives an
    empty result. Places in a sequence are gapless from 0."""
    cut = stage(pieces(documents, tokenizer, capacity), "pieces")
    counted = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in counted:
        counts[row["length"]] = row["n"]
    slots = Slots(plan(counts, capacity), capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = slots.place(lengths, ranks)
            table = [batch.column(f.split()[0]) for f in PIECES.split(", ")]
            names = [f.split()[0] for f in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([*table, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = [f.split()[0] for f in PIECES.split(", ")]
    placed = ranked(cut, int(counts.sum())).select(*names, "rank")
    return placed.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
