"""Choosing pivots from a bounded sample."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.distances import Metric, columns, distances_to

SAMPLE_ROWS = 512
CANDIDATES = 32
HASH_SPAN = 1 << 40


def hash_key(seed: int) -> Column:
    return F.xxhash64(F.col("id"), F.lit(seed))


def hash_fraction(objects: DataFrame, rows: int, total: int, key: Column) -> DataFrame:
    """About ``rows`` of ``total`` objects, the same ones on every run."""
    if rows >= total:
        return objects
    keep = max(1, -(-rows * HASH_SPAN // total))
    return objects.where(F.pmod(key, F.lit(HASH_SPAN)) < keep)


def sample_objects(objects: DataFrame, metric: Metric, seed: int, rows: int = SAMPLE_ROWS, total: int | None = None, key: Column | None = None) -> list[Row]:
    """A fixed pseudo-random sample: the objects with the smallest hashed ids.

    With ``total`` known, a threshold on the hash thins the scan first, so each
    task hands on a few rows rather than ``rows`` of its own."""
    if key is None:
        key = hash_key(seed)
        if total is not None:
            objects = hash_fraction(objects, 8 * rows, total, key)
    return objects.select("id", *metric.columns).orderBy(key, "id").limit(rows).collect()


def incremental_pivots(objects: DataFrame, metric: Metric, sample: Sequence[Row], k: int, fixed: Sequence[Row] = (), candidates: int = CANDIDATES) -> list[Row]:
    """``fixed`` first, then pivots added one by one until there are ``k``.

    Each new pivot is the candidate that most raises the mean, over pairs of
    sampled objects, of the best lower bound any pivot gives for the pair's
    distance. Pairs are neighbours in the sample; candidates are its head. The
    distances are computed by Spark; the choice works on a matrix of at most
    ``len(sample)`` by ``len(fixed) + candidates`` numbers."""
    fixed = list(fixed)[:k]
    head = list(sample[:candidates])
    if len(fixed) >= k or not head:
        return fixed
    matrix = sample_distances(objects, metric, sample, fixed + head)
    taken = {r["id"] for r in fixed}
    allowed = [len(fixed) + j for j, r in enumerate(head) if r["id"] not in taken]
    added = pick_columns(matrix, k, list(range(len(fixed))), allowed)
    return fixed + [head[j - len(fixed)] for j in added]


def sample_distances(objects: DataFrame, metric: Metric, sample: Sequence[Row], to: Sequence[Row]) -> np.ndarray:
    """Distances from each sampled object to each object of ``to``."""
    schema = objects.select("id", *metric.columns).schema
    local = objects.sparkSession.createDataFrame(
        [(i, *(r[c] for c in metric.columns)) for i, r in enumerate(sample)],
        T.StructType([T.StructField("at", T.LongType()), *[schema[c] for c in metric.columns]]),
    )
    rows = local.select("at", distances_to(metric, to, columns(metric), looped=True).alias("d")).collect()
    return np.array([r["d"] for r in sorted(rows, key=lambda r: r["at"])], dtype=float)


def pick_columns(matrix: np.ndarray, k: int, start: Sequence[int], allowed: Sequence[int]) -> list[int]:
    """Columns to add to ``start`` until there are ``k``, each the one that most
    raises the mean over row pairs of the largest gap within a pair."""
    pairs = len(matrix) // 2
    gaps = np.abs(matrix[0 : 2 * pairs : 2] - matrix[1 : 2 * pairs : 2])
    best = gaps[:, list(start)].max(axis=1) if len(start) and pairs else np.zeros(pairs)
    left, added = list(allowed), []
    while left and len(start) + len(added) < k:
        gain = np.maximum(best[:, None], gaps[:, left]).mean(axis=0) if pairs else np.zeros(len(left))
        column = left.pop(int(gain.argmax()))
        best = np.maximum(best, gaps[:, column])
        added.append(column)
    return added


def choose_pivots(objects: DataFrame, metric: Metric, k: int, seed: int = 0, fixed: Sequence[Row] = (), key: Column | None = None, total: int | None = None) -> list[Row]:
    """Fixed pivots first, the rest by incremental selection on a sample."""
    sample = sample_objects(objects, metric, seed, key=key, total=total)
    return incremental_pivots(objects, metric, sample, k, fixed)
