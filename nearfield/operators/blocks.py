"""Nearest neighbours of many long vectors: all pairs, as products of blocks.

Objects and queries are dealt into blocks by hash, and each pair of blocks meets in a task
of its own. A product of matrices finds which objects may be among the nearest of a block;
their distances are then summed as the distance expression does, so ranks agree with it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nearfield.schema import RANK_PLACES

# At most about so many objects and queries in a block, and queries multiplied at once.
BLOCK_OBJECTS, BLOCK_QUERIES, TILE_QUERIES = 65_536, 16_384, 64
LEAST_OBJECTS = 1_024
# Distances nearer than this to the k-th may tie with it once rounded.
_TIE = 2.0 * 10.0**-RANK_PLACES


def nearest_in_blocks(objects: DataFrame, queries: DataFrame, k: int, vector: str) -> DataFrame:
    """(qid, id, dist) of at least the ``k`` nearest objects of every query by (rounded
    distance, id). Rows whose distance is null or not finite take no part."""
    n, asked = objects.count(), queries.count()
    parts = -(-max(1, asked) // BLOCK_QUERIES)
    cores = objects.sparkSession.sparkContext.defaultParallelism
    rows = min(BLOCK_OBJECTS, max(LEAST_OBJECTS, n * parts // (2 * cores)))
    blocks = -(-max(1, n) // rows)
    left = objects.select("id", F.col(vector).cast("array<double>").alias("v"))
    left = left.where(F.col("v").isNotNull()).withColumn("b", F.pmod(F.xxhash64("id", "v"), F.lit(blocks).cast("long")))
    left = left.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.select("qid", F.col(vector).cast("array<double>").alias("v"))
    right = right.where(F.col("v").isNotNull()).withColumn("p", F.pmod(F.xxhash64("qid", "v"), F.lit(parts)).cast("int"))
    right = right.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    kinds = pa.schema([("qid", to_arrow_type(queries.schema["qid"].dataType)), ("id", to_arrow_type(objects.schema["id"].dataType)), ("dist", pa.float64())])

    def meet(some: pa.Table, ask: pa.Table) -> pa.Table:
        if not some.num_rows or not ask.num_rows:
            return kinds.empty_table()
        o, q = _matrix(some), _matrix(ask)
        if o.shape[1] != q.shape[1]:
            raise ValueError("vectors differ in number of dimensions")
        # ties keep the smallest ids: objects in the order of their ids, null first
        order = pa.compute.sort_indices(some.column("id"), null_placement="at_start").to_numpy()
        o = o[order]
        found = [_candidates(o, q[i : i + TILE_QUERIES], k) for i in range(0, len(q), TILE_QUERIES)]
        at = np.concatenate([rows + TILE_QUERIES * i for i, (rows, _, _) in enumerate(found)])
        picked = order[np.concatenate([cols for _, cols, _ in found])]
        dist = np.concatenate([d for _, _, d in found])
        return pa.table([ask.column("qid").take(at), some.column("id").take(picked), pa.array(dist)], schema=kinds)

    pairs = left.groupBy("p", "b").cogroup(right.groupBy("p", "b"))
    types = dict(queries.dtypes)["qid"], dict(objects.dtypes)["id"]
    return pairs.applyInArrow(meet, f"qid {types[0]}, id {types[1]}, dist double")


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors as rows; a null component becomes NaN."""
    column = table.column("v").combine_chunks()
    sizes = column.value_lengths().to_numpy()
    if (sizes != sizes[0]).any():
        raise ValueError("vectors differ in number of dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), int(sizes[0]))


def _candidates(o: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q`` and ``o`` and their distance, for all pairs that may be among the k
    nearest; of equal distances the first ``k`` rows of ``o``."""
    with np.errstate(all="ignore"):
        norm_o, norm_q = (o * o).sum(axis=1), (q * q).sum(axis=1)
        near = norm_q[:, None] + norm_o - 2 * (q @ o.T)
        # float error of the product, and distances that tie after rounding
        error = 1e-13 * o.shape[1] * (norm_q + np.nanmax(np.where(np.isfinite(norm_o), norm_o, 0.0)))
        sound = np.where(np.isfinite(near), near, np.inf)
        kth = np.partition(sound, k - 1, axis=1)[:, k - 1] if sound.shape[1] > k else np.full(len(q), np.inf)
        limit = (np.sqrt(np.maximum(kth + error, 0)) + _TIE) ** 2 + error
        rows, cols = np.nonzero(~(near > limit[:, None]))
        total = np.zeros(len(rows))
        for axis in range(o.shape[1]):  # one by one, in the order of the distance expression
            gap = q[rows, axis] - o[cols, axis]
            total += gap * gap
        dist = np.sqrt(total)
    kept = np.isfinite(dist)
    rows, cols, dist = rows[kept], cols[kept], dist[kept]
    order = np.lexsort((cols, dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    # the place of each pair among those of its query at its distance
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (dist[1:] != dist[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    kept = np.arange(len(rows)) - start < k
    return rows[kept], cols[kept], dist[kept]
