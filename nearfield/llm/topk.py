"""Exact top-k search by inner product with dual cover trees.

Vectors are packed into blocks, and each block gets a cover tree: a node holds a centre and
a radius that covers its points, its children are centres farther apart than the next
radius. Queries are packed and indexed the same way. A block of queries meets a slice of
the data's blocks in one task, which walks both trees together: by the radii, no pair of a
query node and a data node scores above
``centre . centre + |centre| radius' + |centre'| radius + radius radius'``, and a pair below
the worst k-th score of the query node is left out. Leaves are multiplied as matrices."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.session import stage

SCALE = 64.0
BLOCK = 4096  # vectors of a data block
QUERY_BLOCK = 1024
SLICE = 4  # data blocks that one task holds against a block of queries
LEAF = 32
BASE = 1.3  # ratio of the radii of two levels
TILE = 1024  # data points multiplied at a time

BLOCK_SCHEMA = "block binary"


class Tree:
    """A cover tree over the rows of a matrix, flat: children are runs of nodes, leaves
    runs of rows in ``rows``."""

    def __init__(self, points: np.ndarray):
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.run: list[tuple[int, int]] = []
        self.rows = np.zeros(0, np.int64)
        self.points = points
        order: list[np.ndarray] = []
        if len(points):
            self._grow(order)
        self.rows = np.concatenate(order) if order else self.rows
        self.centre, self.radius = np.array(self.centre, np.int64), np.array(self.radius)
        self.child, self.run = np.array(self.child, np.int64).reshape(-1, 2), np.array(self.run, np.int64).reshape(-1, 2)

    def _distances(self, rows: np.ndarray, row: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[row]) ** 2).sum(1))

    def _add(self, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.child.append((0, 0))
        self.run.append((0, 0))
        return len(self.centre) - 1

    def _grow(self, order: list[np.ndarray]) -> None:
        rows = np.arange(len(self.points))
        middle = int(np.argmin(((self.points - self.points.mean(0)) ** 2).sum(1)))
        away = self._distances(rows, middle)
        waiting = [(self._add(middle, float(away.max())), rows, away)]
        placed = 0
        while waiting:
            node, rows, away = waiting.pop()
            parts = self._cover(rows, away, self.centre[node], self.radius[node] / BASE) if len(rows) > LEAF and self.radius[node] > 0 else None
            if parts is None:  # small, or its next level would be single points
                order.append(rows)
                self.run[node] = (placed, placed + len(rows))
                placed += len(rows)
                continue
            first = len(self.centre)
            for centre, some, dist in parts:
                waiting.append((self._add(centre, float(dist.max())), some, dist))
            self.child[node] = (first, len(self.centre))

    def _cover(self, rows: np.ndarray, away: np.ndarray, centre: int, radius: float):
        """Centres farther apart than the radius, each with the points nearest to it."""
        nearest, owner, centres = away.copy(), np.zeros(len(rows), np.int64), [centre]
        while True:
            far = int(np.argmax(nearest))
            if nearest[far] <= radius:
                break
            if len(centres) * LEAF > len(rows) + LEAF:
                return None
            dist = self._distances(rows, int(rows[far]))
            closer = dist < nearest
            owner[closer] = len(centres)
            nearest[closer] = dist[closer]
            centres.append(int(rows[far]))
        if len(centres) == 1:
            return None
        return [(c, rows[owner == k], nearest[owner == k]) for k, c in enumerate(centres) if (owner == k).any()]


class Block:
    """Vectors with their ids and tree. The matrix is float32 where every product and sum
    is exact there, else float64 (exact up to 2**53)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.largest = float(np.abs(vectors).max(initial=0))
        self.data = vectors.astype(np.float32 if self.largest < 2**24 else np.float64)
        self.tree = Tree(vectors)
        self.tree.points = None
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))


def same_width(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in a type that is exact for their products, with equal width: missing
    components count as zero."""
    width = max(a.data.shape[1], b.data.shape[1])
    exact = a.largest * b.largest * max(1, width) < 2**24
    kind = np.float32 if exact else np.float64
    fill = lambda x: np.pad(x.astype(kind, copy=False), ((0, 0), (0, width - x.shape[1])))
    return fill(a.data), fill(b.data)


class Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return self.score[rows, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge scores (rows x ids) in; equal scores go to the smaller id."""
        limit = self.worst(rows)
        if scores.shape[1] > self.k:
            limit = np.maximum(limit, np.partition(scores, -self.k, axis=1)[:, -self.k])
        at, column = np.nonzero((scores >= limit[:, None]) & (scores > -np.inf))
        if not len(at):
            return
        touched = np.unique(at)
        old = np.repeat(touched, self.k)
        row = np.concatenate([at, old])
        score = np.concatenate([scores[at, column], self.score[rows[touched]].ravel()])
        who = np.concatenate([ids[column], self.id[rows[touched]].ravel()])
        order = np.lexsort((who, -score, row))
        row, score, who = row[order], score[order], who[order]
        first = np.searchsorted(row, touched)
        keep = (first[:, None] + np.arange(self.k)).ravel()
        self.score[rows[touched]] = score[keep].reshape(-1, self.k)
        self.id[rows[touched]] = who[keep].reshape(-1, self.k)


def search(queries: Block, data: Block, best: Best) -> None:
    """Walk both trees from their roots and bring ``best`` up to date."""
    q, x = same_width(queries, data)
    qt, xt = queries.tree, data.tree
    if not len(qt.centre) or not len(xt.centre):
        return

    def bounds(node: int, nodes: np.ndarray) -> np.ndarray:
        a = qt.centre[node]
        dots = x[xt.centre[nodes]].astype(np.float64) @ q[a].astype(np.float64)
        ra, rb = qt.radius[node], xt.radius[nodes]
        found = dots + queries.norm[a] * rb + data.norm[xt.centre[nodes]] * ra + ra * rb
        return found + 1e-9 * np.abs(found) + 1e-6

    def rows_below(node: int) -> np.ndarray:
        stack, runs = [node], []
        while stack:
            n = stack.pop()
            lo, hi = qt.child[n]
            stack.extend(range(lo, hi))
            if lo == hi:
                runs.append(qt.rows[qt.run[n][0] : qt.run[n][1]])
        return np.concatenate(runs)

    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        node, nodes = stack.pop()
        rows = rows_below(node)
        nodes = nodes[bounds(node, nodes) >= best.worst(rows).min()]
        lo, hi = qt.child[node]
        if lo < hi:  # go down on both sides
            inner = xt.child[nodes][:, 0] < xt.child[nodes][:, 1]
            below = [np.arange(a, b) for a, b in xt.child[nodes[inner]]]
            nodes = np.concatenate([nodes[~inner], *below])
            stack.extend((child, nodes) for child in range(lo, hi))
            continue
        while True:  # a query leaf: go down in the data to its leaves
            inner = xt.child[nodes][:, 0] < xt.child[nodes][:, 1]
            if not inner.any():
                break
            below = np.concatenate([np.arange(a, b) for a, b in xt.child[nodes[inner]]])
            below = below[bounds(node, below) >= best.worst(rows).min()]
            nodes = np.concatenate([nodes[~inner], below])
        bound = bounds(node, nodes)
        order = np.argsort(-bound, kind="stable")
        nodes, bound = nodes[order], bound[order]
        at = 0
        while at < len(nodes) and bound[at] >= best.worst(rows).min():
            some, held = [], 0
            while at < len(nodes) and held < TILE and bound[at] >= best.worst(rows).min():
                lo, hi = xt.run[nodes[at]]
                some.append(xt.rows[lo:hi])
                held += hi - lo
                at += 1
            columns = np.concatenate(some)
            scores = (q[rows] @ x[columns].T).astype(np.float64)
            scores[queries.ids[rows][:, None] == data.ids[columns][None, :]] = -np.inf
            best.add(rows, scores, data.ids[columns])


def packed_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of a partition, with their trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            width = max(v.shape[0] for v in vectors)
            table = np.zeros((len(vectors), width))
            for i, v in enumerate(vectors):
                table[i, : len(v)] = v
            block = pickle.dumps(Block(np.array(ids, np.int64), table), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

        for batch in batches:
            column = batch.column("vector")
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                values = column[i].values
                ids.append(vec_id)
                vectors.append(np.floor(SCALE * values.to_numpy(zero_copy_only=False).astype(np.float64)))
                if len(ids) >= size:
                    yield flush()
                    ids.clear()
                    vectors.clear()
        if ids:
            yield flush()

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def numbered(blocks: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The staged blocks numbered from 0, and how many there are."""
    staged = stage(blocks.withColumn("key", F.monotonically_increasing_id()), label)
    ranks = staged.select("key").withColumn("n", F.row_number().over(Window.orderBy("key")) - 1)
    return staged.join(ranks, "key").select("n", "block"), staged.count()


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all vectors for each query row.

    Both tables need ``vec_id`` and ``embedding``; other columns are ignored. A vector that
    is null or holds a null or a number that is not finite takes no part, and neither does
    a row without id. A vector with fewer components counts as zero in the others; an empty
    one scores 0 with all. Equal scores rank by the smaller id; a query never meets rows of
    its own id; repeated query rows are each answered. Fewer than ``k`` others give fewer
    rows, an empty table none."""

    def usable(df: DataFrame) -> DataFrame:
        e = F.col("embedding").cast("array<double>")
        fine = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
        return df.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("vector"))

    asked = usable(queries)
    n_queries = asked.count()
    data, n_data = numbered(packed_blocks(usable(vectors), BLOCK), "vector-blocks")
    groups, n_groups = numbered(packed_blocks(asked.repartition(max(1, -(-n_queries // QUERY_BLOCK))), QUERY_BLOCK), "query-blocks")
    slices = max(1, -(-n_data // SLICE))

    # Every block of queries in every slice, and every data block against all of them; the
    # queries' row comes first in a task's group, then the data stream past it.
    every_slice = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))
    left = groups.select(F.col("n").cast("long").alias("q"), every_slice.alias("s"), F.lit(0).alias("kind"), "block")
    every_group = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_groups, 1) - 1).cast("long")))
    right = data.select(every_group.alias("q"), (F.col("n") % slices).cast("long").alias("s"), F.lit(1).alias("kind"), "block")
    rows = left.unionByName(right).repartition("q", "s").sortWithinPartitions("q", "s", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block, best = None, None, None

        def found() -> pa.RecordBatch:
            at, column = np.nonzero(best.score > -np.inf)
            arrays = [
                pa.array(np.full(len(at), group[0])), pa.array(at), pa.array(block.ids[at]),
                pa.array(best.id[at, column]), pa.array(best.score[at, column].astype(np.int64)),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["q", "row", "query_id", "vec_id", "score"])

        for batch in batches:
            for q, s, kind, data in zip(*(batch.column(c) for c in ("q", "s", "kind", "block"))):
                key = (q.as_py(), s.as_py())
                if kind.as_py() == 0:
                    if block is not None:
                        yield found()
                    group, block = key, pickle.loads(data.as_buffer())
                    best = Best(len(block.ids), k)
                elif block is not None and key == group:
                    search(block, pickle.loads(data.as_buffer()), best)
        if block is not None:
            yield found()

    parts = rows.mapInArrow(run, "q long, row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q", "row").orderBy(F.desc("score"), "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_dual_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


SQL = {
    "op7_dual_cover_tree": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
      FROM v JOIN v AS q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM r QUALIFY rank <= 20
"""
}
