"""Range and nearest-neighbour queries without a stored index.

A batch of queries meets the objects through a grid over the distances to two
pivots: an object lies in one cell, a query ball covers a few, and only pairs
that share a cell are compared. The join is an equi-join on the cell."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from nearfield.functions.distances import UNROLLED_LENGTH, Metric, VectorMetric, columns, distances_to
from nearfield.operators.blocks import nearest_in_blocks
from nearfield.operators.pivots import hash_fraction, hash_key, pick_columns, sample_distances, sample_objects
from nearfield.operators.probes import MAX_PROBES
from nearfield.schema import ANSWER_TOLERANCE, PRUNE_SLACK, RANK_PLACES
from nearfield.session import BROADCAST_BYTES, BROADCAST_ROWS, fits_broadcast, lookup_join, stage

# Bins of an axis: at least so many, and more for cells of about CELL_ROWS objects.
GRID_BINS, MOST_BINS = 24, 256
CELL_ROWS = 10_000
_GRID_SAMPLE, _GRID_CANDIDATES = 256, 8
# More queries than this get a grid that is fitted to their radii: up to FITTED_AXES pivots,
# one of these numbers of bins on each, chosen by the work that pairs of a sample foretell.
CROWD_QUERIES = 64
FITTED_AXES, FITTED_BINS = 5, (6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512)
_FITTED_SAMPLE, _FITTED_CANDIDATES = 512, 16
# What a query's row in one more cell costs, counted in compared pairs; a query that reaches
# more cells than this takes a grid of few.
_ROW_COST, MOST_CELLS = 25, 1024
_RADII = (0.05, 0.25, 0.5, 0.75, 0.95)
# Very many queries grow with the table: beyond this they are shuffled, not sent by way of
# the driver, which holds a broadcast table several times over.
CROWD_BYTES = 4 << 20
# About so many objects give a first kNN radius; slices grow by this factor.
_PEEK_ROWS, _SLICE_GROWTH = 4096, 8


def range_query(objects: DataFrame, query: Row, radius: float, metric: Metric) -> DataFrame:
    """All objects within ``radius`` of one query object (inclusive)."""
    dist = metric.distance(columns(metric), metric.literal(query))
    return objects.select("id", dist.alias("dist")).where(F.col("dist") < radius + ANSWER_TOLERANCE)


@dataclass
class Grid:
    """Cells over the distances to a few pivots. ``low`` and ``width`` only
    shape the cells; distances outside fall in the border cells."""

    pivots: list[Row]
    low: list[float]
    width: list[float]
    bins: int = GRID_BINS
    # whether objects may lack a descriptor and lie in cell -1
    partial: bool = True

    def _bin(self, dist: Column, axis: int) -> Column:
        at = F.floor((dist - self.low[axis]) / self.width[axis])
        return F.greatest(F.least(at, F.lit(self.bins - 1)), F.lit(0)).cast("int")

    def object_cell(self, metric: Metric, side) -> Column:
        """The cell of an object; -1 for objects that cannot be pruned."""
        cell = F.lit(0).cast("long")
        for axis, pivot in enumerate(self.pivots):
            cell = cell * self.bins + self._bin(metric.distance(side, metric.literal(pivot)), axis)
        return F.when(metric.complete(side), cell).otherwise(-1)

    def pivot_distances(self, metric: Metric, side) -> Column:
        """A query's distances to the pivots, to be made a column before its cells are listed."""
        return distances_to(metric, self.pivots, side, looped=True)

    def _reach(self, dists: str, radius: Column, axis: int) -> tuple[Column, Column]:
        dist = F.get(dists, F.lit(axis))
        far = radius + PRUNE_SLACK * (1 + dist + radius)
        return self._bin(dist - far, axis), self._bin(dist + far, axis)

    def cells_reached(self, complete: Column, dists: str, radius: Column) -> Column:
        """How many cells ``query_cells`` lists, but for cell -1."""
        cells = F.lit(1.0)
        for axis in range(len(self.pivots)):
            low, high = self._reach(dists, radius, axis)
            cells = cells * (high - low + 1)
        return F.when(complete, cells).otherwise(float(self.bins) ** len(self.pivots))

    def query_cells(self, complete: Column, dists: str, radius: Column) -> Column:
        """All cells a query ball may reach, at most bins ** pivots of them.

        Every query also looks at cell -1; a query that lacks a descriptor
        cannot be pruned and looks at all cells."""
        whole = F.sequence(F.lit(0), F.lit(self.bins - 1))
        cells = F.array(F.lit(0).cast("long"))
        for axis in range(len(self.pivots)):
            reach = F.sequence(*self._reach(dists, radius, axis))
            reach = F.when(complete, reach).otherwise(whole)
            cells = F.flatten(F.transform(cells, _extend(reach, self.bins)))
        return F.array_append(cells, F.lit(-1).cast("long")) if self.partial else cells


def _extend(reach: Column, bins: int):
    return lambda cell: F.transform(reach, lambda b: cell * bins + b)


def plan_grid(objects: DataFrame, metric: Metric, axes: int = 2, bins: int | None = None) -> Grid:
    """A grid fitted to the objects with the smallest hashed ids, so that it is
    the same however the input is laid out. It decides speed only. More objects
    get more cells."""
    whole = objects.select("id", *metric.columns).where(metric.complete(columns(metric)))
    peek = sample_objects(whole, metric, 0, _GRID_SAMPLE)
    if not peek:
        return Grid([], [], [])
    if bins is None:
        bins = min(MOST_BINS, max(GRID_BINS, math.ceil(math.sqrt(objects.count() / CELL_ROWS))))
    head = peek[:_GRID_CANDIDATES]
    matrix = sample_distances(objects, metric, peek, head)
    picked = pick_columns(matrix, axes, [], range(len(head)))
    low = [float(matrix[:, c].min()) for c in picked]
    width = [float(matrix[:, c].max() - lo) / bins or 1.0 for c, lo in zip(picked, low)]
    return Grid([head[c] for c in picked], low, width, bins)


@dataclass
class Survey:
    """What grids for many queries are fitted to: distances from a bounded sample of the
    objects to candidate pivots. It decides speed only."""

    head: list[Row]
    matrix: np.ndarray
    total: int
    partial: bool

    @classmethod
    def of(cls, objects: DataFrame, metric: Metric) -> Survey:
        complete = metric.complete(columns(metric))
        counted = objects.agg(F.count("*").alias("n"), F.count_if(~complete).alias("partial")).first()
        whole = objects.select("id", *metric.columns).where(complete)
        peek = sample_objects(whole, metric, 0, _FITTED_SAMPLE, total=max(1, counted["n"] - counted["partial"]))
        head = peek[:_FITTED_CANDIDATES]
        matrix = sample_distances(objects, metric, peek, head) if peek else np.zeros((0, 0))
        return cls(head, matrix, counted["n"], counted["partial"] > 0)

    def fitted(self, queries: DataFrame, total: int | None = None) -> Grid:
        """The grid that leaves least work: rows of queries in cells and pairs that share one,
        as foretold by pairs of the sample at quantiles of the radii."""
        total = self.total if total is None else total
        known = queries.where(F.abs("radius") < float("inf"))
        seen = known.agg(F.percentile_approx("radius", list(_RADII)).alias("r")).first()["r"]
        if not self.head or not seen:
            return self.coarse()
        picked = pick_columns(self.matrix, FITTED_AXES, [], range(len(self.head)))
        best = None
        for bins in FITTED_BINS:
            low, width = self._shape(picked, bins)
            at = self.matrix[:, picked]
            cell = np.clip(np.floor((at - low) / width), 0, bins - 1)
            cost = np.zeros(len(picked))
            for radius in seen:
                first, last = (np.clip(np.floor((at + side * radius - low) / width), 0, bins - 1) for side in (-1, 1))
                shared, cells = np.ones((len(at), len(at)), bool), np.ones(len(at))
                for axis in range(len(picked)):
                    shared &= (first[:, axis, None] <= cell[:, axis]) & (cell[:, axis] <= last[:, axis, None])
                    cells = cells * (last[:, axis] - first[:, axis] + 1)
                    # a pair of an object with itself foretells nothing
                    pairs = (shared.sum() - len(at) + 0.5) / max(1, len(at) * (len(at) - 1))
                    cost[axis] += _ROW_COST * np.minimum(cells, MOST_CELLS * 4).mean() + total * pairs
            axes = int(cost.argmin()) + 1
            if best is None or cost[axes - 1] < best[0]:
                best = cost[axes - 1], axes, bins
        _, axes, bins = best
        return self._grid(picked[:axes], bins)

    def coarse(self) -> Grid:
        """Few cells, for queries that reach very many or whose reach is not known."""
        picked = pick_columns(self.matrix, 2, [], range(len(self.head))) if self.head else []
        return self._grid(picked, GRID_BINS)

    def _shape(self, picked, bins: int) -> tuple[np.ndarray, np.ndarray]:
        low = self.matrix[:, picked].min(axis=0)
        width = (self.matrix[:, picked].max(axis=0) - low) / bins
        return low, np.where(width > 0, width, 1.0)

    def _grid(self, picked, bins: int) -> Grid:
        if not len(picked):
            return Grid([], [], [], partial=self.partial)
        low, width = self._shape(picked, bins)
        return Grid([self.head[c] for c in picked], low.tolist(), width.tolist(), bins, self.partial)


def range_query_batch(
    objects: DataFrame,
    queries: DataFrame,
    metric: Metric,
    grid: Grid | None = None,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Answers (qid, id, dist) of many range queries, each with its own radius.

    ``queries`` holds qid, the metric's columns and ``radius``. Few enough
    queries are broadcast and the objects never move; more than that shuffle on
    the cell, with crowded cells cut up on both sides."""
    if grid is None and is_crowd(queries):
        return crowd_answers(objects, queries, metric, max_broadcast_rows=max_broadcast_rows).select("qid", "id", "dist")
    grid = grid or plan_grid(objects, metric)
    return _grid_answers(objects, queries, metric, grid, max_broadcast_rows).select("qid", "id", "dist")


def is_crowd(queries: DataFrame) -> bool:
    return queries.limit(CROWD_QUERIES + 1).count() > CROWD_QUERIES


def crowd_answers(
    objects: DataFrame,
    queries: DataFrame,
    metric: Metric,
    survey: Survey | None = None,
    total: int | None = None,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Answers of very many queries with all other columns of both sides: id, qid, dist, ...

    The grid is fitted to the radii. Queries that would reach too many of its cells, or
    lack a descriptor, go through a grid of few cells."""
    survey = survey or Survey.of(objects, metric)
    fine, coarse = survey.fitted(queries, total), survey.coarse()
    complete = metric.complete(columns(metric))
    placed = queries.withColumn("_dists", fine.pivot_distances(metric, columns(metric)))
    far = F.coalesce(fine.cells_reached(complete, "_dists", F.col("radius")) > MOST_CELLS, F.lit(True))
    placed = stage(placed.withColumn("_far", far).drop("_dists"), "crowd")
    near, wide = placed.where(~F.col("_far")).drop("_far"), placed.where("_far").drop("_far")
    found = _grid_answers(objects, near, metric, fine, max_broadcast_rows, CROWD_BYTES)
    if wide.isEmpty():
        return found
    return found.unionByName(_grid_answers(objects, wide, metric, coarse, max_broadcast_rows, CROWD_BYTES))


def _grid_answers(
    objects: DataFrame, queries: DataFrame, metric: Metric, grid: Grid, max_broadcast_rows: int, max_broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Pairs of a shared cell within the radius; columns of the queries' descriptors become q_*."""
    left = objects.withColumn("_cell", grid.object_cell(metric, columns(metric)))
    right = queries.withColumnsRenamed({c: "q_" + c for c in metric.columns})
    side = columns(metric, "q_")
    right = right.withColumn("_dists", grid.pivot_distances(metric, side))
    right = right.withColumn("_cell", F.explode(grid.query_cells(metric.complete(side), "_dists", F.col("radius")))).drop("_dists")
    left = left.select("_cell", "id", *[c for c in objects.columns if c != "id"])
    pairs = lookup_join(
        left, right, ["_cell"], right_split_on="qid", max_broadcast_rows=max_broadcast_rows, max_broadcast_bytes=max_broadcast_bytes
    )
    dist = metric.distance(columns(metric), columns(metric, "q_"))
    found = pairs.withColumn("dist", dist).where(F.col("dist") < F.col("radius") + ANSWER_TOLERANCE)
    return found.drop("_cell", *metric.columns, *["q_" + c for c in metric.columns])


def loosened(dist):
    """A distance with room for float error, so that ties with it stay inside."""
    return dist + PRUNE_SLACK * (1 + dist)


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows per query by (distance, id). Spark keeps only ``k``
    rows per query and task before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.round("dist", RANK_PLACES), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qid", "id", "dist", "rank")


def knn(
    objects: DataFrame,
    queries: DataFrame,
    k: int,
    metric: Metric,
    grid: Grid | None = None,
    max_probes: int = MAX_PROBES,
) -> DataFrame:
    """The ``k`` nearest objects of every query, exactly: (qid, id, dist, rank).

    The k-th distance within any subset bounds the true k-th distance, so a
    small subset gives each query a radius; a range query with that radius holds
    the whole answer."""
    if grid is None and _long_vectors(metric) and not fits_broadcast(queries, max_probes):
        # cells prune next to nothing in many dimensions: all pairs, as products of blocks
        return nearest(nearest_in_blocks(objects, queries, k, metric.columns[0]), k)
    bounded = _with_knn_radius(objects, queries, k, metric, max_probes)
    return nearest(range_query_batch(objects, bounded, metric, grid), k)


def _long_vectors(metric: Metric) -> bool:
    return type(metric) is VectorMetric and (metric.length is None or metric.length > UNROLLED_LENGTH)


def _with_knn_radius(objects: DataFrame, queries: DataFrame, k: int, metric: Metric, max_probes: int = MAX_PROBES) -> DataFrame:
    """The queries with a ``radius`` that holds their ``k`` nearest objects."""
    queries = queries.select("qid", *metric.columns)
    total = objects.count()
    subset = hash_fraction(objects.select("id", *metric.columns), _PEEK_ROWS, total, hash_key(0))
    unbounded = F.lit(float("inf"))
    if fits_broadcast(queries, max_probes):
        probes = queries.collect()
        kth = _kth_distances(subset, probes, k, metric)
        if not kth:
            return queries.withColumn("radius", unbounded)
        # The slack keeps distances that tie with the bound after rounding.
        known = F.create_map(*[F.lit(x) for i, d in kth.items() for x in (probes[i]["qid"], loosened(d))])
        return queries.withColumn("radius", F.coalesce(F.try_element_at(known, F.col("qid")), unbounded))

    # Many queries: d(q, o) <= d(q, p) + d(p, o), so a pivot with k objects close
    # by bounds every query near it. Then tighten on growing slices of the data.
    side = columns(metric)
    whole = subset.where(metric.complete(side))
    pivots = whole.limit(MAX_PROBES).collect()
    kth = _kth_distances(whole, pivots, k, metric)
    bound = unbounded
    if kth:
        known = sorted(kth)
        spread = F.array(*[F.lit(loosened(kth[i])) for i in known])
        near = distances_to(metric, [pivots[i] for i in known], side, looped=True)
        best = F.array_min(F.zip_with(near, spread, lambda d, s: d + s))
        bound = F.when(metric.complete(side), best).otherwise(unbounded)
    rows = stage(queries.withColumn("radius", bound), "knn-radius")
    if _PEEK_ROWS * 2 > total:
        return rows
    survey = Survey.of(objects, metric)
    objects = objects.select("id", *metric.columns)
    size = _PEEK_ROWS
    while size * 2 <= total:
        piece = hash_fraction(objects, size, total, hash_key(0))
        closer = crowd_answers(piece, rows, metric, survey, size).select("qid", "id", "dist")
        tight = nearest(closer, k).where(F.col("rank") == k).select("qid", loosened(F.col("dist")).alias("_tight"))
        tighter = rows.join(tight, "qid", "left").withColumn("radius", F.least("radius", "_tight")).drop("_tight")
        rows = stage(tighter, "knn-radius")
        size *= _SLICE_GROWTH
    return rows


def _kth_distances(subset: DataFrame, probes: list[Row], k: int, metric: Metric) -> dict[int, float]:
    """For each probe the k-th smallest distance within ``subset``, which holds
    about _PEEK_ROWS objects; probes that see fewer than k are left out."""
    if not probes:
        return {}
    near = subset.select(F.posexplode(distances_to(metric, probes, columns(metric), looped=True)).alias("probe", "d"))
    kth = near.groupBy("probe").agg(F.get(F.array_sort(F.collect_list("d")), F.lit(k - 1)).alias("kth"))
    return {r["probe"]: r["kth"] for r in kth.collect() if r["kth"] is not None}
