"""Growing the tree: deciding pivots and split bounds from a sample of objects.

The sample is a staged table spread over the cluster. A step counts its leaves in one
aggregation and splits the full ones, several depths at once, in another: every full leaf
is decided from a bounded sample of its own objects in one task. Only counts and bounds
reach the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from nearfield.functions.distances import Metric, columns, distances_to
from nearfield.operators.pivots import HASH_SPAN, hash_key, incremental_pivots, sample_objects
from nearfield.plans.tree import MAX_NODES, ROOT, Level, Tree, depth_of, in_split_code
from nearfield.session import Stages, bounded_rows, local_table

# A leaf seen through fewer sampled objects than this is not split on a guess.
MIN_SAMPLED = 32
# A full leaf is decided from about so many of its objects, as deep as each side is seen
# through at least DECIDING of them.
NODE_SAMPLE, DECIDING = 16_384, 128
# Sampled counts are noisy: aim below the capacity so few buckets overflow.
HEADROOM = 0.8


@dataclass(frozen=True)
class Limits:
    """``max_levels`` and ``max_depth`` follow from the number of objects where they
    are 0: deep enough for all buckets to fit even if every split and every level
    takes only part of what it is given. ``bins`` is kept for indexes stored with it."""

    capacity: int = 1_000_000
    max_levels: int = 0
    max_depth: int = 0
    seed: int = 0
    bins: int = 4096

    def sized(self, total: int) -> Limits:
        """The limits for ``total`` objects."""
        least = math.ceil(math.log2(max(1.0, total / max(1, self.capacity)))) + 2
        return replace(self, max_levels=self.max_levels or least, max_depth=self.max_depth or least)


def grow(tree: Tree, sample: DataFrame, scale: float, limits: Limits, kept: Mapping[tuple[int, int], int]) -> None:
    """Extend ``tree`` in place until no leaf is expected to overflow.

    ``sample`` holds objects that are going to be (re)placed, each standing for
    ``scale`` of them. ``kept`` counts objects already stored per leaf that are
    not being replaced; such leaves are left as they are."""
    with Stages(sample.sparkSession) as stage:
        _grow(tree, sample, scale, limits, kept, stage)


def _grow(tree: Tree, sample: DataFrame, scale: float, limits: Limits, kept: Mapping[tuple[int, int], int], stage: Stages) -> None:
    metric, side = tree.metric, columns(tree.metric)
    target = limits.capacity * (HEADROOM if scale > 1 else 1.0)
    least = MIN_SAMPLED if scale > 1 else 2
    rest = sample.select("id", *metric.columns)
    n_rest = rest.count()
    for number in range(limits.max_levels):
        if number == len(tree.levels):
            tree.levels.append(Level())
        level = tree.levels[number]
        # The last level takes whatever is left and is never split.
        if n_rest == 0 or number + 1 == limits.max_levels:
            break
        if not level.nodes and (n_rest * scale <= target or kept.get((number, ROOT), 0) or ROOT in level.final):
            break
        pivots = _pivots(rest, n_rest, level, number, limits, metric)
        dists = F.when(in_split_code(F.col("id").isNotNull()), distances_to(metric, pivots, side, checked=False))
        measured = stage(rest.withColumn("_pd", dists), "grow")
        # One job counts the leaves, one splits all that are too full, several depths at
        # once; most levels take one of each.
        counts = {ROOT: n_rest} if not level.nodes else _leaf_counts(tree, measured, number)
        while True:
            full = {
                node: n for node, n in counts.items()
                if node is not None and n * scale > target and n >= least and depth_of(node) < len(pivots)
                and not kept.get((number, node), 0) and node not in level.final
            }
            if not full:
                break
            split = _split(tree.descend(measured, number, compiled=False), full, tree.rho, scale, target, least, len(pivots), limits.seed + number)
            for node, in_upper, out_lower in split:
                if in_upper is None:
                    level.final.add(node)
                elif not kept.get((number, node), 0) and node not in level.final:
                    level.nodes[node] = (in_upper, out_lower)
            tree.check_size()
            counts = _leaf_counts(tree, measured, number)
        level.pivots = pivots[: max(level.depth, len(level.pivots))]
        rest = tree.descend(measured, number, compiled=False).where(F.col("_node").isNull()).select("id", *metric.columns)
        n_rest = counts.get(None, 0) if level.nodes else 0
    if tree.levels[-1].nodes:
        tree.levels.append(Level())


def _leaf_counts(tree: Tree, measured: DataFrame, number: int) -> dict[int | None, int]:
    """Sampled objects per leaf of a level; None counts those that the level excludes."""
    rows = tree.descend(measured, number, compiled=False).groupBy("_node").agg(F.count("*").alias("n"))
    return {r["_node"]: r["n"] for r in bounded_rows(rows, MAX_NODES, "leaves")}


def _split(placed: DataFrame, full: Mapping[int, int], rho: float, scale: float, target: float, least: int, depth: int, seed: int) -> list[tuple]:
    """(node, in_upper, out_lower) for the subtrees of full leaves, without bounds for leaves
    that no split makes smaller. Each leaf is decided in one task from at most about
    ``NODE_SAMPLE`` of its objects, those with the smallest hashes."""
    spark = placed.sparkSession
    nodes = sorted(full)
    keep = [min(HASH_SPAN, -(-NODE_SAMPLE * HASH_SPAN // full[n])) for n in nodes]
    # one row per full leaf, bounded like the tree
    wanted = local_table(spark, {"_node": (nodes, pa.int32()), "_keep": (keep, pa.int64()), "_n": ([full[n] for n in nodes], pa.int64())})
    drawn = placed.join(F.broadcast(wanted), "_node").where(F.pmod(hash_key(seed), F.lit(HASH_SPAN)) < F.col("_keep"))

    def decide(table: pa.Table) -> pa.Table:
        pd = table.column("_pd").combine_chunks()
        matrix = pd.flatten().to_numpy(zero_copy_only=False).reshape(len(pd), -1)
        n = table.column("_n")[0].as_py()
        rows = subtree(table.column("_node")[0].as_py(), matrix, n, rho, scale, target, least, depth)
        kinds = (pa.int32(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], [], []), kinds)], names=["node", "in_upper", "out_lower"])

    found = drawn.select("_node", "_pd", "_n").groupBy("_node").applyInArrow(decide, "node int, in_upper double, out_lower double")
    # parents come before their children
    return sorted((tuple(r) for r in bounded_rows(found, MAX_NODES, "splits")), key=lambda r: r[0])


def subtree(root: int, matrix: np.ndarray, n: int, rho: float, scale: float, target: float, least: int, depth: int) -> list[tuple]:
    """Splits below a leaf with ``n`` objects, decided on the rows of ``matrix``: their
    distances to the pivots of all depths. Leaves seen through too few rows stay whole."""
    weight = n / max(1, len(matrix)) * scale
    few = least if n <= len(matrix) else max(least, DECIDING)
    found, open_ = [], [(root, np.arange(len(matrix)))]
    while open_:
        node, rows = open_.pop()
        at = depth_of(node)
        if at >= depth or len(rows) * weight <= target or len(rows) < few:
            continue
        dist = matrix[rows, at]
        bound = balanced_bound(dist, rho)
        inner = dist <= bound
        if inner.all():
            found.append((node, None, None))
            continue
        found.append((node, float(bound), float(bound + 2 * rho)))
        open_ += [(2 * node, rows[inner]), (2 * node + 1, rows[dist > bound + 2 * rho])]
    return found


def balanced_bound(dist: np.ndarray, rho: float) -> float:
    """The inner bound by the rule of ``balanced_split``, for distances at hand."""
    values, counts = np.unique(dist, return_counts=True)
    inner, n = np.cumsum(counts), len(dist)
    median = values[np.searchsorted(inner, n // 2, "right")]
    if rho == 0:
        return median
    beyond = n - np.concatenate([[0], inner])[np.searchsorted(values, values + 2 * rho, "right")]
    smaller = np.minimum(inner, beyond)
    best = len(values) - 1 - int(smaller[::-1].argmax())
    return median if smaller[best] < n // 4 else values[best]


def _pivots(rest: DataFrame, n_rest: int, level: Level, number: int, limits: Limits, metric: Metric) -> list[Row]:
    """Pivots the level has, then chosen ones, in all one per possible depth."""
    sample = sample_objects(rest, metric, limits.seed + number, total=n_rest)
    return incremental_pivots(rest, metric, sample, limits.max_depth, level.pivots)
