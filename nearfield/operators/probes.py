"""Distances from every object to a handful of given objects.

The given objects ("probes") are few by contract and become literals of the
plan: one narrow projection over the scan, no join and no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from nearfield.functions.distances import CompositeMetric, Metric, columns, distances_to
from nearfield.schema import PRUNE_SLACK

MAX_PROBES = 64


def smallest_ids(objects: DataFrame, n: int) -> list[Row]:
    """The ``n`` objects with the smallest ids."""
    if n > MAX_PROBES:
        raise ValueError(f"at most {MAX_PROBES} probes; use range_query_batch for more")
    return objects.orderBy("id").limit(n).collect()


def distance_report(objects: DataFrame, probe: Row, metric: Metric) -> DataFrame:
    """Distance of every object to one given object."""
    dist = metric.distance(columns(metric), metric.literal(probe))
    return objects.select("id", dist.alias("dist"))


def distances_to_probes(objects: DataFrame, probes: Sequence[Row], value) -> DataFrame:
    """One row per (probe, object); ``value(probe)`` gives the struct or scalar
    column to report for that probe."""
    entries = [F.struct(F.lit(p["id"]).alias("qid"), value(p).alias("value")) for p in probes]
    return objects.select("id", F.explode(F.array(*entries)).alias("e")).select("e.qid", "id", "e.value")


def breakdown_to_probes(objects: DataFrame, probes: Sequence[Row], metric: CompositeMetric) -> DataFrame:
    """Component distances and their sum to each probe."""
    side = columns(metric)
    rows = distances_to_probes(objects, probes, lambda p: metric.breakdown(side, metric.literal(p)))
    return rows.select("qid", "id", "value.*")


def with_pivot_distances(
    objects: DataFrame, pivots: Sequence[Row], metric: Metric, name: str = "pd", checked: bool = True
) -> DataFrame:
    """Add the distances to all pivots as one array in pivot order, computed
    once and reused by addressing and by the pivot filters."""
    return objects.withColumn(name, distances_to(metric, pivots, columns(metric), checked))


def pivot_distances(objects: DataFrame, pivots: Sequence[Row], metric: Metric) -> DataFrame:
    """The same distances as rows (id, pivot_idx, dist)."""
    listed = with_pivot_distances(objects, pivots, metric)
    return listed.select("id", F.posexplode("pd").alias("pivot_idx", "dist"))


def pivot_gap_at_most(a: Column, b: Column, radius: Column, pivots: int) -> Column:
    """False when some pivot proves that two objects are farther apart than
    ``radius``: the distances to that pivot differ by more. A distance that is
    not known proves nothing."""
    keep = F.lit(True)
    for i in range(pivots):
        gap = F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i)))
        slack = PRUNE_SLACK * (1 + radius + F.abs(F.get(b, F.lit(i))))
        keep = keep & F.coalesce(gap <= radius + slack, F.lit(True))
    return keep


def pivot_sum_at_most(a: Column, b: Column, radius: Column, pivots: int) -> Column:
    """True when some pivot proves that two objects are within ``radius``: the
    two distances to it add up to no more."""
    accept = F.lit(False)
    for i in range(pivots):
        total = F.get(a, F.lit(i)) + F.get(b, F.lit(i))
        accept = accept | F.coalesce(total <= radius, F.lit(False))
    return accept
