"""Excluded-middle splits: choosing the bounds and applying them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.zones import EXCLUDED, INNER, OUTER, zone_of
from nearfield.operators.ordering import GROUP_ROWS, running_total
from nearfield.session import lookup_join, stage


def balanced_split(
    distances: DataFrame,
    keys: Sequence[str],
    rho: float,
    dist: str = "dist",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Exact split bounds per group of distances: (keys, in_upper, out_lower).

    The inner bound is the distance that makes the smaller of the inner and
    outer parts largest, ties to the larger distance. When even the best leaves
    a part under a quarter of the group, the bound is the upper median. For
    rho = 0 it is always the upper median. The outer bound is the inner bound
    plus twice rho."""
    keys = list(keys)
    # Equal distances combine before they move; a group of copies is one row.
    counted = stage(distances.groupBy(*keys, F.col(dist).alias("_d")).agg(F.count("*").alias("_c")), "split-distances")
    sizes = counted.groupBy(keys).agg(F.sum("_c").alias("_n"))
    if rho == 0:
        ranked = running_total(counted, keys, ["_d"], F.col("_c"), "_in", group_rows)
        ranked = lookup_join(ranked, sizes, keys, split_on="_d")
        bound = ranked.where(F.expr("_in > _n div 2")).groupBy(keys).agg(F.min("_d").alias("in_upper"))
        return bound.withColumn("out_lower", F.col("in_upper"))

    # Each distance asks two counts: how many lie up to it, and how many up to
    # it plus 2 rho. Both come from one running total over data and probes.
    points = counted.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("_d").alias("_at"), F.lit(0).alias("_probe"), "_d", "_c"),
                F.struct((F.col("_d") + 2 * rho).alias("_at"), F.lit(1).alias("_probe"), "_d", F.lit(0).cast("long").alias("_c")),
            )
        ).alias("_p"),
    ).select(*keys, "_p.*")
    ranked = running_total(points, keys, ["_at", "_probe", "_d"], F.col("_c"), "_cum", group_rows)
    per_distance = ranked.groupBy(*keys, "_d").agg(
        F.max(F.when(F.col("_probe") == 0, F.col("_cum"))).alias("_in"),
        F.max(F.when(F.col("_probe") == 1, F.col("_cum"))).alias("_upto"),
    )
    per_distance = lookup_join(per_distance, sizes, keys, split_on="_d")
    smaller = F.least(F.col("_in"), F.col("_n") - F.col("_upto"))
    best = per_distance.groupBy(keys).agg(
        F.max(F.struct(smaller.alias("m"), F.col("_d").alias("d"))).alias("_best"),
        F.min(F.when(F.expr("_in > _n div 2"), F.col("_d"))).alias("_median"),
        F.max("_n").alias("_n"),
    )
    in_upper = F.when(F.expr("_best.m < _n div 4"), F.col("_median")).otherwise(F.col("_best.d"))
    return best.select(*keys, in_upper.alias("in_upper")).withColumn("out_lower", F.col("in_upper") + 2 * rho)


def median_split(distances: DataFrame, keys: Sequence[str], dist: str = "dist", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Bounds without an excluded middle: the upper median of each group."""
    return balanced_split(distances, keys, 0.0, dist, group_rows)


def histogram_split(distances: DataFrame, key: str, rho: float, low: float, high: float, bins: int, dist: str = "dist") -> DataFrame:
    """Near-balanced bounds per group from a fixed-width histogram.

    Only (group, bin) counts are shuffled and sorted, at most ``bins`` rows per
    group whatever its size. The bound is always a distance that occurs, so the
    rule of ``balanced_split`` holds up to one bin; any bound gives right
    answers, only balance depends on it."""
    width = (high - low) / bins or 1.0
    bin_of = F.least(F.floor((F.col(dist) - low) / width), F.lit(bins - 1)).cast("long")
    # Bins this far ahead hold only distances beyond a bin's largest plus 2 rho.
    ahead = int(2 * rho / width) + 2
    counts = distances.groupBy(key, bin_of.alias("_bin")).agg(
        F.count("*").alias("_c"), F.max(dist).alias("_hi"), F.min(dist).alias("_lo")
    )
    group = Window.partitionBy(key)
    order = group.orderBy("_bin")
    counts = counts.select(
        key,
        "_hi",
        F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_in"),
        F.coalesce(F.sum("_c").over(order.rangeBetween(ahead, Window.unboundedFollowing)), F.lit(0)).alias("_out"),
        F.sum("_c").over(group).alias("_n"),
        F.min("_lo").over(group).alias("_low"),
        F.max("_hi").over(group).alias("_high"),
    )
    picked = counts.groupBy(key).agg(
        F.max(F.struct(F.least("_in", "_out").alias("m"), F.col("_hi").alias("d"), F.col("_in").alias("n"))).alias("_best"),
        F.min(F.when(F.expr("_in > _n div 2"), F.struct(F.col("_hi").alias("d"), F.col("_in").alias("n")))).alias("_median"),
        F.max("_n").alias("n"),
        F.max("_low").alias("low"),
        F.max("_high").alias("high"),
    )
    poor = F.expr("_best.m < n div 4") if rho > 0 else F.lit(True)
    return picked.select(
        key,
        "n",
        "low",
        "high",
        F.when(poor, F.col("_median.d")).otherwise(F.col("_best.d")).alias("in_upper"),
        F.when(poor, F.col("_median.n")).otherwise(F.col("_best.n")).alias("n_inner"),
    )


def three_way_split(distances: DataFrame, bounds: DataFrame, keys: Sequence[str], dist: str = "dist") -> DataFrame:
    """Add ``zone`` to every object from its group's bounds; nothing moves
    between buckets until the result is written."""
    joined = lookup_join(distances, bounds, keys)
    return joined.withColumn("zone", zone_of(F.col(dist), F.col("in_upper"), F.col("out_lower")))


def split_report(zoned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percent of each group that fell inside, in the middle and outside."""

    def share(zone: int):
        return F.avg((F.col("zone") == zone).cast("double")) * 100

    return zoned.groupBy(*keys).agg(
        share(INNER).alias("pct_in"), share(EXCLUDED).alias("pct_excl"), share(OUTER).alias("pct_out")
    )
