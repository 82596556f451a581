"""Running totals inside groups of any size.

A window keeps one group in one task. Groups above a row limit are instead laid
out by range over (group, order), totalled piece by piece, and shifted by the
totals of the earlier pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.session import SPLIT_KEYS, stage

GROUP_ROWS = 1_000_000
MOST_PIECES = 20_000


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group up to
    and including this one. ``order`` must not leave ties.

    ``df`` is scanned twice, so pass a stage table when it is costly."""
    group, order = list(group), list(order)
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if (total[1] or 0) <= group_rows:
        return _window_total(df, group, order, value, name)

    # No more than SPLIT_KEYS groups can be above this limit.
    limit = max(group_rows, total[0] // SPLIT_KEYS)
    hot = F.broadcast(stage(sizes.where(F.col("_n") > limit).select(*group), "hot-groups"))
    small = _window_total(df.join(hot, group, "left_anti"), group, order, value, name)
    big = df.join(hot, group, "left_semi")
    # A piece only streams through its window, so it may be large; too many would
    # weigh on the shuffle instead.
    pieces = min(MOST_PIECES, max(2, -(-total[0] // group_rows)))
    # The piece number must be fixed before it is used twice: stage it.
    ranged = stage(
        big.withColumn("_v", value)
        .repartitionByRange(pieces, *group, *order)
        .withColumn("_piece", F.spark_partition_id()),
        "ranged-groups",
    )
    keys = group + ["_piece"]
    earlier = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and piece: at most (groups + pieces) rows in all.
    before = (
        ranged.groupBy(keys)
        .agg(F.sum("_v").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    inside = _window_total(ranged, keys, order, F.col("_v"), name)
    shifted = inside.join(before, keys).withColumn(name, F.col(name) + F.col("_before"))
    return small.unionByName(shifted.select(small.columns))


def _window_total(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    window = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(window))
