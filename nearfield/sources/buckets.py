"""Objects stored by (level, bucket): scan, append, delete, drop, look up."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.session import Stages, bounded_rows, lookup_join, remove_path

KEYS = ("level", "bucket")
# Bucket numbers are handled on the driver up to this many.
MAX_BUCKETS = 500_000


def read_buckets(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_bucket(objects: DataFrame, level: int, bucket: int) -> DataFrame:
    """One bucket; on a stored table this reads one partition."""
    return objects.where((F.col("level") == level) & (F.col("bucket") == bucket))


def bucket_filter(buckets: Iterable[tuple[int, int]]) -> Column:
    """A partition filter for a list of buckets."""
    by_level: dict[int, list[int]] = {}
    for level, bucket in buckets:
        by_level.setdefault(level, []).append(bucket)
    keep = F.lit(False)
    for level, numbers in sorted(by_level.items()):
        keep = keep | ((F.col("level") == level) & F.col("bucket").isin(*sorted(numbers)))
    return keep


def append_buckets(objects: DataFrame, path: str, order: Sequence[str] = (), page_rows: int | None = None) -> None:
    """Add objects to their buckets. Rebalancing puts rows of one bucket
    together, joins small buckets in one task and cuts a big one over many.

    With ``order`` the rows of a file are sorted by these columns, so that a pushed
    filter on them skips row groups and pages (of ``page_rows`` rows at most)."""
    keys = [F.col(k) for k in KEYS]
    rows = objects.hint("rebalance", *keys)
    if order:
        rows = rows.sortWithinPartitions(*KEYS, *order)
    writer = rows.write.mode("append").partitionBy(*KEYS)
    if page_rows is not None:
        writer = writer.option("parquet.page.row.count.limit", page_rows)
    writer.parquet(path)


def drop_buckets(spark: SparkSession, path: str, buckets: Iterable[tuple[int, int]]) -> int:
    """Delete whole buckets; returns how many were there."""
    return sum(remove_path(spark, f"{path}/level={level}/bucket={bucket}") for level, bucket in buckets)


def drop_bucket_range(spark: SparkSession, path: str, level: int, low: int, high: int) -> int:
    """Delete the buckets numbered ``low`` to ``high`` inclusive of one level."""
    numbers = read_buckets(spark, path).where((F.col("level") == level) & F.col("bucket").between(low, high))
    return drop_buckets(spark, path, _bucket_list(numbers))


def without_bucket_range(objects: DataFrame, low: int, high: int, column: str = "bucket") -> DataFrame:
    """The same drop as a view: every object outside the bucket range."""
    return objects.where(~F.col(column).between(low, high))


def doomed_ids(objects: DataFrame, victims: DataFrame, by: Sequence[str] = ("id",), limit: int | None = None) -> DataFrame:
    """Ids of the objects that equal some victim on ``by`` (null equals null).

    With ``limit``, at most that many per distinct victim, lowest ids first;
    Spark keeps only that many rows per value and task before the shuffle."""
    by = list(by)
    if by == ["id"] and limit is None:
        return victims.select("id").distinct()
    # A digest keeps the join key short however long a vector is.
    match = F.sha2(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}), 256).alias("_match")
    hit = lookup_join(objects.select("id", match), victims.select(match).distinct(), ["_match"], "left_semi")
    if limit is not None:
        order = F.row_number().over(Window.partitionBy("_match").orderBy("id"))
        hit = hit.withColumn("_n", order).where(F.col("_n") <= limit)
    return hit.select("id")


def without_objects(objects: DataFrame, victims: DataFrame, by: Sequence[str] = ("id",), limit: int | None = None) -> DataFrame:
    """The objects that a delete of ``victims`` leaves."""
    return lookup_join(objects, doomed_ids(objects, victims, by, limit), ["id"], "left_anti")


def delete_objects(spark: SparkSession, path: str, victims: DataFrame, by: Sequence[str] = ("id",), limit: int | None = None) -> int:
    """Delete objects from a stored table, rewriting only the buckets that hold
    some; returns how many went."""
    with Stages(spark) as stage:
        stored = read_buckets(spark, path)
        doomed = doomed_ids(stored, victims, by, limit)
        gone = stage(lookup_join(stored.select("id", *KEYS), doomed, ["id"], "left_semi"), "delete-gone")
        touched = _bucket_list(gone)
        if not touched:
            return 0
        part = stored.where(bucket_filter(touched))
        survivors = stage(lookup_join(part, gone.select("id"), ["id"], "left_anti"), "delete-survivors")
        left = _bucket_list(survivors)
        keys = [F.col(k) for k in KEYS]
        writer = survivors.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*KEYS)
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
        drop_buckets(spark, path, touched - left)
        return gone.count()


def _bucket_list(objects: DataFrame) -> set[tuple[int, int]]:
    rows = bounded_rows(objects.select(*KEYS).distinct(), MAX_BUCKETS, "buckets")
    return {(r["level"], r["bucket"]) for r in rows}


def bucket_counts(objects: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Objects per bucket, counted where they lie before anything is shuffled."""
    return objects.groupBy(*keys).agg(F.count("*").alias("n"))


def lookup_key(objects: DataFrame, key: int) -> DataFrame:
    return objects.where(F.col("id") == key)


def lookup_keys(objects: DataFrame, keys: DataFrame) -> DataFrame:
    return lookup_join(objects, keys.select("id").distinct(), ["id"], "left_semi")


def lookup_key_range(objects: DataFrame, low: int, high: int, column: str = "id") -> DataFrame:
    """Objects whose key lies in the inclusive interval; pushed to the scan."""
    return objects.where(F.col(column).between(low, high))

