"""Placing arriving objects with Structured Streaming.

The address of an object depends on the object and the tree only, so the stream
keeps no state. Splitting full buckets stays a batch job on what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from nearfield.plans.index import MetricIndex, stored_schema
from nearfield.plans.tree import Tree
from nearfield.session import folder_names, remove_path
from nearfield.sources.buckets import append_buckets

# Input files of one micro-batch, so that a backlog is taken in bounded steps.
FILES_PER_TRIGGER = 1_000


def object_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def place_stream(tree: Tree, arriving: DataFrame) -> DataFrame:
    """Level, bucket and pivot distances of arriving objects."""
    return tree.assign(arriving.select("id", *tree.metric.columns))


def start_placing(index: MetricIndex, arriving: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Write placed objects to a bucketed Parquet sink and stop when the files
    at hand are done.

    Each micro-batch is placed by the tree the index has at that time and goes to
    a folder named by the batch and the tree's version. A batch that runs again
    after a failure overwrites its folder, so every object is there once. Writing
    is rebalanced: a bucket that takes much of a batch is cut over many tasks."""

    def place(batch: DataFrame, number: int) -> None:
        folder = f"{sink}/arrival={number}"
        for name in folder_names(batch.sparkSession, folder):
            remove_path(batch.sparkSession, f"{folder}/{name}")
        append_buckets(place_stream(index.tree, batch), f"{folder}/tree={index.tree_version}")

    return arriving.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def waiting(index: MetricIndex, sink: str) -> list[str]:
    """Folders of the arrivals that the index has not taken in yet."""
    names = [n for n in folder_names(index.spark, sink) if n.startswith("arrival=")]
    return sorted(n for n in names if f"{sink}/{n}" not in index.taken)


def arrived(index: MetricIndex, sink: str) -> DataFrame:
    """Arrivals not yet in the index, in the shape of its objects. Those that
    an older tree placed are placed again by the present one."""
    schema = stored_schema(index.fields)
    paths = [f"{sink}/{name}" for name in waiting(index, sink)]
    if not paths:
        return index.spark.createDataFrame([], schema)
    whole = T.StructType([*schema, T.StructField("arrival", T.LongType()), T.StructField("tree", T.LongType())])
    rows = index.spark.read.schema(whole).option("basePath", sink).parquet(*paths)
    current = rows.where(F.col("tree") == index.tree_version).select(*schema.names)
    older = place_stream(index.tree, rows.where(F.col("tree") != index.tree_version))
    return current.unionByName(older.select(*schema.names))


def with_arrivals(index: MetricIndex, sink: str) -> DataFrame:
    """Stored objects and arrivals together, ready for queries."""
    return index.objects().unionByName(arrived(index, sink))


def absorb(index: MetricIndex, sink: str) -> int:
    """Take arrivals into the index and split the buckets they overfilled.
    Arrivals that were taken in before are left out; returns how many came."""
    names = [f"{sink}/{name}" for name in waiting(index, sink)]
    return index.insert(arrived(index, sink), names) if names else 0
