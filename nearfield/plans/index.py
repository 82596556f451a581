"""The index: objects stored by (level, bucket) plus the small tables that
describe the tree. Built, extended, saved and loaded by ordinary Spark jobs."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from copy import deepcopy
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.distances import Metric
from nearfield.operators.pivots import hash_fraction, hash_key
from nearfield.plans.growth import Limits, grow
from nearfield.plans.tree import MAX_NODES, Level, Tree, depth_of
from nearfield.session import Stages, bounded_rows, folder_names, local_table, lookup_join, path_exists, remove_path, stage
from nearfield.sources.buckets import append_buckets, doomed_ids

SAMPLE_FLOOR = 1_000_000
SAMPLE_PER_BUCKET = 200
# A bucket whose objects lie in more batches than this is written anew.
MAX_BATCHES = 16
MAX_FOLDERS = MAX_NODES * MAX_BATCHES
# Up to so many folders are named one by one in a scan; beyond, partitions are pruned
# while the query runs, by a join with the list of wanted ones.
MAX_PATHS = 2_000

# Distances to the first pivots of the first level, which every object knows, also lie in
# flat columns: rows of a bucket are sorted by them, and scans filter on them.
NEAR = ("near0", "near1")
# Rows of a Parquet page, the least that such a filter can skip.
PAGE_ROWS = 2_000


class MetricIndex:
    """An index over a stored object table.

    ``path/objects`` holds Parquet written batch by batch, partitioned by level and
    bucket. ``path/v=N`` describes version N: the tree (``nodes``, ``pivots``), which
    batch holds how many objects of which bucket (``buckets``), and ``meta``, which is
    written last and makes the version count. A change only adds folders and then a
    version, so a job that fails leaves the last version whole. What a version no longer
    needs is removed when the next change succeeds. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, tree: Tree, limits: Limits, fields: Sequence[T.StructField]):
        self.spark = spark
        self.path = path
        self.tree = tree
        self.limits = limits
        self.fields = list(fields)
        self.version = 0
        # Changes with the tree; rows placed by another tree have to be placed again.
        self.tree_version = 0
        # (level, bucket) -> batch -> objects, and the least and greatest distances of
        # these objects to the pivots of the first level
        self.parts: dict[tuple[int, int], dict[str, int]] = {}
        self.boxes: dict[tuple[int, int], dict[str, Box]] = {}
        # Names of input batches that are in the index already.
        self.taken: set[str] = set()
        self._unused: list[str] = []

    @property
    def counts(self) -> dict[tuple[int, int], int]:
        """Stored objects per bucket."""
        return {key: sum(batches.values()) for key, batches in self.parts.items()}

    # -- building --------------------------------------------------------

    @classmethod
    def build(
        cls,
        objects: DataFrame,
        path: str,
        metric: Metric,
        rho: float = 0.1,
        limits: Limits = Limits(),
        fixed_pivots: Sequence[Row] = (),
        sample_floor: int = SAMPLE_FLOOR,
    ) -> MetricIndex:
        """Bulk build in three steps: grow the tree on a sample, place and write
        every object in one pass, then split the buckets that still overflow.

        When the sample size covers all objects the tree is grown on all. Fixed
        pivots lead the first level only: what their splits exclude lies in the
        middle of those very splits, so they could not divide it again."""
        spark = objects.sparkSession
        if latest_version(spark, path) is not None:
            raise ValueError(f"an index exists at {path}")
        objects = metric.validated(objects.select("id", *metric.columns))
        total = objects.count()
        sized = limits.sized(total)
        tree = Tree(metric, rho, [Level(list(fixed_pivots)[: sized.max_depth])])
        index = cls(spark, path, tree, limits, objects.schema.fields)
        wanted = max(sample_floor, SAMPLE_PER_BUCKET * math.ceil(total / limits.capacity))
        sample = hash_fraction(objects, wanted, total, hash_key(limits.seed))
        scale = 1.0
        with Stages(spark) as stage:
            if wanted < total:
                sample = stage(sample, "build-sample")
                scale = max(1.0, total / max(1, sample.count()))
            else:
                sample = objects = stage(objects, "build-objects")
            grow(tree, sample, scale, sized, {})
            index._write(tree.assign(objects))
        index._split_overflow()
        index.save()
        return index

    @classmethod
    def from_tree(cls, objects: DataFrame, path: str, tree: Tree, limits: Limits = Limits()) -> MetricIndex:
        """An index whose tree is given; full buckets stay as they are until an insert."""
        spark = objects.sparkSession
        if latest_version(spark, path) is not None:
            raise ValueError(f"an index exists at {path}")
        objects = tree.metric.validated(objects.select("id", *tree.metric.columns))
        index = cls(spark, path, tree, limits, objects.schema.fields)
        index._write(tree.assign(objects))
        index.save()
        return index

    @classmethod
    def open_or_build(cls, objects: DataFrame, path: str, metric: Metric, **options) -> MetricIndex:
        """Load a saved index when there is one, build it otherwise."""
        if latest_version(objects.sparkSession, path) is not None:
            return cls.load(objects.sparkSession, path, metric)
        return cls.build(objects, path, metric, **options)

    # -- extending -------------------------------------------------------

    @contextmanager
    def _change(self) -> Iterator[None]:
        """A change that is saved as a whole or, on a failure, forgotten."""
        parts, boxes = ({key: dict(batches) for key, batches in held.items()} for held in (self.parts, self.boxes))
        before = (parts, boxes, deepcopy(self.tree.levels), set(self.taken), self.tree_version)
        self._unused = []
        try:
            yield
            self.save()
        except BaseException:
            self.parts, self.boxes, self.tree.levels, self.taken, self.tree_version = before
            self._unused = []
            raise

    def insert(self, batch: DataFrame, names: Sequence[str] = ()) -> int:
        """Add objects, splitting buckets that overflow; returns how many.

        ``names`` are what the caller calls the batches that the objects come
        from; if all of them were inserted before, nothing is added."""
        if names and self.taken.issuperset(names):
            return 0
        with self._change(), Stages(self.spark) as stage:
            batch = stage(batch.select("id", *self.tree.metric.columns), "insert")
            added = self._write(self.tree.assign(batch))
            self.taken.update(names)
            self._split_overflow()
            self._compact()
        return added

    def _write(self, placed: DataFrame) -> int:
        """Write placed objects as a batch and count them by bucket there."""
        batch = uuid.uuid4().hex[:16]
        path = f"{self.objects_path}/batch={batch}"
        append_buckets(placed.withColumns(near_columns(F.col("pd"))), path, NEAR, PAGE_ROWS)
        if not path_exists(self.spark, path):
            return 0
        written = self.spark.read.schema(stored_schema(self.fields)).parquet(path)
        first = range(len(self.tree.levels[0].pivots))
        dist = [F.get(F.get("pd", F.lit(0)), F.lit(i)) for i in first]
        ends = [F.array(*[end(d) for d in dist]).cast("array<double>").alias(name) for name, end in (("lo", F.min), ("hi", F.max))]
        counts = bounded_rows(written.groupBy("level", "bucket").agg(F.count("*").alias("n"), *ends), MAX_NODES, "buckets")
        for r in counts:
            key = r["level"], r["bucket"]
            self.parts.setdefault(key, {})[batch] = r["n"]
            self.boxes.setdefault(key, {})[batch] = (tuple(r["lo"]), tuple(r["hi"]))
        return sum(r["n"] for r in counts)

    def _leave(self, keys: Iterable[tuple[int, int]]) -> None:
        """Forget what is stored of some buckets; the files go after the save."""
        for level, bucket in keys:
            self.boxes.pop((level, bucket), None)
            for batch in self.parts.pop((level, bucket), {}):
                self._unused.append(f"{self.objects_path}/batch={batch}/level={level}/bucket={bucket}")

    def _compact(self) -> None:
        """Rewrite buckets whose objects lie in many batches."""
        many = [key for key, batches in self.parts.items() if len(batches) > MAX_BATCHES]
        if many:
            with Stages(self.spark) as stage:
                held = stage(self.bucket_objects(many).drop(*NEAR), "compact")
                self._leave(many)
                self._write(held)

    def _split_overflow(self) -> None:
        """Split stored buckets above capacity until none is left that a split
        can make smaller. Only their partitions are read and rewritten; what a
        split excludes moves to later levels and may overflow those in turn."""
        while True:
            counts = self.counts
            over = [key for key, n in counts.items() if n > self.limits.capacity and self._splittable(*key)]
            if not over:
                return
            before = sum(len(lv.nodes) for lv in self.tree.levels)
            with Stages(self.spark) as stage:
                self._regrow(over, counts, stage)
                split = [(level, b) for level, b in over if b in self.tree.levels[level].nodes]
                for level, bucket in over:
                    if (level, bucket) not in split:
                        self.tree.levels[level].final.add(bucket)
                if sum(len(lv.nodes) for lv in self.tree.levels) == before:
                    return
                self.tree_version += 1
                moving = stage(self.bucket_objects(split).select("id", *self.tree.metric.columns), "moving")
                self._leave(split)
                self._write(self.tree.assign(moving))

    def _regrow(self, over: Sequence[tuple[int, int]], counts: Mapping[tuple[int, int], int], stage: Stages) -> None:
        """Grow the tree below the overflowing buckets."""
        held = self.bucket_objects(over).select("id", *self.tree.metric.columns)
        total = sum(counts[key] for key in over)
        wanted = max(SAMPLE_FLOOR, SAMPLE_PER_BUCKET * math.ceil(total / self.limits.capacity))
        sample = stage(hash_fraction(held, wanted, total, hash_key(self.limits.seed)), "overflow")
        kept = {key: n for key, n in counts.items() if key not in set(over)}
        grow(self.tree, sample, max(1.0, total / wanted), self._sized(), kept)

    def _sized(self) -> Limits:
        return self.limits.sized(sum(self.counts.values()))

    def _splittable(self, level: int, bucket: int) -> bool:
        sized = self._sized()
        return level + 1 < sized.max_levels and depth_of(bucket) < sized.max_depth and bucket not in self.tree.levels[level].final

    def delete(self, victims: DataFrame, by: Sequence[str] = ("id",), limit: int | None = None) -> int:
        """Remove objects equal to the given ones; returns how many went. Only
        the buckets that hold some are written anew."""
        with self._change(), Stages(self.spark) as stage:
            stored = self.objects()
            doomed = doomed_ids(stored, victims, by, limit)
            gone = stage(lookup_join(stored.select("id", "level", "bucket"), doomed, ["id"], "left_semi"), "delete-gone")
            rows = bounded_rows(gone.select("level", "bucket").distinct(), MAX_NODES, "buckets")
            touched = [(r["level"], r["bucket"]) for r in rows]
            if touched:
                left = lookup_join(self.bucket_objects(touched).drop(*NEAR), gone.select("id"), ["id"], "left_anti")
                left = stage(left, "delete-survivors")
                self._leave(touched)
                self._write(left)
            return gone.count()

    def drop_buckets(self, level: int, first: int, last: int) -> int:
        """Remove all objects of a level's buckets ``first`` to ``last``; returns how many
        went. Nothing is read: the next version leaves the folders out, and they go with
        the version that still named them. The tree stays, so later objects may come there."""
        with self._change():
            going = [(lv, b) for lv, b in self.parts if lv == level and first <= b <= last]
            count = sum(self.counts_of(key) for key in going)
            self._leave(going)
        return count

    # -- reading ---------------------------------------------------------

    @property
    def objects_path(self) -> str:
        return f"{self.path}/objects"

    def objects(self) -> DataFrame:
        return self.bucket_objects(list(self.parts)).drop(*NEAR)

    def bucket_objects(self, wanted: Sequence[tuple[int, int]], near: Column | None = None) -> DataFrame:
        """Objects of the wanted buckets only, and of them those for which ``near`` holds,
        a filter on the columns ``NEAR`` that reaches the scan.

        Up to ``MAX_PATHS`` folders are named one by one, so a query does not list an
        index of very many buckets; for more, the list joins the scan and prunes its
        partitions at run time."""
        found = sorted((lv, b, batch) for lv, b in set(wanted) & self.parts.keys() for batch in self.parts[lv, b])
        schema = stored_schema(self.fields)
        if not found:
            return self.spark.createDataFrame([], T.StructType([*schema, *(T.StructField(n, T.DoubleType()) for n in NEAR)]))
        whole = T.StructType([*schema, *(T.StructField(n, T.DoubleType()) for n in NEAR), T.StructField("batch", T.StringType())])
        reader = self.spark.read.schema(whole).option("basePath", self.objects_path)
        if len(found) <= MAX_PATHS:
            read = reader.parquet(*[f"{self.objects_path}/batch={batch}/level={lv}/bucket={b}" for lv, b, batch in found])
        else:
            kinds = {"level": pa.int32(), "bucket": pa.int32(), "batch": pa.string()}
            folders = local_table(self.spark, {name: ([f[i] for f in found], kind) for i, (name, kind) in enumerate(kinds.items())})
            # at most one row a folder, whose number is bounded; Spark prunes by a table with a filter
            folders = F.broadcast(stage(folders, "wanted-folders").where(F.col("level") >= 0))
            read = reader.parquet(self.objects_path).join(folders, ["level", "bucket", "batch"], "left_semi")
        if near is not None:
            read = read.where(near)
        return read.select(*schema.names, *NEAR)

    def bucket_boxes(self) -> DataFrame:
        """level, bucket, n, lo and hi: how many objects a bucket holds, and between what
        distances to the pivots of the first level they lie (null where not all know)."""
        rows = [(*key, self.counts_of(key), *joined_boxes(batches.values())) for key, batches in sorted(self.boxes.items())]
        lists = pa.list_(pa.float64())
        kinds = {"level": pa.int32(), "bucket": pa.int32(), "n": pa.int64(), "lo": lists, "hi": lists}
        return local_table(self.spark, {name: ([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})

    def counts_of(self, key: tuple[int, int]) -> int:
        return sum(self.parts[key].values())

    def bucket_counts(self) -> DataFrame:
        """Stored objects per bucket, as of the last change through the index."""
        kinds = {"level": pa.int32(), "bucket": pa.int32(), "n": pa.int64()}
        rows = [(*key, n) for key, n in sorted(self.counts.items())]
        return local_table(self.spark, {name: ([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})

    # -- saving and loading ----------------------------------------------

    def save(self) -> None:
        """Write the next version, ``meta`` last; then drop what the version
        before it left unused, and versions older than that."""
        tree, limits, metric = self.tree, self.limits, self.tree.metric
        tree.check_size()
        version = (latest_version(self.spark, self.path) or 0) + 1
        at = f"{self.path}/v={version}"
        tree.nodes_table(self.spark).coalesce(1).write.mode("overwrite").parquet(f"{at}/nodes")
        pivots_table(self.spark, tree, self.fields).coalesce(1).write.mode("overwrite").parquet(f"{at}/pivots")
        parts = [(*key, batch, n, *self.boxes[key][batch]) for key, batches in sorted(self.parts.items()) for batch, n in sorted(batches.items())]
        lists = pa.list_(pa.float64())
        kinds = {"level": pa.int32(), "bucket": pa.int32(), "batch": pa.string(), "n": pa.int64(), "lo": lists, "hi": lists}
        table = {name: ([r[i] for r in parts], kind) for i, (name, kind) in enumerate(kinds.items())}
        local_table(self.spark, table).coalesce(1).write.mode("overwrite").parquet(f"{at}/buckets")
        for name, values in (("taken", sorted(self.taken)), ("unused", self._unused)):
            local_table(self.spark, {"name": (values, pa.string())}).coalesce(1).write.mode("overwrite").parquet(f"{at}/{name}")
        meta = {
            "rho": ([tree.rho], pa.float64()),
            "levels": ([len(tree.levels)], pa.int32()),
            "capacity": ([limits.capacity], pa.int64()),
            "max_levels": ([limits.max_levels], pa.int32()),
            "max_depth": ([limits.max_depth], pa.int32()),
            "seed": ([limits.seed], pa.int64()),
            "bins": ([limits.bins], pa.int32()),
            "tree_version": ([self.tree_version], pa.int64()),
            "metric": ([metric.name], pa.string()),
        }
        local_table(self.spark, meta).coalesce(1).write.mode("overwrite").parquet(f"{at}/meta")
        self.version = version
        # The version just left may still be in use; the one before it is not.
        before = f"{self.path}/v={version - 1}"
        if path_exists(self.spark, f"{before}/unused"):
            for r in bounded_rows(self.spark.read.parquet(f"{before}/unused"), MAX_FOLDERS, "unused folders"):
                remove_path(self.spark, r["name"])
        remove_path(self.spark, f"{self.path}/v={version - 2}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, metric: Metric) -> MetricIndex:
        version = latest_version(spark, path)
        if version is None:
            raise ValueError(f"no index at {path}")
        at = f"{path}/v={version}"
        meta = spark.read.parquet(f"{at}/meta").first()
        if meta["metric"] != metric.name:
            raise ValueError(f"the index at {path} was built with {meta['metric']}, not {metric.name}")
        levels = [Level() for _ in range(meta["levels"])]
        for r in bounded_rows(spark.read.parquet(f"{at}/nodes"), MAX_NODES, "tree nodes"):
            if r["bucket"] is None:
                levels[r["level"]].nodes[r["node"]] = (r["in_upper"], r["out_lower"])
            elif r["final"]:
                levels[r["level"]].final.add(r["node"])
        stored_pivots = spark.read.parquet(f"{at}/pivots")
        pivots = bounded_rows(stored_pivots, MAX_NODES, "pivots")
        for r in sorted(pivots, key=lambda r: (r["level"], r["pivot_idx"])):
            levels[r["level"]].pivots.append(r)
        names = ("capacity", "max_levels", "max_depth", "seed", "bins")
        limits = replace(Limits(), **{n: meta[n] for n in names})
        fields = [stored_pivots.schema[n] for n in ("id", *metric.columns)]
        index = cls(spark, path, Tree(metric, meta["rho"], levels), limits, fields)
        index.version, index.tree_version = version, meta["tree_version"]
        for r in bounded_rows(spark.read.parquet(f"{at}/buckets"), MAX_FOLDERS, "bucket folders"):
            key = r["level"], r["bucket"]
            index.parts.setdefault(key, {})[r["batch"]] = r["n"]
            index.boxes.setdefault(key, {})[r["batch"]] = (tuple(r["lo"]), tuple(r["hi"]))
        index.taken = {r["name"] for r in bounded_rows(spark.read.parquet(f"{at}/taken"), MAX_FOLDERS, "batch names")}
        return index


Box = tuple[tuple[float | None, ...], tuple[float | None, ...]]


def joined_boxes(boxes: Iterable[Box]) -> tuple[list[float | None], list[float | None]]:
    """The box around boxes; a pivot that some batch does not know bounds nothing."""
    lows, highs = zip(*boxes)
    most = max(map(len, lows))
    known = [all(len(lo) > i and lo[i] is not None for lo in lows) for i in range(most)]
    return (
        [min(lo[i] for lo in lows) if known[i] else None for i in range(most)],
        [max(hi[i] for hi in highs) if known[i] else None for i in range(most)],
    )


def near_columns(pd: Column) -> dict[str, Column]:
    """``NEAR`` from the pivot distances of all levels."""
    return {name: F.get(F.get(pd, F.lit(0)), F.lit(i)) for i, name in enumerate(NEAR)}


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The newest version that was written to its end."""
    numbers = [int(name[2:]) for name in folder_names(spark, path) if name.startswith("v=")]
    whole = [n for n in numbers if path_exists(spark, f"{path}/v={n}/meta/_SUCCESS")]
    return max(whole, default=None)


def stored_schema(fields: Sequence[T.StructField]) -> T.StructType:
    place = [("pd", T.ArrayType(T.ArrayType(T.DoubleType()))), ("level", T.IntegerType()), ("bucket", T.IntegerType())]
    return T.StructType([*fields, *[T.StructField(n, t) for n, t in place]])


def pivots_table(spark: SparkSession, tree: Tree, fields: Sequence[T.StructField]) -> DataFrame:
    schema = T.StructType(
        [T.StructField("level", T.IntegerType()), T.StructField("pivot_idx", T.IntegerType()), *fields]
    )
    rows = [
        (number, i, *[p[f.name] for f in fields])
        for number, level in enumerate(tree.levels)
        for i, p in enumerate(level.pivots)
    ]
    return spark.createDataFrame(rows, schema)


def index_report(nodes: DataFrame, counts: DataFrame, pivots: DataFrame, rho: float, capacity: int) -> DataFrame:
    """State of an index, one row per level: pivots, buckets, objects, mean
    occupation of the soft capacity, deepest bucket, bucket addresses."""
    leaves = nodes.where(F.col("bucket").isNotNull()).join(F.broadcast(counts), ["level", "bucket"], "left")
    leaves = leaves.withColumn("n", F.coalesce("n", F.lit(0)))
    address = F.concat_ws(":", "depth", "bucket")
    per_level = leaves.groupBy("level").agg(
        F.count("*").alias("buckets"),
        F.sum("n").alias("objects"),
        (F.avg("n") / capacity).alias("occupation"),
        F.max("depth").alias("max_depth"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "bucket", address.alias("a")))), lambda b: b["a"]), " ").alias("addresses"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "bucket", "n"))), lambda b: b["n"].cast("string")), " ").alias("counts"),
    )
    shared = pivots.groupBy("level").agg(F.count("*").alias("pivots"))
    return per_level.join(shared, "level", "left").select(
        "level",
        F.lit(rho).alias("rho"),
        F.lit(capacity).cast("long").alias("capacity"),
        F.coalesce("pivots", F.lit(0)).alias("pivots"),
        "buckets",
        "objects",
        "occupation",
        "max_depth",
        "addresses",
        "counts",
    )


def overflowing_buckets(objects: DataFrame, capacity: int) -> DataFrame:
    """Buckets above the soft capacity with their object counts."""
    counts = objects.groupBy("level", "bucket").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > capacity)
