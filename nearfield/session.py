"""Stage tables, size checks and skew-aware joins used by the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"
# Whether the shuffle files of a query go when it ends.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

# Seconds at least between two returns of the driver's free memory.
RETURN_EVERY = 20.0

# A key holding more rows than this is cut up for a shuffled join.
SPLIT_ROWS = 100_000
# At most this many keys are cut: the biggest ones.
SPLIT_KEYS = 100_000

_local_roots: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables: the cluster's checkpoint folder, or one
    that goes with the process when a one-process session names none."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return f"{root.rstrip('/')}/nearfield"
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="nearfield-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


# Stage tables that results of this process may still read, by application.
_staged: dict[str, list[str]] = {}


def stage_path(spark: SparkSession, label: str) -> str:
    path = f"{stage_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged_paths(spark: SparkSession) -> list[str]:
    """The stage tables written so far and not yet released."""
    return list(_staged.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, keep: Sequence[str] = ()) -> int:
    """Remove the stage tables of this process, but for ``keep``; to be called
    when the results that read them are used up. Returns how many went."""
    held = set(keep)
    mine = staged_paths(spark)
    _staged[spark.sparkContext.applicationId] = [p for p in mine if p in held]
    return sum(remove_path(spark, p) for p in mine if p not in held)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    The copy outlives executors, so lineage ends here and rows that depend on
    partition numbers or sampling cannot change on a retry."""
    return _written(df, stage_path(df.sparkSession, label))


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _written(df: DataFrame, path: str) -> DataFrame:
    # What follows reads the table, so nothing needs the shuffle files of the write again;
    # otherwise they fill the executors' disks until the driver collects its garbage.
    with _setting(df.sparkSession, CLEANUP_KEY, "true"):
        df.write.parquet(path)
    return_memory(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# When the driver last returned its free memory, by application.
_returned: dict[str, float] = {}


def return_memory(spark: SparkSession, every: float = RETURN_EVERY) -> bool:
    """Let the driver's JVM drop what ended steps left (broadcast relations, plans, the
    compiler's scratch memory) and hand it back to the system, unless it did so less than
    ``every`` seconds ago. A job of many steps otherwise keeps the peaks of all of them."""
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _returned.setdefault(app, now) < every:
        return False
    _returned[app] = now
    spark._jvm.System.gc()
    try:
        _trim_native_heap(spark)
    except Py4JError:  # a JVM that has no such command
        pass
    return True


def _trim_native_heap(spark: SparkSession) -> None:
    jvm = spark._jvm
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # by way of the public interface: the server's own class is closed to reflection
    methods = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
    invoke = next(m for m in methods if m.getName() == "invoke")
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = commands, "systemTrimNativeHeap"
    invoke.invoke(server, args)


class Stages:
    """Stage tables of a job that ends inside a ``with`` block; all are removed
    when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *error) -> None:
        self.clear()

    def clear(self) -> None:
        """Remove the tables written so far."""
        for path in self.paths:
            remove_path(self.spark, path)
        self.paths = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        path = stage_path(self.spark, label)
        self.paths.append(path)
        return _written(df, path)


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list[Row]:
    """Fetch a table that must be small; refuse instead of truncating."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows


def local_table(spark: SparkSession, columns: dict[str, tuple[Sequence, pa.DataType]]) -> DataFrame:
    """A small driver-side table as a local relation."""
    names = list(columns)
    arrays = [pa.array(list(values), type=kind) for values, kind in columns.values()]
    return spark.createDataFrame(pa.table(arrays, names=names))


def _row_width(df: DataFrame):
    """Approximate bytes of one row, counting what variable-length columns hold."""
    width = F.lit(16 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            width = width + 8 * F.coalesce(F.size(field.name), F.lit(0))
        elif isinstance(field.dataType, T.MapType):
            entries = F.aggregate(
                F.map_values(field.name),
                F.lit(0),
                lambda s, v: s + 64 + (8 * F.size(v) if isinstance(field.dataType.valueType, T.ArrayType) else 0),
            )
            width = width + F.coalesce(entries, F.lit(0))
        elif isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
    return width


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure, within a row bound, whether a table may be broadcast."""
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(_row_width(df)).alias("b")).first()
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    split_on: str = "id",
    right_split_on: str | None = None,
    max_broadcast_rows: int = BROADCAST_ROWS,
    split_rows: int = SPLIT_ROWS,
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Equi-join of a big left side with a right side of unknown size.

    A right side measured as small is broadcast and the left side never moves.
    Otherwise both sides shuffle, and a key with too many rows is cut into a
    grid: its left rows spread over ``_lp`` pieces by hash of ``split_on`` and,
    for inner joins with ``right_split_on``, its right rows over ``_rp`` pieces;
    each piece of one side meets every piece of the other."""
    on = list(on)
    if fits_broadcast(right, max_broadcast_rows, max_broadcast_bytes):
        return left.join(F.broadcast(right), on, how)
    if split_on in on:  # the key names one row of the left side: nothing to cut
        return left.join(right, on, how)

    cut_right = how == "inner" and right_split_on is not None
    size = F.count("*").alias("_nl")
    sizes = left.groupBy(on).agg(size)
    if cut_right:
        sizes = sizes.join(right.groupBy(on).agg(F.count("*").alias("_nr")), on)
    else:
        sizes = sizes.withColumn("_nr", F.lit(0).cast("long"))
    # The biggest keys only, so the list stays small whatever the data looks
    # like: a key left whole has at most 1 / SPLIT_KEYS of all rows.
    sizes = sizes.where((F.col("_nl") > split_rows) | (F.col("_nr") > split_rows))
    sizes = sizes.orderBy(F.desc(F.greatest("_nl", "_nr"))).limit(SPLIT_KEYS)

    def pieces(n: str):
        return F.greatest(F.ceil(F.col(n) / split_rows), F.lit(1)).cast("int")

    hot = F.broadcast(stage(sizes.select(*on, pieces("_nl").alias("_ls"), pieces("_nr").alias("_rs")), "hot-keys"))
    ls, rs = F.coalesce("_ls", F.lit(1)), F.coalesce("_rs", F.lit(1))

    def every(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    def one(column, n):
        return F.pmod(F.xxhash64(column), n).cast("int")

    cut = left.join(hot, on, "left").withColumn("_lp", one(split_on, ls))
    spread = right.join(hot, on, "left").withColumn("_lp", every(ls))
    keys = [*on, "_lp"]
    if cut_right:
        cut = cut.withColumn("_rp", every(rs))
        spread = spread.withColumn("_rp", one(right_split_on, rs))
        keys.append("_rp")
    return cut.drop("_ls", "_rs").join(spread.drop("_ls", "_rs"), keys, how).drop("_lp", "_rp")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders and files right below a folder; none if it is missing."""
    fs, target = _file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []


def remove_path(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.delete(target, True)
