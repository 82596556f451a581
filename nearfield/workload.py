"""The registered queries, run on tables derived from the given ones."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import descriptors as desc
from nearfield.functions.distances import CompositeMetric, MapMetric, NumberMetric, VectorMetric, columns
from nearfield.functions.zones import zone_of
from nearfield.operators import answers, maps, pivots, probes, similarity, splits
from nearfield.plans import index as indexes
from nearfield.plans import search
from nearfield.plans.growth import Limits
from nearfield.plans.index import MetricIndex
from nearfield.plans.tree import Level, Tree
from nearfield.session import stage, stage_path
from nearfield.sources import buckets, generator, text_records
from nearfield.streaming import arrivals

METRIC = CompositeMetric(length=3)
RHO = 0.1
N_QUERIES = 10
# The many-query entries ask for every object whose id this divides; see ``many`` and ``every_one``.
EVERY, SHRINK = 50, 5.5
K = 5
ROUND = 6

# Fixed values of the small hand-made index: bounds near the median distance.
ROOT_BOUND, INNER_BOUND = 0.9, 0.7
FIXED_CAPACITY = 100

Query = Callable[[SparkSession, str], DataFrame]


# -- inputs ---------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metric_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object per order: price as the number; balance, day and nation of
    its customer as the vector; the nation also as a group."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    # customers grow with the orders: their table must not pass through the driver
    joined = orders.join(customer.hint("merge"), orders.o_custkey == customer.c_custkey)
    return joined.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") / 500000).alias("number"),
        F.array(
            (F.col("c_acctbal") + 1000) / 11000,
            F.dayofyear("o_orderdate") / F.lit(366.0),
            F.col("c_nationkey") / F.lit(25.0),
        ).alias("vector"),
        F.col("c_nationkey").alias("grp"),
    )


def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``metric_objects`` written once, for queries that read them several times."""
    return stage(metric_objects(spark, sf_dir), "objects")


def map_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same objects as maps; some lack a vector, some have an extra name."""
    o = metric_objects(spark, sf_dir)
    entries = F.array(
        F.struct(F.lit("number").alias("k"), F.array("number").alias("v")),
        F.when(F.col("id") % 3 != 0, F.struct(F.lit("vector").alias("k"), F.col("vector").alias("v"))),
        F.when(F.col("id") % 2 == 0, F.struct(F.lit("extra").alias("k"), F.array(F.col("grp") / F.lit(25.0)).alias("v"))),
    )
    present = F.filter(entries, lambda e: e.isNotNull())
    return o.select("id", F.map_from_entries(present).alias("descriptors"))


def batch(objects: DataFrame, radius: float, n: int = N_QUERIES) -> DataFrame:
    """Range queries around the objects with the smallest ids."""
    first = objects.orderBy("id").limit(n).select(F.col("id").alias("qid"), "number", "vector")
    return stage(first.withColumn("radius", F.lit(radius)), "queries")


def every_one(objects: DataFrame, radius: float) -> DataFrame:
    """Range queries around every object with an id divisible by ``EVERY``, at the radius
    given, whatever the size of the table."""
    chosen = objects.where(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), "number", "vector")
    return stage(chosen.withColumn("radius", F.lit(radius)), "queries")


def many(objects: DataFrame, radius: float) -> DataFrame:
    """The queries of ``every_one`` at a radius that falls with the fourth root of the table's
    rows, as many as objects have dimensions, so that a query has about as many answers at
    any size."""
    return every_one(objects, round(radius * SHRINK / math.sqrt(math.sqrt(max(1, objects.count()))), 6))


def first_objects(objects: DataFrame, n: int):
    return probes.smallest_ids(objects.select("id", "number", "vector"), n)


def fixed_tree(objects: DataFrame) -> Tree:
    """Three leaves on one split level: the root splits by the object with the
    smallest id, its inner child by the next one."""
    bounds = {1: (ROOT_BOUND, ROOT_BOUND + 2 * RHO), 2: (INNER_BOUND, INNER_BOUND + 2 * RHO)}
    return Tree(METRIC, RHO, [Level(first_objects(objects, 2), bounds), Level()])


def fixed_objects(spark: SparkSession, sf_dir: str) -> tuple[Tree, DataFrame]:
    return _fixed(metric_objects(spark, sf_dir))


def _fixed(objects: DataFrame) -> tuple[Tree, DataFrame]:
    tree = fixed_tree(objects)
    return tree, tree.assign(objects)


_indexes: dict[tuple[str, str], MetricIndex] = {}


def limits_for(count: int) -> Limits:
    return Limits(capacity=min(1_000_000, max(1000, count // 64)))


def built_index(spark: SparkSession, sf_dir: str) -> MetricIndex:
    """An index over all objects, built once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        objects = stored_objects(spark, sf_dir)
        fixed = first_objects(objects, 2)
        _indexes[key] = MetricIndex.build(
            objects, stage_path(spark, "index"), METRIC, rho=RHO / 2, limits=limits_for(objects.count()), fixed_pivots=fixed
        )
    return _indexes[key]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, ROUND) for n in names})


# -- sources and sinks ----------------------------------------------------


def ingest_objects_text(spark, sf_dir):
    path = stage_path(spark, "text")
    text_records.write_objects_text(metric_objects(spark, sf_dir), path)
    good, _ = text_records.read_objects_text(spark, path)
    return good.select("id", "number", *[F.get("vector", F.lit(i)).alias(f"v{i}") for i in range(3)])


def export_objects_text(spark, sf_dir):
    path = stage_path(spark, "text")
    text_records.write_objects_text(metric_objects(spark, sf_dir), path, places=6)
    records = text_records.read_records(spark, path)
    return records.select(
        F.substring_index("record", "\n", 1).cast("long").alias("id"), F.rtrim("record", F.lit("\n")).alias("record")
    )


def ingest_text_keys(spark, sf_dir):
    """Objects whose keys are words, through text and back."""
    path = stage_path(spark, "text")
    named = metric_objects(spark, sf_dir).withColumn("id", F.format_string("order %d/%d", "id", "grp"))
    text_records.write_objects_text(named, path)
    good, _ = text_records.read_objects_text(spark, path, key="string")
    return good.select("id", "number", F.get("vector", F.lit(1)).alias("v1"))


def ingest_map_text(spark, sf_dir):
    """Map objects through text and back."""
    path = stage_path(spark, "text")
    text_records.write_maps_text(map_objects(spark, sf_dir), path)
    good, _ = text_records.read_maps_text(spark, path)
    value = lambda name, i: F.get(F.try_element_at("descriptors", F.lit(name)), F.lit(i))
    return good.select(
        "id", value("number", 0).alias("number"), *[value("vector", i).alias(f"v{i}") for i in range(3)], value("extra", 0).alias("extra")
    )


def rejected_records(spark, sf_dir):
    """Some records get a key that is no number, others a broken number or vector."""
    path = stage_path(spark, "text")
    record = text_records.record_text()
    record = F.when(F.col("id") % 5 == 0, F.concat(record, F.lit(",?"))).otherwise(record)
    record = F.when(F.col("id") % 7 == 0, F.regexp_replace(record, r"number,vector\n[^\n]*", "number,vector\nn/a")).otherwise(record)
    record = F.when(F.col("id") % 11 == 0, F.regexp_replace(record, "^#key ", "#key x")).otherwise(record)
    metric_objects(spark, sf_dir).select(record).write.text(path)
    _, rejected = text_records.read_objects_text(spark, path)
    return rejected.select(F.regexp_extract("record", r"^x?(\d+)", 1).cast("long").alias("id"), "error")


def scan_objects(spark, sf_dir):
    _, objects = fixed_objects(spark, sf_dir)
    path = stage_path(spark, "buckets")
    buckets.append_buckets(objects, path)
    return buckets.scan_bucket(buckets.read_buckets(spark, path), 0, 3).select("id", "bucket")


def append_objects(spark, sf_dir):
    _, objects = fixed_objects(spark, sf_dir)
    path = stage_path(spark, "buckets")
    buckets.append_buckets(objects.where(F.col("id") % 2 == 0), path)
    buckets.append_buckets(objects.where(F.col("id") % 2 == 1), path)
    return buckets.bucket_counts(buckets.read_buckets(spark, path), ["grp"])


def delete_objects(spark, sf_dir):
    _, objects = fixed_objects(spark, sf_dir)
    path = stage_path(spark, "buckets")
    buckets.append_buckets(objects, path)
    victims = batch(objects, 0.0).select(F.col("qid").alias("id"))
    buckets.delete_objects(spark, path, victims)
    return buckets.read_buckets(spark, path).select("id")


def drop_bucket_range(spark, sf_dir):
    objects = metric_objects(spark, sf_dir).withColumns({"level": F.lit(0), "bucket": F.col("grp")})
    path = stage_path(spark, "buckets")
    buckets.append_buckets(objects, path)
    buckets.drop_bucket_range(spark, path, 0, 5, 9)
    return buckets.read_buckets(spark, path).select("id", "grp")


def lookup_key(spark, sf_dir):
    return buckets.lookup_key(metric_objects(spark, sf_dir), 7).select("id", "number")


def lookup_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("id"))
    return buckets.lookup_keys(metric_objects(spark, sf_dir), keys).select("id", "number")


def lookup_key_range(spark, sf_dir):
    return buckets.lookup_key_range(metric_objects(spark, sf_dir), 100, 4999).select("id", "number")


def generate_random_objects(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    made = generator.random_objects_for(ids)
    return made.select("id", "number", *[F.get("vector", F.lit(i)).alias(f"v{i}") for i in range(3)])


def index_roundtrip(spark, sf_dir):
    saved = built_index(spark, sf_dir)
    loaded = MetricIndex.load(spark, saved.path, METRIC)
    queries = batch(metric_objects(spark, sf_dir), 0.1)
    return rounded(search.range_query_indexed(loaded.tree, loaded, queries), "dist")


def _fixed_index(spark, sf_dir):
    """A stored index over the small hand-made tree."""
    objects = metric_objects(spark, sf_dir)
    return MetricIndex.from_tree(objects, stage_path(spark, "index"), fixed_tree(objects))


def index_delete(spark, sf_dir):
    """From a stored index: one object with the data of each of ten goes, read again from its folder."""
    index = _fixed_index(spark, sf_dir)
    victims = batch(index.objects(), 0.0).select("number", "vector")
    index.delete(victims, by=("number", "vector"), limit=1)
    return MetricIndex.load(spark, index.path, METRIC).objects().select("id", "level", "bucket")


def index_drop_buckets(spark, sf_dir):
    """A range of buckets of a stored index goes as one change."""
    index = _fixed_index(spark, sf_dir)
    index.drop_buckets(0, 4, 5)
    return MetricIndex.load(spark, index.path, METRIC).objects().select("id", "level", "bucket")


def bucket_counts(spark, sf_dir):
    return buckets.bucket_counts(metric_objects(spark, sf_dir), ["grp"])


# -- distances and descriptors --------------------------------------------


def _pairs(spark, sf_dir, metric):
    objects = metric_objects(spark, sf_dir)
    side = columns(metric)
    near = first_objects(objects, N_QUERIES)
    return probes.distances_to_probes(objects, near, lambda p: metric.distance(side, metric.literal(p)))


def dist_number(spark, sf_dir):
    return _pairs(spark, sf_dir, NumberMetric()).withColumnRenamed("value", "d_number")


def dist_vector_l2(spark, sf_dir):
    return rounded(_pairs(spark, sf_dir, VectorMetric(3)).withColumnRenamed("value", "d_vector"), "d_vector")


def dist_vector_l2_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    metric = VectorMetric()
    near = probes.smallest_ids(vectors, 3)
    side = columns(metric)
    rows = probes.distances_to_probes(vectors, near, lambda p: metric.distance(side, metric.literal(p)))
    return rounded(rows.withColumnRenamed("value", "d_vector"), "d_vector")


def dist_composite_sum(spark, sf_dir):
    objects = metric_objects(spark, sf_dir)
    rows = probes.breakdown_to_probes(objects, first_objects(objects, N_QUERIES), METRIC)
    return rounded(rows, "d_vector", "dist")


def dist_map_sum(spark, sf_dir):
    objects = map_objects(spark, sf_dir)
    metric = MapMetric()
    side = columns(metric)
    near = probes.smallest_ids(objects, N_QUERIES)
    rows = probes.distances_to_probes(objects, near, lambda p: metric.distance(side, metric.literal(p)))
    # Often a bare difference of prices, with exact ties at six places: keep nine.
    return rows.select("qid", "id", F.round("value", 9).alias("dist"))


def distance_report(spark, sf_dir):
    objects = metric_objects(spark, sf_dir)
    return rounded(probes.distance_report(objects, first_objects(objects, 1)[0], METRIC), "dist")


def data_equal_groups(spark, sf_dir):
    cut = lambda c: F.floor(c * 10) / 10
    coarse = metric_objects(spark, sf_dir).select(
        "id", cut(F.col("number")).alias("number"), F.transform("vector", cut).alias("vector")
    )
    return desc.equal_groups(coarse).select("number", F.array_join(F.col("vector").cast("array<decimal(9,1)>"), ",").alias("vector"), "n")


def project_descriptor(spark, sf_dir):
    objects = map_objects(spark, sf_dir)
    return objects.select(
        "id",
        F.size(desc.descriptor_names("descriptors")).alias("n_names"),
        desc.descriptor("descriptors", "vector").isNotNull().alias("has_vector"),
        F.get(desc.descriptor("descriptors", "number"), F.lit(0)).alias("number"),
        F.size(desc.restrict("descriptors", ["number", "extra"])).alias("n_restricted"),
    )


def object_size_bytes(spark, sf_dir):
    return metric_objects(spark, sf_dir).select("id", desc.object_bytes().alias("bytes"))


def object_size_bytes_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("id"), desc.object_bytes(None, "embedding").alias("bytes"))


def object_label(spark, sf_dir):
    return metric_objects(spark, sf_dir).select("id", desc.object_label().alias("label"))


# -- splits and addresses -------------------------------------------------


def grouped_distances(spark, sf_dir):
    """Distance of every object to the one with the smallest id, with groups."""
    objects = metric_objects(spark, sf_dir)
    pivot = first_objects(objects, 1)[0]
    return objects.select("id", "grp", METRIC.distance(columns(METRIC), METRIC.literal(pivot)).alias("dist"))


def zone(spark, sf_dir):
    low, high = F.lit(ROOT_BOUND), F.lit(ROOT_BOUND + 2 * RHO)
    return grouped_distances(spark, sf_dir).select("id", zone_of(F.col("dist"), low, high).alias("zone"))


def balanced_split(spark, sf_dir):
    return rounded(splits.balanced_split(grouped_distances(spark, sf_dir), ["grp"], RHO), "in_upper", "out_lower")


def median_split(spark, sf_dir):
    return rounded(splits.median_split(grouped_distances(spark, sf_dir), ["grp"]), "in_upper", "out_lower")


def _zoned(spark, sf_dir):
    distances = grouped_distances(spark, sf_dir)
    bounds = stage(splits.balanced_split(distances, ["grp"], RHO), "bounds")
    return splits.three_way_split(distances, bounds, ["grp"])


def three_way_split(spark, sf_dir):
    return _zoned(spark, sf_dir).select("id", "zone")


def split_report(spark, sf_dir):
    return rounded(splits.split_report(_zoned(spark, sf_dir), ["grp"]), "pct_in", "pct_excl", "pct_out")


def choose_pivots(spark, sf_dir):
    objects = metric_objects(spark, sf_dir)
    key = F.md5(F.concat(F.lit("0:"), F.col("id").cast("string")).cast("binary"))
    chosen = pivots.choose_pivots(objects, METRIC, 3, key=key)  # each task hands on its few smallest keys
    rank = F.create_map(*[F.lit(x) for i, p in enumerate(chosen) for x in (p["id"], i)])
    picked = objects.where(F.col("id").isin([p["id"] for p in chosen]))
    return picked.select(F.try_element_at(rank, F.col("id")).alias("pivot_idx"), "id")


def pivot_distances(spark, sf_dir):
    objects = metric_objects(spark, sf_dir)
    return rounded(probes.pivot_distances(objects, first_objects(objects, 2), METRIC), "dist")


def assign_address(spark, sf_dir):
    return fixed_objects(spark, sf_dir)[1].select("id", "level", "bucket")


def overflowing_buckets(spark, sf_dir):
    return indexes.overflowing_buckets(fixed_objects(spark, sf_dir)[1], FIXED_CAPACITY)


def _placed(objects: DataFrame) -> DataFrame:
    """Objects as an index stores them, with the stored distance to its first pivot."""
    pd0 = F.get(F.get("pd", F.lit(0)), F.lit(0))
    return objects.select("id", "number", F.round(pd0, ROUND).alias("pd0"))


def bulk_build(spark, sf_dir):
    return _placed(built_index(spark, sf_dir).objects())


def incremental_insert(spark, sf_dir):
    objects = stored_objects(spark, sf_dir)
    even, odd = objects.where(F.col("id") % 2 == 0), objects.where(F.col("id") % 2 == 1)
    index = MetricIndex.build(
        even, stage_path(spark, "index"), METRIC, rho=RHO / 2, limits=limits_for(even.count()), fixed_pivots=first_objects(objects, 2)
    )
    index.insert(odd)
    return _placed(index.objects())


def _split_in_two(spark, sf_dir, keep):
    """An index over part of the objects, and the others."""
    objects = stored_objects(spark, sf_dir)
    first = objects.where(keep)
    index = MetricIndex.build(
        first, stage_path(spark, "index"), METRIC, rho=RHO / 2, limits=limits_for(first.count()), fixed_pivots=first_objects(objects, 2)
    )
    return index, objects


def incremental_insert_answers(spark, sf_dir, ask=batch):
    """Range queries over an index that took half of its objects later."""
    index, objects = _split_in_two(spark, sf_dir, F.col("id") % 2 == 0)
    index.insert(objects.where(F.col("id") % 2 == 1))
    return rounded(search.range_query_indexed(index.tree, index, ask(objects, 0.2)), "dist")


def stream_answers(spark, sf_dir, ask=batch):
    """Range queries over an index and arrivals placed before it was extended."""
    index, objects = _split_in_two(spark, sf_dir, F.col("id") % 4 == 0)
    source, sink, state = (stage_path(spark, n) for n in ("arriving", "placed", "stream"))
    objects.where(F.col("id") % 4 == 1).select("id", "number", "vector").write.parquet(source)
    stream = arrivals.object_stream(spark, source, spark.read.parquet(source).schema)
    arrivals.start_placing(index, stream, sink, state).awaitTermination()
    index.insert(objects.where(F.col("id") % 4 >= 2))
    found = search.range_query_indexed(index.tree, arrivals.with_arrivals(index, sink), ask(objects, 0.2))
    return rounded(found, "dist")


def index_report(spark, sf_dir):
    tree, objects = fixed_objects(spark, sf_dir)
    pivot_rows = indexes.pivots_table(spark, tree, [objects.schema[c] for c in ("id", "number", "vector")])
    report = indexes.index_report(tree.nodes_table(spark), buckets.bucket_counts(objects), pivot_rows, RHO, FIXED_CAPACITY)
    return rounded(report, "occupation")


def stream_assign(spark, sf_dir):
    index = built_index(spark, sf_dir)
    source, sink, state = (stage_path(spark, n) for n in ("arriving", "placed", "stream"))
    objects = stored_objects(spark, sf_dir).select("id", "number", "vector")
    for part in range(4):
        objects.where(F.col("id") % 4 == part).write.mode("append").parquet(source)
    stream = arrivals.object_stream(spark, source, objects.schema, files_per_trigger=2)
    arrivals.start_placing(index, stream, sink, state).awaitTermination()
    return _placed(arrivals.arrived(index, sink))


# -- similarity queries ---------------------------------------------------


def range_query(spark, sf_dir):
    objects = metric_objects(spark, sf_dir)
    return rounded(similarity.range_query(objects, first_objects(objects, 1)[0], 0.2, METRIC), "dist")


def range_query_batch(spark, sf_dir, radius: float = 0.2, ask=batch):
    objects = stored_objects(spark, sf_dir)
    return rounded(similarity.range_query_batch(objects, ask(objects, radius), METRIC), "dist")


def candidate_buckets(spark, sf_dir, radius: float = 0.05, ask=batch):
    objects = metric_objects(spark, sf_dir)
    return search.candidate_buckets(fixed_tree(objects), ask(objects, radius))


def candidate_buckets_wide(spark, sf_dir):
    return candidate_buckets(spark, sf_dir, 0.2)


def _asked_of(index: MetricIndex) -> DataFrame:
    """All objects as the index stores them, without their places."""
    return index.objects().select("id", "number", "vector")


def _indexed(spark, sf_dir, radius, ask=batch):
    index = built_index(spark, sf_dir)
    return index.tree, index, ask(_asked_of(index), radius)


def range_query_indexed(spark, sf_dir, radius: float = 0.2, ask=batch):
    return rounded(search.range_query_indexed(*_indexed(spark, sf_dir, radius, ask)), "dist")


def range_query_indexed_partial(spark, sf_dir):
    """Some queries lack the number; they read every bucket."""
    tree, objects, queries = _indexed(spark, sf_dir, 0.2)
    partial = queries.withColumn("number", F.when(F.col("qid") % 2 == 0, F.col("number")))
    return rounded(search.range_query_indexed(tree, objects, partial), "dist")


def pivot_exclude_pairs(spark, sf_dir):
    tree, objects = fixed_objects(spark, sf_dir)
    return search.surviving_pairs(tree, objects, batch(objects, 0.2))


def range_query_limited(spark, sf_dir, ask=batch):
    found = search.range_query_limited(*_indexed(spark, sf_dir, 0.2, ask))
    return rounded(found.where("guaranteed").select("qid", "id", "dist"), "dist")


def range_query_approx(spark, sf_dir, ask=batch):
    tree, objects = _fixed(stored_objects(spark, sf_dir))
    found = search.range_query_approx(tree, objects, ask(objects, 0.2))
    return rounded(found.where("guaranteed").select("qid", "id", "dist"), "dist")


def pivot_exclude(spark, sf_dir, ask=batch):
    index_tree, objects, queries = _indexed(spark, sf_dir, 0.2, ask)
    return search.range_query_indexed(index_tree, objects, queries).select("qid", "id")


def pivot_exclude_pushed(spark, sf_dir):
    """One query; its interval on the first pivots' columns is a filter of the scan."""
    tree, index, queries = _indexed(spark, sf_dir, 0.2, lambda objects, radius: batch(objects, radius, 1))
    return search.range_query_indexed(tree, index, queries).select("qid", "id")


def range_query_ids(spark, sf_dir, ask=batch):
    return search.range_query_ids(*_indexed(spark, sf_dir, 0.6, ask))


def pivot_include(spark, sf_dir, ask=batch):
    objects = metric_objects(spark, sf_dir)
    near = first_objects(objects, 2)
    queries = ask(objects, 0.6)
    return search.pivot_included(
        probes.with_pivot_distances(objects, near, METRIC), probes.with_pivot_distances(queries, near, METRIC), 2
    )


def knn(spark, sf_dir, ask=batch):
    objects = stored_objects(spark, sf_dir)
    return rounded(similarity.knn(objects, ask(objects, 0.0), K, METRIC), "dist")


def knn_indexed(spark, sf_dir, ask=batch):
    _, index, queries = _indexed(spark, sf_dir, 0.0, ask)
    return rounded(search.knn_indexed(index, queries, K), "dist")


def _map_queries(spark, sf_dir, radius):
    objects = stage(map_objects(spark, sf_dir), "map-objects")
    first = objects.orderBy("id").limit(N_QUERIES).select(F.col("id").alias("qid"), "descriptors", F.lit(radius).alias("radius"))
    return objects, stage(first, "queries")


def range_query_batch_map(spark, sf_dir):
    objects, queries = _map_queries(spark, sf_dir, 0.05)
    return maps.range_query_batch_map(objects, queries, MapMetric()).select("qid", "id", F.round("dist", 9).alias("dist"))


def knn_map(spark, sf_dir):
    objects, queries = _map_queries(spark, sf_dir, 0.0)
    return maps.knn_map(objects, queries, K, MapMetric()).select("qid", "id", F.round("dist", 9).alias("dist"), "rank")


def knn_embeddings(spark, sf_dir, ask=lambda vectors: vectors.orderBy("id").limit(3)):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = stage(ask(vectors).select(F.col("id").alias("qid"), "vector"), "queries")
    return rounded(similarity.knn(vectors, queries, K, VectorMetric()), "dist")


def ranked_answers(spark, sf_dir, ask=batch):
    objects = stored_objects(spark, sf_dir)
    found = similarity.range_query_batch(objects, ask(objects, 0.2), METRIC)
    return answers.ranked_answers(found).select("qid", "rank", "id")


def answer_counts(spark, sf_dir, ask=batch):
    objects = stored_objects(spark, sf_dir)
    queries = ask(objects, 0.05)
    return answers.answer_counts(queries, similarity.range_query_batch(objects, queries, METRIC))


def answer_counts_indexed(spark, sf_dir, ask=batch):
    _, index, queries = _indexed(spark, sf_dir, 0.6, ask)
    return search.answer_counts_indexed(index, queries)


def query_cost(spark, sf_dir, ask=batch):
    tree, objects = _fixed(stored_objects(spark, sf_dir))
    return search.query_cost(tree, objects, ask(objects, 0.1), buckets.bucket_counts(objects))


def bucket_cost(spark, sf_dir):
    tree, objects = fixed_objects(spark, sf_dir)
    return search.bucket_cost(tree, objects, batch(objects, 0.1), buckets.bucket_counts(objects))


def merge_answers(spark, sf_dir, ask=batch):
    index = built_index(spark, sf_dir)
    tree, objects, queries = index.tree, index.objects(), ask(_asked_of(index), 0.2)
    # level after level, so that their joins do not all run and hold memory at once
    parts = [
        stage(search.range_query_indexed(tree, objects.where(F.col("level") == number), queries), "answers")
        for number in range(len(tree.levels))
    ]
    return rounded(answers.merge_answers(*parts), "dist")


#: Entries over ten queries that have one over many of a shrunk radius as well.
ASKED = (
    range_query_indexed, range_query_limited, range_query_approx, pivot_exclude, pivot_include, knn, ranked_answers,
    answer_counts, merge_answers, query_cost, candidate_buckets, incremental_insert_answers, stream_answers, knn_indexed,
    range_query_ids, answer_counts_indexed,
)


def registered() -> dict[str, Query]:
    return {
        "ingest_objects_text": ingest_objects_text,
        "ingest_text_keys": ingest_text_keys,
        "ingest_map_text": ingest_map_text,
        "rejected_records": rejected_records,
        "export_objects_text": export_objects_text,
        "scan_objects": scan_objects,
        "append_objects": append_objects,
        "delete_objects": delete_objects,
        "drop_bucket_range": drop_bucket_range,
        "lookup_key": lookup_key,
        "lookup_keys": lookup_keys,
        "lookup_key_range": lookup_key_range,
        "generate_random_objects": generate_random_objects,
        "index_roundtrip": index_roundtrip,
        "index_delete": index_delete,
        "index_drop_buckets": index_drop_buckets,
        "bucket_counts": bucket_counts,
        "dist_number": dist_number,
        "dist_vector_l2": dist_vector_l2,
        "dist_vector_l2_embeddings": dist_vector_l2_embeddings,
        "dist_composite_sum": dist_composite_sum,
        "dist_map_sum": dist_map_sum,
        "distance_report": distance_report,
        "data_equal_groups": data_equal_groups,
        "project_descriptor": project_descriptor,
        "object_size_bytes": object_size_bytes,
        "object_size_bytes_embeddings": object_size_bytes_embeddings,
        "object_label": object_label,
        "zone_of": zone,
        "balanced_split": balanced_split,
        "median_split": median_split,
        "three_way_split": three_way_split,
        "split_report": split_report,
        "choose_pivots": choose_pivots,
        "pivot_distances": pivot_distances,
        "assign_address": assign_address,
        "overflowing_buckets": overflowing_buckets,
        "bulk_build": bulk_build,
        "incremental_insert": incremental_insert,
        "incremental_insert_answers": incremental_insert_answers,
        "stream_answers": stream_answers,
        "index_report": index_report,
        "stream_assign": stream_assign,
        "range_query": range_query,
        "range_query_batch": range_query_batch,
        "candidate_buckets": candidate_buckets,
        "candidate_buckets_wide": candidate_buckets_wide,
        "range_query_limited": range_query_limited,
        "range_query_approx": range_query_approx,
        "range_query_indexed": range_query_indexed,
        "range_query_indexed_partial": range_query_indexed_partial,
        "pivot_exclude": pivot_exclude,
        "pivot_exclude_pairs": pivot_exclude_pairs,
        "pivot_exclude_pushed": pivot_exclude_pushed,
        "pivot_include": pivot_include,
        "range_query_ids": range_query_ids,
        "knn": knn,
        "knn_indexed": knn_indexed,
        "range_query_batch_map": range_query_batch_map,
        "knn_map": knn_map,
        "knn_embeddings": knn_embeddings,
        "ranked_answers": ranked_answers,
        "answer_counts": answer_counts,
        "answer_counts_indexed": answer_counts_indexed,
        "query_cost": query_cost,
        "query_cost_by_bucket": bucket_cost,
        "merge_answers": merge_answers,
        **{f"{query.__name__}_many": partial(query, ask=many) for query in ASKED},
        "range_query_batch_many": partial(range_query_batch, ask=every_one),
        "knn_embeddings_many": partial(knn_embeddings, ask=lambda vectors: vectors.where(F.col("id") % EVERY == 0)),
    }
