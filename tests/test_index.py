import pytest
from pyspark.sql import functions as F

from nearfield import workload as w
from nearfield.functions.distances import VectorMetric
from nearfield.plans import search, tree as trees
from nearfield.plans.growth import Limits
from nearfield.plans.index import MetricIndex
from nearfield.session import stage_path
from nearfield.sources import buckets
from nearfield.streaming import arrivals

RADII = [0.05, 0.1, 0.2, 0.4, 0.6]


def build(spark, objects, rho=0.05, capacity=120, **more):
    limits = Limits(capacity=capacity, max_levels=more.pop("max_levels", 4), max_depth=more.pop("max_depth", 4), bins=512)
    return MetricIndex.build(objects, stage_path(spark, "t-index"), w.METRIC, rho=rho, limits=limits, **more)


@pytest.fixture(scope="module")
def index(spark, objects):
    return build(spark, objects)


def queries(spark, brute, radius, n=10):
    rows = [(r["id"], r["number"], r["vector"], radius) for r in brute.rows[:n]]
    return spark.createDataFrame(rows, "qid long, number double, vector array<double>, radius double")


def pairs(df):
    return {(r["qid"], r["id"]) for r in df.collect()}


def expected(brute, radius, n=10):
    return {(r["id"], i) for r in brute.rows[:n] for i in brute.within(r, radius)}


def check_whole(index, brute):
    stored = index.objects().select("id", "level", "bucket").collect()
    assert sorted(r["id"] for r in stored) == [int(i) for i in brute.ids]
    leaves = {(n, b) for n, lv in enumerate(index.tree.levels) for b in lv.leaves()}
    assert {(r["level"], r["bucket"]) for r in stored} <= leaves


def test_capacity_and_whole(index, brute):
    check_whole(index, brute)
    for (level, bucket), n in index.counts.items():
        stuck = not index._splittable(level, bucket)
        assert n <= 120 or stuck


@pytest.mark.parametrize("radius", RADII)
def test_indexed_equals_brute_force(spark, index, brute, radius):
    q = queries(spark, brute, radius)
    assert pairs(search.range_query_indexed(index.tree, index.objects(), q)) == expected(brute, radius)
    assert pairs(search.range_query_indexed(index.tree, index.bucket_objects, q)) == expected(brute, radius)


def test_wide_rho_and_residual(spark, objects, brute):
    wide = build(spark, objects, rho=0.2, max_levels=3, max_depth=2)
    check_whole(wide, brute)
    q = queries(spark, brute, 0.2)
    assert pairs(search.range_query_indexed(wide.tree, wide.objects(), q)) == expected(brute, 0.2)


def test_shuffled_join_and_ids_only(spark, index, brute):
    q = queries(spark, brute, 0.2, 25)
    want = expected(brute, 0.2, 25)
    assert pairs(search.range_query_indexed(index.tree, index.objects(), q, max_broadcast_rows=1)) == want
    assert pairs(search.range_query_ids(index.tree, index.objects(), q)) == want


def test_join_descent_equals_case_descent(spark, index, objects, brute, monkeypatch):
    case = index.tree.assign(objects).select("id", "level", "bucket")
    reach = index.tree.candidates(queries(spark, brute, 0.3)).select("qid", "level", "bucket")
    want, touched = sorted(map(tuple, case.collect())), sorted(map(tuple, reach.collect()))
    monkeypatch.setattr(trees, "CASE_NODES", 0)
    monkeypatch.setattr(trees, "LITERAL_SLOTS", 0)
    joined = index.tree.assign(objects).select("id", "level", "bucket")
    reach = index.tree.candidates(queries(spark, brute, 0.3)).select("qid", "level", "bucket")
    assert sorted(map(tuple, joined.collect())) == want
    assert sorted(map(tuple, reach.collect())) == touched


def test_small_radius_reads_one_bucket_per_level(spark, index, brute):
    rows = search.candidate_buckets(index.tree, queries(spark, brute, 0.05, 50)).groupBy("qid", "level").count()
    assert rows.agg(F.max("count")).first()[0] == 1


def test_limited_and_approx_guarantees(spark, index, brute):
    q = queries(spark, brute, 0.3)
    limited = search.range_query_limited(index.tree, index.objects(), q)
    assert pairs(limited.where("guaranteed")) == expected(brute, 0.05)
    assert pairs(limited) <= expected(brute, 0.3)
    approx = search.range_query_approx(index.tree, index.objects(), q).collect()
    got = {(r["qid"], r["id"]) for r in approx}
    assert got <= expected(brute, 0.3)
    sure = {(r["qid"], r["id"]) for r in approx if r["guaranteed"]}
    reach = {r["qid"]: r["radius_certified"] for r in approx}
    by_id = {int(i): k for k, i in enumerate(brute.ids)}
    for r in brute.rows[:10]:
        d = brute.distances(r)
        near = {(r["id"], i) for i in brute.within(r, 0.3) if d[by_id[i]] < reach[r["id"]]}
        assert near <= sure


def test_pivot_include_never_wrong(spark, objects, brute):
    near = brute.rows[:3]
    q = queries(spark, brute, 0.7)
    from nearfield.operators.probes import with_pivot_distances

    got = search.pivot_included(with_pivot_distances(objects, near, w.METRIC), with_pivot_distances(q, near, w.METRIC), 3)
    assert pairs(got) and pairs(got) <= expected(brute, 0.7)
    wide = search.pivot_included(
        with_pivot_distances(objects, near, w.METRIC), with_pivot_distances(q, near, w.METRIC), 3, max_broadcast_rows=2
    )
    assert pairs(wide) == pairs(got)


def test_cost_matches_plan(spark, index, brute):
    q = queries(spark, brute, 0.1)
    cost = search.query_cost(index.tree, index.objects(), q, index.bucket_counts()).collect()
    assert len(cost) == 10
    for r in cost:
        assert r["candidates"] >= r["after_filter"] >= len(brute.within(brute.rows[[int(i) for i in brute.ids].index(r["qid"])], 0.1))


def test_sampled_build_is_whole_and_within_capacity(spark, objects, brute, monkeypatch):
    from nearfield.plans import index as ix

    monkeypatch.setattr(ix, "SAMPLE_PER_BUCKET", 40)
    sampled = build(spark, objects, sample_floor=300)
    check_whole(sampled, brute)
    assert all(n <= 120 or not sampled._splittable(*key) for key, n in sampled.counts.items())
    q = queries(spark, brute, 0.2)
    assert pairs(search.range_query_indexed(sampled.tree, sampled.objects(), q)) == expected(brute, 0.2)


def test_insert_load_and_delete(spark, objects, brute):
    first = objects.where(F.col("id") % 4 == 0)
    index = build(spark, first)
    assert index.insert(objects.where(F.col("id") % 4 != 0)) == objects.count() - first.count()
    check_whole(index, brute)
    loaded = MetricIndex.open_or_build(objects, index.path, w.METRIC)
    assert loaded.tree.node_rows() == index.tree.node_rows() and loaded.limits == index.limits
    q = queries(spark, brute, 0.2)
    assert pairs(search.range_query_indexed(loaded.tree, loaded.objects(), q)) == expected(brute, 0.2)
    with pytest.raises(ValueError, match="exists"):
        MetricIndex.build(objects, index.path, w.METRIC)

    victims = objects.where(F.col("id") < 100)
    assert loaded.delete(victims) == victims.count()
    left = {(qid, i) for qid, i in expected(brute, 0.2) if i >= 100}
    assert pairs(search.range_query_indexed(loaded.tree, loaded.bucket_objects, q)) == left
    assert sum(MetricIndex.load(spark, index.path, w.METRIC).counts.values()) == objects.count() - victims.count()


def test_only_reached_folders_are_read(spark, index, brute):
    q = queries(spark, brute, 0.05, 1)
    wanted = {(r["level"], r["bucket"]) for r in search.candidate_buckets(index.tree, q).collect()}
    files = index.bucket_objects(list(wanted) + [(0, 999_999)]).inputFiles()
    assert files and all(any(f"level={lv}/bucket={b}/" in f for lv, b in wanted) for f in files)
    assert index.bucket_objects([(0, 999_999)]).count() == 0


def test_equal_objects_end_in_a_final_bucket(spark):
    copies = spark.range(50).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    index = MetricIndex.build(copies, stage_path(spark, "t-index"), VectorMetric(2), rho=0.1, limits=Limits(capacity=10, max_levels=3, max_depth=3))
    assert index.counts == {(0, 1): 50}
    assert index.tree.levels[0].final == {1}


def test_object_excluded_everywhere_is_kept(spark):
    level = lambda: trees.Level([{"id": 0, "vector": [0.0]}], {1: (1.0, 1.2)})
    tree = trees.Tree(VectorMetric(1), 0.1, [level(), level(), trees.Level()])
    df = spark.createDataFrame([(1, [1.1]), (2, [0.5]), (3, [1.3])], "id long, vector array<double>")
    got = {r["id"]: (r["level"], r["bucket"], r["pd"]) for r in tree.assign(df).collect()}
    assert got == {1: (2, 1, [[1.1], [1.1], []]), 2: (0, 2, [[0.5]]), 3: (0, 3, [[1.3]])}


def test_empty_bucket_and_empty_answer(spark, index, brute):
    assert buckets.scan_bucket(index.objects(), 99, 1).count() == 0
    far = spark.createDataFrame([(1, 500.0, [0.0, 0.0, 0.0], 0.01)], "qid long, number double, vector array<double>, radius double")
    assert search.range_query_indexed(index.tree, index.objects(), far).count() == 0


def test_partition_pruning_reaches_the_scan(spark, index, brute):
    one = buckets.scan_bucket(index.objects(), 0, index.tree.levels[0].leaves()[0])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan
    found = search.range_query_indexed(index.tree, index.objects(), queries(spark, brute, 0.05, 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and ",pd#" in line]
    assert scans and all("PartitionFilters: []" not in line for line in scans)


def test_stream_equals_batch(spark, index, objects):
    source, sink, state = (stage_path(spark, n) for n in ("src", "sink", "state"))
    plain = objects.select("id", "number", "vector")
    for part in range(4):
        plain.where(F.col("id") % 4 == part).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # a second run finds nothing new
        stream = arrivals.object_stream(spark, source, plain.schema, 1)
        arrivals.start_placing(index, stream, sink, state).awaitTermination()
    got = arrivals.arrived(index, sink).select("id", "level", "bucket").collect()
    want = index.tree.assign(plain).select("id", "level", "bucket").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert arrivals.with_arrivals(index, sink).count() == 2 * len(want)


def test_absorb_arrivals(spark, objects, brute):
    index = build(spark, objects.where(F.col("id") % 2 == 0))
    source, sink, state = (stage_path(spark, n) for n in ("src", "sink", "state"))
    objects.where(F.col("id") % 2 == 1).select("id", "number", "vector").write.parquet(source)
    stream = arrivals.object_stream(spark, source, spark.read.parquet(source).schema)
    arrivals.start_placing(index, stream, sink, state).awaitTermination()
    arrivals.absorb(index, sink)
    check_whole(index, brute)


def arrive(spark, index, rows, sink=None):
    source, state = stage_path(spark, "src"), stage_path(spark, "state")
    sink = sink or stage_path(spark, "sink")
    rows.select("id", "number", "vector").write.parquet(source)
    stream = arrivals.object_stream(spark, source, spark.read.parquet(source).schema)
    arrivals.start_placing(index, stream, sink, state).awaitTermination()
    return sink


def test_queries_without_a_descriptor_lose_nothing(spark, index, objects, brute):
    from nearfield.operators.similarity import range_query_batch

    rows = [(r["id"], None if i % 2 else r["number"], None if i % 3 == 1 else r["vector"], 0.2) for i, r in enumerate(brute.rows[:6])]
    q = spark.createDataFrame(rows, "qid long, number double, vector array<double>, radius double")
    want = pairs(range_query_batch(objects, q, w.METRIC))
    assert len(want) > 6
    assert pairs(search.range_query_indexed(index.tree, index.bucket_objects, q)) == want
    assert pairs(search.range_query_ids(index.tree, index.bucket_objects, q)) == want
    near = {(r["qid"], r["id"]) for r in range_query_batch(objects, q, w.METRIC).where(F.col("dist") <= 0.05).collect()}
    assert near <= pairs(search.range_query_limited(index.tree, index.bucket_objects, q).where("guaranteed"))
    whole = {r[0] for i, r in enumerate(rows) if i % 2 or i % 3 == 1}
    approx = pairs(search.range_query_approx(index.tree, index.bucket_objects, q))
    assert {p for p in want if p[0] in whole} == {p for p in approx if p[0] in whole}
    reached = search.candidate_buckets(index.tree, q).groupBy("qid").count().collect()
    leaves = sum(len(lv.leaves()) for lv in index.tree.levels)
    assert {r["qid"] for r in reached if r["count"] == leaves} >= whole
    cost = {r["qid"]: r for r in search.query_cost(index.tree, index.bucket_objects, q, index.bucket_counts()).collect()}
    assert all(cost[i]["candidates"] == cost[i]["after_filter"] == objects.count() for i in whole)


def test_every_known_level_filters(spark, index, brute):
    """Pairs left for the exact distance, also in the level that has no pivots."""
    q = queries(spark, brute, 0.1)
    cost = search.bucket_cost(index.tree, index.bucket_objects, q, index.bucket_counts())
    by_level = {r["level"]: (r["c"], r["a"]) for r in cost.groupBy("level").agg(F.sum("candidates").alias("c"), F.sum("after_filter").alias("a")).collect()}
    candidates, left = by_level[max(n for n, (c, _) in by_level.items() if c)]
    assert left < candidates / 2


@pytest.mark.parametrize("step", ["_write", "_split_overflow", "save"])
def test_a_failed_insert_leaves_the_index_whole(spark, objects, brute, monkeypatch, step):
    index = build(spark, objects.where(F.col("id") % 2 == 0))
    old = {p for p in expected(brute, 0.2) if p[1] % 2 == 0}
    q = queries(spark, brute, 0.2)
    real = getattr(MetricIndex, step)

    def fails(self, *args):
        if step != "save":
            real(self, *args)
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(MetricIndex, step, fails)
        with pytest.raises(RuntimeError, match="lost"):
            index.insert(objects.where(F.col("id") % 2 == 1))
    for one in (index, MetricIndex.load(spark, index.path, w.METRIC)):
        assert pairs(search.range_query_indexed(one.tree, one.bucket_objects, q)) == old
        assert pairs(search.range_query_indexed(one.tree, one.objects(), q)) == old
    assert index.insert(objects.where(F.col("id") % 2 == 1), ["odd"]) and index.insert(objects.where(F.col("id") % 2 == 1), ["odd"]) == 0
    check_whole(MetricIndex.load(spark, index.path, w.METRIC), brute)


def test_another_metric_is_refused(spark, index):
    from nearfield.functions.distances import CompositeMetric

    with pytest.raises(ValueError, match="built with"):
        MetricIndex.load(spark, index.path, CompositeMetric(4))


def test_many_small_inserts_are_compacted(spark, objects, brute, monkeypatch):
    from nearfield.plans import index as ix

    monkeypatch.setattr(ix, "MAX_BATCHES", 2)
    index = build(spark, objects.where(F.col("id") % 4 == 0), capacity=5_000)
    for part in (1, 2, 3):
        index.insert(objects.where(F.col("id") % 4 == part))
    assert max(map(len, index.parts.values())) <= 2
    check_whole(index, brute)


def test_arrivals_after_a_split_and_absorbing_twice(spark, objects, brute):
    index = build(spark, objects.where(F.col("id") % 4 == 0), capacity=200)
    sink = arrive(spark, index, objects.where(F.col("id") % 4 == 1))
    nodes = len(index.tree.node_rows())
    index.insert(objects.where(F.col("id") % 4 >= 2))
    assert len(index.tree.node_rows()) > nodes
    q = queries(spark, brute, 0.2)
    assert pairs(search.range_query_indexed(index.tree, arrivals.with_arrivals(index, sink), q)) == expected(brute, 0.2)
    assert arrivals.absorb(index, sink) > 0
    assert arrivals.absorb(index, sink) == 0 and arrivals.arrived(index, sink).count() == 0
    check_whole(index, brute)


def test_limits_follow_the_number_of_objects():
    huge = Limits(capacity=1_000_000).sized(10**12)
    assert huge.max_levels == huge.max_depth == 22
    assert Limits(capacity=100, max_levels=3).sized(10**6).max_levels == 3


def test_a_dropped_range_goes_as_one_change(spark, objects, monkeypatch):
    index = MetricIndex.from_tree(objects, stage_path(spark, "index"), w.fixed_tree(objects))
    before, version = index.counts, index.version
    monkeypatch.setattr(MetricIndex, "save", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.drop_buckets(0, 4, 5)
    monkeypatch.undo()
    assert index.counts == before and index.objects().count() == sum(before.values())
    going = sum(n for (level, bucket), n in before.items() if level == 0 and bucket in (4, 5))
    assert going and index.drop_buckets(0, 4, 5) == going and index.drop_buckets(0, 4, 5) == 0
    assert index.version > version and set(index.counts) == {key for key in before if key not in {(0, 4), (0, 5)}}
    again = MetricIndex.load(spark, index.path, w.METRIC)
    assert again.objects().count() == sum(before.values()) - going
