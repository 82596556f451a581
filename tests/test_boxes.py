"""Queries through a stored index that skip buckets, pages and distances by what it knows."""

import math

import pytest
from pyspark.sql import functions as F

from nearfield import workload as w
from nearfield.plans import index as indexes
from nearfield.plans import search
from nearfield.plans.growth import Limits
from nearfield.plans.index import MetricIndex, joined_boxes
from nearfield.session import stage_path

QUERY = "qid long, number double, vector array<double>, radius double"


def build(spark, objects, rho=0.05, capacity=100):
    return MetricIndex.build(objects, stage_path(spark, "boxes"), w.METRIC, rho=rho, limits=Limits(capacity=capacity, max_levels=3, max_depth=3, bins=512))


@pytest.fixture(scope="module")
def index(spark, objects):
    return build(spark, objects)


def queries(spark, brute, radius, step=97):
    return spark.createDataFrame([(r["id"], r["number"], r["vector"], radius) for r in brute.rows[::step]], QUERY)


def nearest(brute, row, k):
    return [i for _, i in sorted(zip(brute.distances(row).round(9), brute.ids.tolist()))[:k]]


def check_knn(found, brute, rows, k):
    got = {}
    for r in found.collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["id"]
    assert {q: [ids[i + 1] for i in range(len(ids))] for q, ids in got.items()} == {r["id"]: nearest(brute, r, k) for r in rows}


@pytest.mark.parametrize("k", [1, 7, 400])
def test_knn_equals_brute_force(spark, index, brute, k):
    check_knn(search.knn_indexed(index, queries(spark, brute, 0.0), k), brute, brute.rows[::97], k)


def test_knn_of_queries_that_lie_outside_or_lack_a_descriptor(spark, index, brute):
    far = (-1, 40.0, [9.0, 9.0, 9.0], 0.0)
    part = (-2, None, list(brute.rows[5]["vector"]), 0.0)
    found = search.knn_indexed(index, spark.createDataFrame([far, part], QUERY), 4).collect()
    dist = {-1: lambda r: abs(40 - r["number"]) + math.dist(r["vector"], [9.0] * 3), -2: lambda r: math.dist(r["vector"], brute.rows[5]["vector"])}
    for qid, d in dist.items():
        expected = sorted((round(d(r), 9), r["id"]) for r in brute.rows)[:4]
        assert [(round(r["dist"], 9), r["id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["qid"] == qid] == expected


def test_more_neighbours_than_objects(spark, index, brute):
    assert search.knn_indexed(index, queries(spark, brute, 0.0, 900), 10_000).count() == len(brute.rows) * len(brute.rows[::900])


def test_knn_reads_few_buckets_and_fewer_with_a_smaller_rho(spark, objects, brute):
    """What a split excludes goes to later levels that every query reads as well."""
    read = {}
    for rho in (0.02, 0.3):
        one = build(spark, objects, rho, 60)
        best, buckets = search.knn_rounds(one, queries(spark, brute, 0.0, 60), 3)
        assert best.count() == 3 * len(brute.rows[::60])
        share = [r["buckets"] / len(one.counts) for r in buckets.collect()]
        read[rho] = sum(share) / len(share)
        assert len(share) == len(brute.rows[::60]) and read[rho] < 1
    assert read[0.02] < 0.6


@pytest.mark.parametrize("radius", [0.05, 0.4, 1.2, 9.0])
def test_counts_without_reading(spark, index, brute, radius):
    q = queries(spark, brute, radius)
    counts = {r["qid"]: r["n"] for r in search.answer_counts_indexed(index, q).collect()}
    assert counts == {r["id"]: len(brute.within(r, radius)) for r in brute.rows[::97]}
    plan = search.bucket_plan(index, q)
    inside, reached = plan.where("inside").count(), plan.count()
    assert inside < reached or radius == 9.0
    if radius >= 1.2:
        assert inside > 0
    if radius == 9.0:  # everything is an answer and no bucket is read
        assert inside == reached


def test_boxes_drop_buckets_that_splits_keep(spark, index, brute):
    q = queries(spark, brute, 0.1)
    assert search.bucket_plan(index, q).count() < index.tree.candidates(q).join(index.bucket_boxes(), ["level", "bucket"]).count()


def test_ids_equal_brute_force(spark, index, brute):
    found = {(r["qid"], r["id"]) for r in search.range_query_ids(index.tree, index, queries(spark, brute, 0.6)).collect()}
    assert found == {(r["id"], i) for r in brute.rows[::97] for i in brute.within(r, 0.6)}


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan()


def scan(plan):
    """The one file scan of an executed plan."""
    text = plan.getClass().getSimpleName()
    if text == "AdaptiveSparkPlanExec":
        return scan(plan.executedPlan())
    if text.endswith("QueryStageExec"):
        return scan(plan.plan())
    if text == "FileSourceScanExec":
        return plan
    children = plan.children()
    return next((s for i in range(children.size()) if (s := scan(children.apply(i)))), None)


def test_the_filter_reaches_the_scan_and_pages_are_skipped(spark, objects, brute, monkeypatch):
    """One query reads the rows of a few pages; sorted pages make that possible."""
    monkeypatch.setattr(indexes, "PAGE_ROWS", 50)
    one = build(spark, objects, capacity=100_000)  # a single bucket: only pages can be skipped
    assert len(one.counts) == 1 and not one.tree.levels[0].pivots
    pivot = w.first_objects(objects, 2)
    tall = MetricIndex.build(objects, stage_path(spark, "boxes"), w.METRIC, rho=0.05, limits=Limits(capacity=700, max_levels=2, max_depth=2), fixed_pivots=pivot)
    for radius, most in ((0.02, 0.5), (5.0, 1.0)):
        q = queries(spark, brute, radius, 5000)
        df = search.range_query_indexed(tall.tree, tall, q)
        assert {r["id"] for r in df.collect()} == brute.within(brute.rows[0], radius)
        found = [r["id"] for r in search._read(tall.tree, tall, search._probe_rows(tall.tree, q, tall.tree.candidates(q), "radius", tall), 10).collect()]
        assert len(found) <= most * len(brute.rows)
        leaf = scan(executed(df))
        assert "GreaterThanOrEqual(near0" in str(leaf.metadata().apply("PushedFilters")) or radius == 5.0
        assert leaf.metrics().apply("numOutputRows").value() <= most * len(brute.rows)


def test_many_folders_are_pruned_at_run_time(spark, index, brute, monkeypatch):
    q = queries(spark, brute, 0.1, 400)
    expected = {(r["qid"], r["id"]) for r in search.range_query_indexed(index.tree, index, q).collect()}
    monkeypatch.setattr(indexes, "MAX_PATHS", 0)
    wanted = sorted(index.parts)[:3]
    rows = index.bucket_objects(wanted)
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r["level"], r["bucket"]) for r in rows.select("level", "bucket").distinct().collect()} == set(wanted)
    assert rows.count() == sum(index.counts[key] for key in wanted)
    assert {(r["qid"], r["id"]) for r in search.range_query_indexed(index.tree, index, q).collect()} == expected


def test_boxes_follow_changes_and_are_loaded(spark, objects, brute):
    one = build(spark, objects.where("id % 3 > 0"))
    one.insert(objects.where("id % 3 = 0"))
    one.delete(objects.where("id % 7 = 0").select("id"))
    again = MetricIndex.load(spark, one.path, w.METRIC)
    assert again.boxes == one.boxes and set(again.boxes) == set(again.parts)
    stored = one.objects().groupBy("level", "bucket").agg(F.min(F.get(F.get("pd", F.lit(0)), F.lit(0))).alias("lo"), F.max(F.get(F.get("pd", F.lit(0)), F.lit(0))).alias("hi"))
    boxes = {(r["level"], r["bucket"]): (r["lo"][0], r["hi"][0]) for r in again.bucket_boxes().collect()}
    assert boxes == {(r["level"], r["bucket"]): (r["lo"], r["hi"]) for r in stored.collect()}
    left = [r for r in brute.rows if r["id"] % 7]
    found = search.knn_indexed(again, queries(spark, brute, 0.0), 5).collect()
    for r in brute.rows[::97]:
        best = sorted((round(float(d), 9), int(i)) for d, i in zip(brute.distances(r), brute.ids) if i % 7)[:5]
        assert [(x["id"]) for x in sorted(found, key=lambda x: x["rank"]) if x["qid"] == r["id"]] == [i for _, i in best]
    assert len(left) == sum(one.counts.values())


def test_joined_boxes():
    assert joined_boxes([((1.0, 2.0), (3.0, 4.0)), ((0.5, 3.0), (2.0, 9.0))]) == ([0.5, 2.0], [3.0, 9.0])
    assert joined_boxes([((1.0, None), (3.0, None)), ((0.5,), (2.0,))]) == ([0.5, None], [3.0, None])
