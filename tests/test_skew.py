"""A third of all rows in one place: results stay whole and the work is cut."""

import pytest
from pyspark.sql import functions as F

from nearfield.functions.distances import CompositeMetric
from nearfield.functions.descriptors import equal_groups
from nearfield.operators.answers import answer_counts, ranked_answers
from nearfield.operators.similarity import knn, range_query_batch
from nearfield.plans import search
from nearfield.plans.growth import Limits
from nearfield.plans.index import MetricIndex
from nearfield.session import stage, stage_path
from nearfield.sources import buckets
from nearfield.sources.generator import random_objects

METRIC = CompositeMetric(3)


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 random objects and 1,000 copies of one of them."""
    spread = random_objects(spark, 0, 2000, seed=9)
    one = spread.where("id = 77").first()
    copies = spark.range(5000, 6000).select("id", F.lit(one["number"]).alias("number"), F.array(*map(F.lit, one["vector"])).alias("vector"))
    return stage(spread.unionByName(copies), "skewed"), one


@pytest.fixture(scope="module")
def queries(spark, skewed):
    objects, one = skewed
    q = objects.where("id = 77 or id < 30").select(F.col("id").alias("qid"), "number", "vector").withColumn("radius", F.lit(0.15))
    return stage(q, "skewed-queries")


@pytest.fixture(scope="module")
def expected(skewed, queries):
    objects, _ = skewed
    rows = objects.collect()
    import numpy as np

    n = np.array([r["number"] for r in rows])
    v = np.array([r["vector"] for r in rows])
    ids = np.array([r["id"] for r in rows])
    out = {}
    for q in queries.collect():
        d = np.abs(n - q["number"]) + np.sqrt(((v - np.array(q["vector"])) ** 2).sum(axis=1))
        out[q["qid"]] = [(int(i), float(x)) for i, x in zip(ids, d)]
    return out


def within(expected, radius):
    return {(q, i) for q, near in expected.items() for i, d in near if round(d, 9) <= radius}


def pairs(df):
    return {(r["qid"], r["id"]) for r in df.collect()}


@pytest.mark.parametrize("broadcast_rows", [200_000, 3])
def test_batch(skewed, queries, expected, broadcast_rows):
    found = pairs(range_query_batch(skewed[0], queries, METRIC, max_broadcast_rows=broadcast_rows))
    assert found == within(expected, 0.15) and len([p for p in found if p[0] == 77]) >= 1001


def test_index(spark, skewed, queries, expected):
    index = MetricIndex.build(skewed[0], stage_path(spark, "skew-index"), METRIC, rho=0.03, limits=Limits(capacity=200, max_levels=4, max_depth=5))
    assert index.objects().select("id").distinct().count() == index.objects().count() == 3000
    biggest = max(index.counts.values())
    assert biggest >= 1001
    assert pairs(search.range_query_indexed(index.tree, index.objects(), queries)) == within(expected, 0.15)
    assert pairs(search.range_query_indexed(index.tree, index.objects(), queries, max_broadcast_rows=1)) == within(expected, 0.15)
    assert index.insert(random_objects(spark, 9000, 9300, seed=4)) == 300
    assert index.objects().count() == 3300


def test_ranks_counts_and_neighbours(skewed, queries, expected):
    found = range_query_batch(skewed[0], queries, METRIC)
    ranks = ranked_answers(found, group_rows=150).where("qid = 77").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, len(ranks) + 1))
    assert [r["id"] for r in ranks][:3] == [77, 5000, 5001]
    counts = {r["qid"]: r["n"] for r in answer_counts(queries, found).collect()}
    assert counts[77] == sum(round(d, 9) <= 0.15 for _, d in expected[77])
    near = {r["rank"]: r["id"] for r in knn(skewed[0], queries, 4, METRIC).where("qid = 77").collect()}
    assert near == {1: 77, 2: 5000, 3: 5001, 4: 5002}


def test_copies_are_counted_and_deleted_to_a_limit(skewed):
    objects, one = skewed
    assert [r["n"] for r in equal_groups(objects).collect()] == [1001]
    victim = objects.where("id = 77")
    left = buckets.without_objects(objects, victim, by=["number", "vector"], limit=400)
    assert left.count() == 2600 and left.where("id = 77").count() == 0
    assert buckets.without_objects(objects, victim, by=["number", "vector"]).count() == 1999
