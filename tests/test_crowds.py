"""Very many queries: fitted grids, blocks of vectors, and the same rows as few queries get."""

import math
import random

import pytest
from pyspark.sql import functions as F

from nearfield.functions.distances import CompositeMetric, VectorMetric
from nearfield.operators import similarity
from nearfield.plans import search
from nearfield.plans.tree import Level, Tree
from nearfield.sources.buckets import bucket_counts

METRIC = CompositeMetric(length=3)
SCHEMA = "id long, number double, vector array<double>"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    made = [(i, draw.random(), [draw.random() for _ in range(3)]) for i in range(1500)]
    return made + [(1500, *made[7][1:]), (1501, *made[7][1:])]  # two copies


def near(a, b):
    return abs(a[1] - b[1]) + math.dist(a[2], b[2])


def asked(spark, some, radius):
    return spark.createDataFrame([(*r, float(radius)) for r in some], SCHEMA.replace("id", "qid", 1) + ", radius double")


def listed(df):
    return sorted(tuple(round(c, 9) if isinstance(c, float) else c for c in r) for r in df.collect())


def test_cells_follow_the_radius(spark, rows):
    """As the radius falls with the table, a query must meet about as many objects, not a strip of all."""
    objects = spark.createDataFrame(rows, SCHEMA)
    queries = asked(spark, rows[:100], 0.05)
    grid = similarity.Survey.of(objects, METRIC).fitted(queries, 10_000_000)
    assert len(grid.pivots) > 2 and grid.bins >= 16
    assert min(grid.width) < 0.3


def test_crowd_answers_by_brute_force(spark, rows):
    partial = [(2000, None, [0.5, 0.5, 0.5]), (2001, 0.5, None)]
    objects = spark.createDataFrame(rows + partial, SCHEMA)
    some = rows[:90]
    queries = asked(spark, some, 0.2).unionByName(asked(spark, [rows[91]], math.inf)).unionByName(asked(spark, [(3000, None, [0.1, 0.1, 0.1])], 0.1))
    got = {(r["qid"], r["id"]) for r in similarity.range_query_batch(objects, queries, METRIC).collect()}
    want = {(q[0], o[0]) for q in some for o in rows if round(near(q, o), 9) <= 0.2}
    want |= {(q[0], 2000) for q in some if round(math.dist(q[2], [0.5] * 3), 9) <= 0.2} | {(q[0], 2001) for q in some if round(abs(q[1] - 0.5), 9) <= 0.2}
    want |= {(rows[91][0], o[0]) for o in rows + partial}
    want |= {(3000, o[0]) for o in rows + partial[:1] if round(math.dist([0.1] * 3, o[2]), 9) <= 0.1} | {(3000, 2001)}
    assert got == want


def test_crowd_reads_the_buckets_few_queries_read(spark, rows, monkeypatch):
    tree = Tree(METRIC, 0.05, [Level([{"id": i, "number": n, "vector": v} for i, n, v in rows[:2]], {1: (0.7, 0.8), 2: (0.5, 0.6)}), Level()])
    objects = tree.assign(spark.createDataFrame(rows, SCHEMA))
    queries = asked(spark, rows[:100] + rows[5:6], 0.15)  # one twice
    calls = {
        "indexed": lambda: search.range_query_indexed(tree, objects, queries),
        "ids": lambda: search.range_query_ids(tree, objects, queries),
        "limited": lambda: search.range_query_limited(tree, objects, queries),
        "approx": lambda: search.range_query_approx(tree, objects, queries).drop("radius_certified"),
        "cost": lambda: search.query_cost(tree, objects, queries.distinct(), bucket_counts(objects)),
    }
    crowd = {name: listed(call()) for name, call in calls.items()}
    monkeypatch.setattr(similarity, "CROWD_QUERIES", 10_000)
    for name, call in calls.items():
        assert crowd[name] == listed(call()), name


def test_a_crowd_does_not_pass_through_the_driver(spark, rows, monkeypatch):
    objects = spark.createDataFrame(rows, SCHEMA)
    vector = "array(pmod(id, 991) / 991D, pmod(id, 983) / 983D, 0.5D)"
    queries = spark.range(50_000).selectExpr("id as qid", "pmod(id, 997) / 997D as number", f"{vector} as vector", "0.01D as radius")

    def joins():
        found = similarity.range_query_batch(objects, queries, METRIC)
        plan = found._jdf.queryExecution().executedPlan().toString()
        return found, [line for line in plan.splitlines() if "Join" in line and "_cell" in line and "Inner" in line]

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, planned = joins()
        assert planned and not any("BroadcastHashJoin" in line for line in planned)
        monkeypatch.setattr(similarity, "CROWD_BYTES", similarity.BROADCAST_BYTES)
        other, planned = joins()
        assert any("BroadcastHashJoin" in line for line in planned)
        assert listed(found) == listed(other)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_long_vectors_in_blocks(spark):
    draw = random.Random(5)
    made = [(i, [draw.gauss(0, 1) for _ in range(24)]) for i in range(1400)]
    made += [(2000 + i, made[3][1]) for i in range(30)] + [(-5, made[3][1])]  # ties go to the smallest id
    odd = [(5000, None), (5001, [math.nan] * 24), (5002, [None] * 24)]
    vectors = spark.createDataFrame(made + odd, "id long, vector array<float>")
    queries = vectors.where((F.col("id") < 100) | (F.col("id") >= 5000)).withColumnRenamed("id", "qid")
    got = {}
    for r in similarity.knn(vectors, queries, 5, VectorMetric()).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (r["id"], r["dist"])
    held = {r["id"]: list(r["vector"]) for r in vectors.where(F.col("id") < 5000).collect()}
    assert set(got) == {i for i in held if i < 100}
    for qid, best in got.items():
        want = sorted((round(math.dist(held[qid], v), 9), i) for i, v in held.items())[:5]
        assert [best[k + 1][0] for k in range(5)] == [i for _, i in want]
        assert all(abs(best[k + 1][1] - want[k][0]) < 1e-8 for k in range(5))
