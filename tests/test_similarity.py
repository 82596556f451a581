import pytest
from pyspark.sql import functions as F

from nearfield import workload as w
from nearfield.functions.distances import CompositeMetric, MapMetric, VectorMetric
from nearfield.operators.answers import answer_counts, merge_answers, ranked_answers
from nearfield.operators.pivots import choose_pivots
from nearfield.operators.similarity import knn, range_query, range_query_batch


def by_query(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["qid"], set()).add(r["id"])
    return found


def queries(spark, brute, n, radius=None):
    rows = [(r["id"], r["number"], r["vector"], float(radius if radius is not None else 0.02 * (1 + r["id"] % 30))) for r in brute.rows[:n]]
    return spark.createDataFrame(rows, "qid long, number double, vector array<double>, radius double")


@pytest.mark.parametrize("broadcast_rows", [200_000, 5])
def test_batch_equals_brute_force(spark, objects, brute, broadcast_rows):
    q = queries(spark, brute, 40)
    got = by_query(range_query_batch(objects, q, w.METRIC, max_broadcast_rows=broadcast_rows))
    expected = {r["qid"]: brute.within(r, r["radius"]) for r in q.collect()}
    assert got == {k: v for k, v in expected.items() if v}


def test_single_query_border_is_inclusive(spark, objects, brute):
    row = brute.rows[0]
    d = sorted(round(x, 9) for x in brute.distances(row))
    assert range_query(objects, row, d[20], w.METRIC).count() == sum(x <= d[20] for x in d)


def test_missing_descriptors_meet_everything(spark):
    schema = "id long, number double, vector array<double>"
    data = [(1, 0.0, [0.0]), (2, None, [0.1]), (3, 5.0, None), (4, None, None), (5, 5.0, [9.0]), (6, 0.3, [0.0])]
    objects = spark.createDataFrame(data, schema)
    queries = spark.createDataFrame([(10, 0.0, [0.0], 0.5), (11, None, [0.0], 0.5), (12, 5.0, None, 0.5), (13, None, None, 0.0)], "qid long, number double, vector array<double>, radius double")
    got = by_query(range_query_batch(objects, queries, CompositeMetric()))
    assert got == {10: {1, 2, 4, 6}, 11: {1, 2, 3, 4, 6}, 12: {2, 3, 4, 5}, 13: {1, 2, 3, 4, 5, 6}}


def test_map_metric_batch(spark):
    objects = spark.createDataFrame([(1, {"a": [0.0]}), (2, {"b": [7.0]}), (3, {"a": [2.0], "b": [7.0]})], "id long, descriptors map<string,array<double>>")
    q = objects.select(F.col("id").alias("qid"), "descriptors", F.lit(1.0).alias("radius"))
    assert by_query(range_query_batch(objects, q, MapMetric())) == {1: {1, 2}, 2: {1, 2, 3}, 3: {2, 3}}


@pytest.mark.parametrize("max_probes, k", [(64, 5), (3, 5), (64, 2000)])
def test_knn_equals_brute_force(spark, objects, brute, max_probes, k):
    q = queries(spark, brute, 8, 0.0)
    got = {(r["qid"], r["rank"]): r["id"] for r in knn(objects, q, k, w.METRIC, max_probes=max_probes).collect()}
    expected = {}
    for r in brute.rows[:8]:
        order = sorted((round(d, 9), int(i)) for d, i in zip(brute.distances(r), brute.ids))
        expected.update({(r["id"], n + 1): i for n, (_, i) in enumerate(order[:k])})
    assert got == expected


def test_ranks_of_a_query_with_many_answers(spark):
    answers = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("qid"), (F.col("id") % 11 / 7).alias("dist"), "id")
    plain = sorted(map(tuple, ranked_answers(answers).select("qid", "rank", "id").collect()))
    cut = sorted(map(tuple, ranked_answers(answers, group_rows=100).select("qid", "rank", "id").collect()))
    assert plain == cut and max(r[1] for r in plain if r[0] == 0) == 2001


def test_counts_keep_empty_queries_and_merge_drops_repeats(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    a = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.7)], "qid long, id long, dist double")
    b = spark.createDataFrame([(1, 5, 0.5), (2, 6, 0.1)], "qid long, id long, dist double")
    assert sorted(map(tuple, merge_answers(a, b).collect())) == [(1, 5, 0.5), (1, 6, 0.7), (2, 6, 0.1)]
    assert sorted(map(tuple, answer_counts(q, a).collect())) == [(1, 2), (2, 0)]


def test_pivots_fixed_first_then_distinct(spark, objects, brute):
    fixed = brute.rows[3:5]
    chosen = [p["id"] for p in choose_pivots(objects, w.METRIC, 6, seed=3, fixed=fixed)]
    assert chosen[:2] == [r["id"] for r in fixed] and len(set(chosen)) == 6
    assert chosen == [p["id"] for p in choose_pivots(objects, w.METRIC, 6, seed=3, fixed=fixed)]
    thinned = choose_pivots(objects, w.METRIC, 6, seed=3, fixed=fixed, total=1500)
    assert [p["id"] for p in thinned] == chosen


def test_vector_metric_knn(spark):
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(50)], "id long, vector array<double>")
    q = spark.createDataFrame([(1, [10.2, 0.0])], "qid long, vector array<double>")
    assert [r["id"] for r in knn(vectors, q, 3, VectorMetric(2)).orderBy("rank").collect()] == [10, 11, 9]
