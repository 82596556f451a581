"""The search queries are also asked for every object whose id 50 divides."""

import math
import random

import pytest

from nearfield import workload
from tests.conftest import SF_DIR

NAMES = (
    "range_query_batch", "range_query_indexed", "range_query_limited", "range_query_approx", "pivot_exclude", "pivot_include", "knn",
    "knn_embeddings", "ranked_answers", "answer_counts", "merge_answers", "query_cost", "candidate_buckets", "incremental_insert_answers", "stream_answers",
)


def test_each_has_an_entry_over_many_queries():
    assert {f"{n}_many" for n in NAMES} <= set(workload.registered())


@pytest.mark.parametrize("name", ["range_query_batch_many", "knn_many"])
def test_every_query_is_answered(spark, objects, name):
    asked = {r["qid"] for r in workload.registered()[name](spark, SF_DIR).select("qid").collect()}
    assert asked == {r["id"] for r in objects.select("id").collect() if r["id"] % 50 == 0} and len(asked) > workload.N_QUERIES


def test_many_queries_leave_the_literal_path(spark, objects, brute, monkeypatch):
    monkeypatch.setattr(workload, "EVERY", 10)
    got = {}
    for r in workload.registered()["knn_many"](spark, SF_DIR).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["id"]
    assert len(got) > 64
    for row in brute.rows:
        if row["id"] % 10 == 0:
            best = sorted(zip(brute.distances(row).round(9), brute.ids))[: workload.K]
            assert [got[row["id"]][k + 1] for k in range(workload.K)] == [i for _, i in best]


def tables(spark, path, n):
    """Orders and customers for ``n`` objects, written to a folder."""
    draw = random.Random(n)
    customers = [(i, draw.uniform(-1000, 10000), draw.randrange(25)) for i in range(30)]
    orders = [(i, draw.randrange(30), draw.uniform(0, 500000), f"1996-01-{1 + i % 28:02d}") for i in range(n)]
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    made = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, day string")
    made.selectExpr("* except (day)", "cast(day as timestamp) as o_orderdate").write.parquet(f"{path}/orders.parquet")
    return customers, orders


@pytest.mark.parametrize("n", [200, 1200])
def test_the_radius_of_a_batch_does_not_fall_with_the_table(spark, tmp_path, n):
    customers, orders = tables(spark, tmp_path, n)

    def near(a, b):
        sides = [((customers[o[1]][1] + 1000) / 11000, (1 + o[0] % 28) / 366, customers[o[1]][2] / 25) for o in (a, b)]
        return abs(a[2] - b[2]) / 500000 + math.dist(*sides)

    got = {(r["qid"], r["id"]) for r in workload.registered()["range_query_batch_many"](spark, str(tmp_path)).collect()}
    assert got == {(q[0], o[0]) for q in orders[::50] for o in orders if round(near(q, o), 9) <= 0.2}


def test_levels_are_answered_one_by_one(spark, tmp_path):
    """What merges the answers of all levels holds no join of any of them."""
    tables(spark, tmp_path, 4000)
    found = workload.registered()["merge_answers_many"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = workload.registered()["range_query_indexed_many"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
