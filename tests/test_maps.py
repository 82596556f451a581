"""Batch queries over maps against distances over the names that both hold."""

import math
import random

import pytest

from nearfield.functions.distances import MapMetric
from nearfield.operators import maps

MAPS = "id long, descriptors map<string,array<double>>"


def distance(a, b):
    a, b = ({k: v for k, v in (m or {}).items() if v is not None} for m in (a, b))
    return round(sum(math.dist(a[n], b[n]) for n in a.keys() & b.keys()), 9)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    made = [(i, {n: [rng.random() for _ in range(size)] for n, size in (("number", 1), ("it's", 3))[: 1 + i % 2]}) for i in range(60)]
    return made + [(900, {}), (901, None), (902, {"number": [0.5], "it's": None})]


def test_ranges_equal_brute_force(spark, rows):
    some = [*rows[:4], *rows[-3:]]
    asked = spark.createDataFrame([(i, m, 0.3) for i, m in some], "qid long, descriptors map<string,array<double>>, radius double")
    found = maps.range_query_batch_map(spark.createDataFrame(rows, MAPS), asked, MapMetric()).collect()
    got = {(r["qid"], r["id"]): round(r["dist"], 9) for r in found}
    assert len(got) == len(found)
    assert got == {(q, i): d for q, m in some for i, o in rows if (d := distance(m, o)) <= 0.3}


def test_too_many_sets_of_names_are_refused(spark):
    many = spark.createDataFrame([(i, {f"n{i}": [1.0]}) for i in range(maps.MAX_NAME_SETS + 1)], MAPS)
    with pytest.raises(ValueError, match="sets of names"):
        maps.range_query_batch_map(many, many.selectExpr("id as qid", "descriptors", "1D as radius"), MapMetric())
