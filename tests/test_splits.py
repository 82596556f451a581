import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.operators.ordering import running_total
from nearfield.operators.splits import balanced_split, histogram_split, median_split, split_report, three_way_split


def plain_bound(distances, rho):
    """The rule in words, tried on every distance."""
    d = sorted(distances)
    median = d[len(d) // 2]
    if rho == 0:
        return median
    score = {x: min(sum(v <= x for v in d), sum(v > x + 2 * rho for v in d)) for x in d}
    best = max(score.values())
    return median if best < len(d) // 4 else max(x for x in d if score[x] == best)


def frame(spark, groups):
    rows = [(g, i, float(v)) for g, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "grp int, id long, dist double")


def bounds(df):
    return {r["grp"]: (r["in_upper"], r["out_lower"]) for r in df.collect()}


@pytest.mark.parametrize(
    "values, rho, expected",
    [
        ([1], 0.1, 1.0),
        ([1, 2], 0.1, 1.0),
        ([0.1, 1, 2], 0.1, 1.0),
        ([1, 1.1, 1.15], 0.4, 1.15),
        ([1, 2, 3, 4], 0.0, 3.0),
        ([0.5] * 10, 0.1, 0.5),
    ],
)
def test_small_cases(spark, values, rho, expected):
    assert bounds(balanced_split(frame(spark, {1: values}), ["grp"], rho)) == {1: (expected, expected + 2 * rho)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(st.integers(0, 3), st.lists(st.integers(0, 40), min_size=1, max_size=40), min_size=1, max_size=4),
    st.sampled_from([0.0, 0.75, 2.0, 6.0]),
)
def test_same_as_plain_loop(spark, groups, rho):
    got = bounds(balanced_split(frame(spark, groups), ["grp"], rho))
    assert {g: b[0] for g, b in got.items()} == {g: plain_bound(v, rho) for g, v in groups.items()}


def test_hot_group_is_split_over_pieces(spark):
    rnd = random.Random(5)
    groups = {1: [rnd.random() for _ in range(3000)], 2: [rnd.random() for _ in range(40)], 3: [0.25] * 2000}
    df = frame(spark, groups)
    for rho in (0.0, 0.1):
        got = bounds(balanced_split(df, ["grp"], rho, group_rows=200))
        assert {g: b[0] for g, b in got.items()} == {g: plain_bound(v, rho) for g, v in groups.items()}
    assert bounds(median_split(df, ["grp"], group_rows=200)) == bounds(median_split(df, ["grp"]))


def test_running_total_pieces_equal_window(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), (F.col("id") % 7).alias("a"), "id")
    one = running_total(df, ["g"], ["a", "id"], F.lit(1), "rank")
    many = running_total(df, ["g"], ["a", "id"], F.lit(1), "rank", group_rows=100)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_histogram_is_close_to_exact(spark):
    rnd = random.Random(3)
    values = [rnd.gauss(1.0, 0.3) for _ in range(4000)]
    df = frame(spark, {1: values})
    row = histogram_split(df, "grp", 0.05, min(values), max(values), 2048).first()
    exact = plain_bound(values, 0.05)
    assert row["in_upper"] in values and abs(row["in_upper"] - exact) < 0.01
    assert row["n"] == 4000 and row["n_inner"] == sum(v <= row["in_upper"] for v in values)


def test_three_way_split_and_report(spark):
    df = frame(spark, {1: [0.1, 0.2, 0.5, 0.9], 2: [1, 1, 1, 1]})
    zoned = three_way_split(df, balanced_split(df, ["grp"], 0.1), ["grp"])
    report = {r["grp"]: (r["pct_in"], r["pct_excl"], r["pct_out"]) for r in split_report(zoned, ["grp"]).collect()}
    assert report == {1: (50.0, 0.0, 50.0), 2: (100.0, 0.0, 0.0)}


def test_bounds_of_rows_at_hand_follow_the_exact_split(spark):
    import numpy as np

    from nearfield.plans.growth import balanced_bound

    rng = np.random.default_rng(5)
    for rho in (0.0, 0.05, 0.3):
        for values in (rng.random(200), np.round(rng.random(100), 1), np.ones(9), np.array([1, 1.1, 1.15]), np.array([2.0, 1.0, 4.0, 3.0])):
            df = spark.createDataFrame([(0, float(v)) for v in values], "grp int, dist double")
            assert balanced_bound(values, rho) == balanced_split(df, ["grp"], rho).first()["in_upper"]


def test_subtrees_stop_where_leaves_fit_or_cannot_shrink():
    import numpy as np

    from nearfield.plans.growth import subtree
    from nearfield.plans.tree import depth_of

    rng = np.random.default_rng(6)
    matrix = rng.random((1000, 6))
    found = {n: (a, b) for n, a, b in subtree(1, matrix, 1000, 0.02, 1.0, 100, 2, 6)}
    left = {1: np.arange(1000)}
    for node in sorted(found):
        rows, (inner, outer) = left.pop(node), found[node]
        assert len(rows) > 100
        dist = matrix[rows, depth_of(node)]
        left[2 * node], left[2 * node + 1] = rows[dist <= inner], rows[dist > outer]
    assert all(len(rows) <= 100 or depth_of(n) == 6 for n, rows in left.items())
    assert subtree(4, np.ones((50, 6)), 50, 0.1, 1.0, 10, 2, 6) == [(4, None, None)]
    # seen through a sample, a leaf with few sampled objects stays whole
    assert len(subtree(1, matrix, 10**6, 0.02, 1.0, 10, 2, 6)) < 20
