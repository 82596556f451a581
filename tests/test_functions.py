import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nearfield.functions import descriptors as desc
from nearfield.functions.distances import CompositeMetric, CustomMetric, MapMetric, VectorMetric, columns, l2
from nearfield.functions.zones import zone_of


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {t}" for n, (_, t) in values.items())
    return spark.createDataFrame([tuple(v for v, _ in values.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("length", [None, 3])
def test_l2(spark, length):
    got = one(spark, F.expr(l2("a", "b", length)), a=([1.0, 2.0, 3.0], "array<double>"), b=([1.0, 4.0, 3.0], "array<float>"))
    assert got == 2.0


@pytest.mark.parametrize("length", [None, 2])
def test_l2_refuses_other_length(spark, length):
    with pytest.raises(PySparkException, match="number of dimensions"):
        one(spark, F.expr(l2("a", "b", length)), a=([1.0, 2.0], "array<double>"), b=([1.0, 2.0, 3.0], "array<double>"))


@pytest.mark.parametrize("length", [None, 2])
def test_composite_skips_missing(spark, length):
    metric = CompositeMetric(length)
    rows = spark.createDataFrame(
        [(1, 1.0, [0.0, 3.0]), (2, None, [0.0, 3.0]), (3, 1.0, None), (4, None, None)],
        "id long, number double, vector array<double>",
    )
    probe = {"number": 3.0, "vector": [4.0, 0.0]}
    dist = metric.breakdown(columns(metric), metric.literal(probe))
    got = {r["id"]: (r["v"]["d_number"], r["v"]["d_vector"], r["v"]["dist"]) for r in rows.select("id", dist.alias("v")).collect()}
    assert got == {1: (2.0, 5.0, 7.0), 2: (None, 5.0, 5.0), 3: (2.0, None, 2.0), 4: (None, None, 0.0)}
    none = metric.distance(columns(metric), metric.literal({"number": None, "vector": [4.0, 0.0]}))
    assert [r["v"] for r in rows.orderBy("id").select(none.alias("v")).collect()] == [5.0, 5.0, 0.0, 0.0]


def test_map_distance_uses_shared_names(spark):
    metric = MapMetric()
    df = spark.createDataFrame([({"number": [1.0], "vector": [0.0, 0.0]},)], "descriptors map<string,array<double>>")
    probe = {"descriptors": {"number": [3.5], "vector": [3.0, 4.0], "extra": [9.0]}}
    got = df.select(metric.distance(columns(metric), metric.literal(probe)).alias("v")).first()["v"]
    assert got == 7.5


def test_custom_metric(spark):
    manhattan = CustomMetric({"x": "double", "y": "double"}, lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]))
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert df.select(manhattan.distance(columns(manhattan), manhattan.literal({"x": 4.0, "y": 0.0})).alias("v")).first()["v"] == 5.0


def test_triangle_inequality(spark, brute):
    rows = brute.rows[:60]
    index = {int(i): k for k, i in enumerate(brute.ids)}
    d = {r["id"]: brute.distances(r) for r in rows}
    for a in rows[:20]:
        for b in rows[20:40]:
            for c in rows[40:]:
                ab, bc = d[a["id"]][index[b["id"]]], d[b["id"]][index[c["id"]]]
                assert d[a["id"]][index[c["id"]]] <= ab + bc + 1e-12


def test_index_refuses_missing_descriptor(spark):
    df = spark.createDataFrame([(1, None, [0.0, 3.0])], "id long, number double, vector array<double>")
    with pytest.raises(PySparkException, match="lacks a descriptor"):
        CompositeMetric(2).validated(df).collect()
    short = spark.createDataFrame([(1, [0.0, 3.0])], "id long, vector array<double>")
    with pytest.raises(PySparkException, match="number of dimensions"):
        VectorMetric(3).validated(short).collect()


def test_zone_borders(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,), (0.7,), (0.70001,)], "d double")
    zones = [r["z"] for r in df.select(zone_of(F.col("d"), F.lit(0.5), F.lit(0.7)).alias("z")).collect()]
    assert zones == [0, -1, -1, 1]
    with pytest.raises(PySparkException, match="must not be negative"):
        df.select(zone_of(F.col("d"), F.lit(-0.1), F.lit(0.7))).collect()


def test_descriptor_helpers(spark):
    df = spark.createDataFrame(
        [(7, 0.12345, [1.0, 2.5], {"b": [1.0], "a": [2.0]})],
        "id long, number double, vector array<double>, m map<string,array<double>>",
    )
    row = df.select(
        desc.object_label().alias("label"),
        desc.object_bytes().alias("bytes"),
        desc.descriptor_names("m").alias("names"),
        desc.descriptor("m", "zz").alias("missing"),
        desc.restrict("m", ["a"]).alias("only_a"),
    ).first()
    assert row["label"] == "7: 0.1234, [1.0000, 2.5000]"
    assert row["bytes"] == 12
    assert row["names"] == ["a", "b"] and row["missing"] is None and row["only_a"] == {"a": [2.0]}


def test_equal_groups(spark):
    df = spark.createDataFrame([(1, 1.0, [1.0]), (2, 1.0, [1.0]), (3, 1.0, [2.0])], "id long, number double, vector array<double>")
    assert [(r["number"], r["vector"], r["n"]) for r in desc.equal_groups(df).collect()] == [(1.0, [1.0], 2)]
