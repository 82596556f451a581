import pytest
from pyspark.sql import functions as F

from nearfield.session import stage_path
from nearfield.sources import buckets, generator, text_records


def test_text_records(spark, tmp_path):
    text = (
        "#key 1\nnumber,vector\n0.5\n0.1,0.2 ,0.3\n#key 2\n,vector\n1 2 3\n#key 3\nnumber,\n7\n"
        "#key x\nnumber,\n1\n#key 5\nnumber,\nabc\n#key 6\nnumber,vector\n1.5\n# a comment\n4,5\n#key 7\nnumber,vector\n1\n1,zz\n"
    )
    (tmp_path / "objects.txt").write_text(text)
    good, bad = text_records.read_objects_text(spark, str(tmp_path))
    assert {r["id"]: (r["number"], r["vector"]) for r in good.collect()} == {
        1: (0.5, [0.1, 0.2, 0.3]),
        2: (None, [1.0, 2.0, 3.0]),
        3: (7.0, None),
        6: (1.5, [4.0, 5.0]),
    }
    assert sorted(r["error"] for r in bad.collect()) == ["bad number", "bad vector", "key is not a number"]


def test_text_round_trip(spark):
    df = spark.createDataFrame(
        [(1, 1e-7, [0.1, 2e10, -3.0]), (2, None, [1.0]), (3, 4.0, None), (4, None, None)],
        "id long, number double, vector array<double>",
    )
    path = stage_path(spark, "text")
    text_records.write_objects_text(df, path)
    good, bad = text_records.read_objects_text(spark, path)
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, df.collect())) and bad.count() == 0


def test_keys_of_any_text(spark, tmp_path):
    (tmp_path / "objects.txt").write_text("#key a b/1\nnumber,\n1\n#key  \nnumber,\n2\n#key 3\nnumber,\nx\n")
    good, bad = text_records.read_objects_text(spark, str(tmp_path), key="string")
    assert [tuple(r) for r in good.collect()] == [("a b/1", 1.0, None)]
    assert sorted(r["error"] for r in bad.collect()) == ["bad number", "no key"]


def test_map_records(spark, tmp_path):
    text = (
        "#key 1\na, b\n1,2\n# a comment\n3\n#key 2\n,\n#key 3\na,a\n1\n2\n#key 4\na,b\n1\n#key 5\na\n1,zz\n#key 6\n#key y\na\n1\n"
    )
    (tmp_path / "maps.txt").write_text(text)
    good, bad = text_records.read_maps_text(spark, str(tmp_path))
    assert {r["id"]: r["descriptors"] for r in good.collect()} == {1: {"a": [1.0, 2.0], "b": [3.0]}, 2: {}}
    assert sorted(r["error"] for r in bad.collect()) == [
        "bad value", "key is not a number", "missing descriptor", "no descriptor line", "repeated name",
    ]


def test_map_text_round_trip(spark):
    df = spark.createDataFrame([(1, {"z": [1e-7, -2.0], "a b": [3.0]}), (2, {}), (3, {"a": [0.1]})], "id long, descriptors map<string, array<double>>")
    path = stage_path(spark, "text")
    text_records.write_maps_text(df, path)
    good, bad = text_records.read_maps_text(spark, path)
    assert {r["id"]: r["descriptors"] for r in good.collect()} == {r["id"]: r["descriptors"] for r in df.collect()} and bad.count() == 0
    for broken in ({"a,b": [1.0]}, {"#a": [1.0]}, {"a": []}):
        lost = spark.createDataFrame([(1, broken)], "id long, descriptors map<string, array<double>>")
        with pytest.raises(Exception, match="cannot carry"):
            lost.select(text_records.map_record_text()).collect()


def test_generator_is_repeatable_and_uniform(spark):
    a = generator.random_objects(spark, 10, 2010, seed=4)
    assert a.orderBy("id").collect() == generator.random_objects(spark, 10, 2010, seed=4).orderBy("id").collect()
    stats = a.select("id", F.explode(F.array_append("vector", F.col("number"))).alias("v")).agg(F.min("v"), F.max("v"), F.avg("v")).first()
    assert 0 <= stats[0] and stats[1] < 1 and abs(stats[2] - 0.5) < 0.02
    assert a.count() == 2000 and a.agg(F.min("id"), F.max("id")).first()[:] == (10, 2009)


def store(spark):
    df = spark.range(60).select("id", (F.col("id") % 4).cast("double").alias("number"), F.lit(0).alias("level"), (F.col("id") % 6).cast("int").alias("bucket"))
    path = stage_path(spark, "store")
    buckets.append_buckets(df, path)
    return df, path


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_delete_by_data_with_limit(spark):
    df, path = store(spark)
    victims = spark.createDataFrame([(1.0,), (1.0,), (3.0,)], "number double")
    assert buckets.delete_objects(spark, path, victims, by=["number"], limit=2) == 4
    assert ids(buckets.read_buckets(spark, path)) == [i for i in range(60) if i not in (1, 5, 3, 7)]
    assert buckets.delete_objects(spark, path, victims, by=["number"]) == 26
    assert ids(buckets.read_buckets(spark, path)) == [i for i in range(60) if i % 4 in (0, 2)]
    assert buckets.delete_objects(spark, path, victims, by=["number"]) == 0


def test_delete_matches_null_with_null(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "id long, number double")
    gone = spark.createDataFrame([(None,)], "number double")
    assert ids(buckets.without_objects(df, gone, by=["number"])) == [2]


def test_delete_that_empties_a_bucket(spark):
    df, path = store(spark)
    assert buckets.delete_objects(spark, path, df.where("bucket = 2")) == 10
    assert {r["bucket"]: r["n"] for r in buckets.bucket_counts(buckets.read_buckets(spark, path)).collect()} == {b: 10 for b in (0, 1, 3, 4, 5)}


def test_drop_range_and_lookups(spark):
    df, path = store(spark)
    assert buckets.drop_bucket_range(spark, path, 0, 1, 3) == 3
    stored = buckets.read_buckets(spark, path)
    assert ids(stored) == ids(buckets.without_bucket_range(df, 1, 3))
    assert ids(buckets.lookup_key(stored, 4)) == [4]
    assert ids(buckets.lookup_keys(stored, spark.createDataFrame([(4,), (4,), (6,), (1,)], "id long"))) == [4, 6]
    assert ids(buckets.lookup_key_range(stored, 4, 6)) == [4, 5, 6]
    assert "GreaterThanOrEqual(id,4)" in buckets.lookup_key_range(stored, 4, 6)._jdf.queryExecution().executedPlan().toString()


def test_append_adds(spark):
    df, path = store(spark)
    buckets.append_buckets(df.withColumn("id", F.col("id") + 100), path)
    assert buckets.read_buckets(spark, path).count() == 120
