from nearfield import session
from nearfield.session import fits_broadcast, lookup_join
from pyspark.sql import functions as F


def sides(spark):
    # a third of the left rows share key 0, and so do many right rows
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).alias("k"))
    right = spark.range(400).select(F.col("id").alias("qid"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 100).alias("k"))
    return left, right


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


def test_cut_join_equals_plain(spark):
    left, right = sides(spark)
    cut = lookup_join(left, right, ["k"], right_split_on="qid", max_broadcast_rows=10, split_rows=100)
    assert rows(cut) == rows(left.join(right, "k"))


def test_cut_semi_anti_left(spark):
    left, right = sides(spark)
    keys = right.select("k").distinct()
    for how in ("left_semi", "left_anti", "left", "inner"):
        cut = lookup_join(left, keys, ["k"], how, max_broadcast_rows=10, split_rows=100)
        assert rows(cut) == rows(left.join(keys, ["k"], how)), how


def test_hot_key_really_is_cut(spark):
    left, right = sides(spark)
    cut = lookup_join(left, right, ["k"], right_split_on="qid", max_broadcast_rows=10, split_rows=100)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "_lp" in plan and "_rp" in plan


def test_broadcast_needs_small_rows_and_bytes(spark):
    wide = spark.range(10).select("id", F.array_repeat(F.lit(1.0), 100_000).alias("v"))
    assert fits_broadcast(spark.range(10), 10) and not fits_broadcast(spark.range(11), 10)
    assert not fits_broadcast(wide, 100, 1 << 20)


def test_stage_uses_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert session.stage_root(spark).startswith(root)
    df = session.stage(spark.range(5).toDF("a"), "t")
    assert df.count() == 5 and root in df.inputFiles()[0]
