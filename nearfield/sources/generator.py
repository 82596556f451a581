"""Random objects: a uniform number and a uniform vector, both in [0, 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VECTOR_LENGTH = 3
_DIGITS = 8  # hexadecimal digits per value


def _uniform(digest: Column, i: int) -> Column:
    part = F.substring(digest, 1 + i * _DIGITS, _DIGITS)
    return F.conv(part, 16, 10).cast("double") / float(16**_DIGITS)


def random_objects_for(ids: DataFrame, seed: int = 0) -> DataFrame:
    """One object per id. Values follow from id and seed alone, so a rerun of a
    lost task gives the same objects."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    vector = F.array(*[_uniform(F.col("_h"), i) for i in range(1, 1 + VECTOR_LENGTH)])
    return ids.select("id", digest.alias("_h")).select("id", _uniform(F.col("_h"), 0).alias("number"), vector.alias("vector"))


def random_objects(spark: SparkSession, low: int, high: int, seed: int = 0) -> DataFrame:
    """Objects with ids ``low`` up to, not including, ``high``."""
    return random_objects_for(spark.range(low, high), seed)
