"""Objects as text: a key line, a line naming the descriptors that follow, one
line per descriptor. A record mark separates records, so files split anywhere.

Keys are numbers, or any text with ``key="string"``. Objects with a number and a vector
have two descriptors of fixed names; map objects name any, parted by commas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_MARK = "#key "
NUMBER_NAME, VECTOR_NAME = "number", "vector"
# Fixed values of the text format: values are parted by a comma or blanks.
VALUE_SEPARATOR = r"\s*[ ,]\s*"


def read_records(spark: SparkSession, path: str, mark: str = RECORD_MARK) -> DataFrame:
    """One row per record, in column ``record``, without its mark."""
    raw = spark.read.option("lineSep", mark).text(path)
    # A file that starts with the mark yields an empty first row.
    return raw.where(F.trim("value") != "").withColumnRenamed("value", "record")


def record_lines(records: DataFrame) -> DataFrame:
    """record, _key (null if blank) and the other lines that count; comments and empty lines do not."""
    lines = F.transform(F.split("record", "\r?\n"), lambda line: F.trim(line))
    kept = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda s: (s != "") & ~s.startswith("#"))
    return records.select("record", F.nullif(F.try_element_at(lines, F.lit(1)), F.lit("")).alias("_key"), kept.alias("_lines"))


def key_error(key: str) -> str:
    return "no key" if key == "string" else "key is not a number"


def parse_records(records: DataFrame, key: str = "long") -> DataFrame:
    """Columns id, number, vector, error, record; error is null for good ones. ``key`` is
    the type of the ids."""
    df = record_lines(records)
    header = F.get("_lines", F.lit(0))
    has_number, has_vector = header.contains(NUMBER_NAME), header.contains(VECTOR_NAME)
    number_text = F.when(has_number, F.get("_lines", F.lit(1)))
    vector_text = F.when(has_vector, F.get("_lines", F.when(has_number, 2).otherwise(1)))
    items = F.split(vector_text, VALUE_SEPARATOR)
    df = df.select(
        "record",
        F.col("_key").try_cast(key).alias("id"),
        header.alias("_header"),
        has_number.alias("_has_number"),
        has_vector.alias("_has_vector"),
        number_text.try_cast("double").alias("number"),
        F.transform(items, lambda s: s.try_cast("double")).alias("vector"),
    )
    error = (
        F.when(F.col("id").isNull(), key_error(key))
        .when(F.col("_header").isNull(), "no descriptor line")
        .when(F.col("_has_number") & F.col("number").isNull(), "bad number")
        .when(F.col("_has_vector") & (F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull())), "bad vector")
    )
    return df.select("id", "number", "vector", error.alias("error"), "record")


def parse_map_records(records: DataFrame, key: str = "long") -> DataFrame:
    """Columns id, descriptors (name -> values), error, record; error is null for good ones.
    A line of names without any name is an object without descriptors."""
    df = record_lines(records)
    header = F.get("_lines", F.lit(0))
    names = F.filter(F.transform(F.split(header, ","), lambda n: F.trim(n)), lambda n: n != "")
    df = df.select("record", F.col("_key").try_cast(key).alias("id"), "_lines", names.alias("_names"))
    items = F.transform(F.slice("_lines", F.lit(2), F.size("_names")), lambda line: F.split(line, VALUE_SEPARATOR))
    df = df.withColumn("_values", F.transform(items, lambda values: F.transform(values, lambda v: v.try_cast("double"))))
    error = (
        F.when(F.col("id").isNull(), key_error(key))
        .when(F.col("_names").isNull(), "no descriptor line")
        .when(F.size(F.array_distinct("_names")) < F.size("_names"), "repeated name")
        .when(F.size("_values") < F.size("_names"), "missing descriptor")
        .when(F.exists("_values", lambda values: F.exists(values, lambda v: v.isNull())), "bad value")
    )
    df = df.withColumn("error", error)
    found = F.when(F.col("error").isNull(), F.map_from_arrays("_names", "_values"))
    return df.select("id", found.alias("descriptors"), "error", "record")


def _parted(parsed: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    good = parsed.where(F.col("error").isNull()).select(*columns)
    return good, parsed.where(F.col("error").isNotNull()).select("record", "error")


def read_objects_text(spark: SparkSession, path: str, mark: str = RECORD_MARK, key: str = "long") -> tuple[DataFrame, DataFrame]:
    """(objects, rejected records)."""
    return _parted(parse_records(read_records(spark, path, mark), key), "id", "number", "vector")


def read_maps_text(spark: SparkSession, path: str, mark: str = RECORD_MARK, key: str = "long") -> tuple[DataFrame, DataFrame]:
    """(map objects, rejected records)."""
    return _parted(parse_map_records(read_records(spark, path, mark), key), "id", "descriptors")


def record_text(mark: str = RECORD_MARK, places: int | None = None) -> Column:
    """The text of one object, without the closing line break. Values are
    written in full, or cut to a fixed number of decimals."""
    number, vector = F.col("number"), F.col("vector")

    def show(value: Column) -> Column:
        if places is None:
            return value.cast("string")
        unit = float(10**places)
        return (F.floor(value * unit) / unit).cast(f"decimal(28,{places})").cast("string")

    names = F.concat(
        F.when(number.isNotNull(), NUMBER_NAME).otherwise(""),
        F.lit(","),
        F.when(vector.isNotNull(), VECTOR_NAME).otherwise(""),
    )
    values = F.array_join(F.transform(vector, show), ",")
    # concat_ws leaves out the lines of missing descriptors
    return F.concat_ws("\n", F.concat(F.lit(mark), F.col("id").cast("string")), names, show(number), values)


def write_objects_text(objects: DataFrame, path: str, mark: str = RECORD_MARK, places: int | None = None) -> None:
    objects.select(record_text(mark, places)).write.text(path)


def map_record_text(mark: str = RECORD_MARK) -> Column:
    """The text of one map object, names in order. A name that the text cannot carry (blank
    at an end, a comma, a line break, a leading #) or a descriptor without values fails."""
    names = F.array_sort(F.map_keys("descriptors"))
    lines = F.transform(names, lambda n: F.array_join(F.element_at("descriptors", n), ",", "null"))
    lost = F.exists(names, lambda n: n.rlike(r"^[\s#]|[,\r\n]|\s$|^$") | (F.size(F.element_at("descriptors", n)) < 1))
    header = F.when(F.size(names) == 0, ",").otherwise(F.array_join(names, ","))
    text = F.concat_ws("\n", F.concat(F.lit(mark), F.col("id").cast("string")), header, lines)
    return F.when(lost, F.raise_error(F.lit("a descriptor that the text cannot carry")).cast("string")).otherwise(text)


def write_maps_text(objects: DataFrame, path: str, mark: str = RECORD_MARK) -> None:
    objects.select(map_record_text(mark)).write.text(path)
