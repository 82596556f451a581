"""Descriptor access, object size, labels and exact duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOAT_BYTES = 4


def descriptor(map_column: str, name: str) -> Column:
    """One descriptor by name, null when the object has none of that name."""
    return F.try_element_at(map_column, F.lit(name))


def descriptor_names(map_column: str) -> Column:
    return F.array_sort(F.map_keys(map_column))


def restrict(map_column: str, names: Sequence[str]) -> Column:
    """Keep only the named descriptors, as when loading with a name list."""
    return F.map_filter(map_column, lambda name, _: name.isin(*names))


def object_bytes(number: str | None = "number", vector: str | None = "vector") -> Column:
    """Data size with four bytes per stored value; absent descriptors are free."""
    total = F.lit(0).cast("long")
    if number is not None:
        total = total + F.when(F.col(number).isNotNull(), FLOAT_BYTES).otherwise(0)
    if vector is not None:
        total = total + FLOAT_BYTES * F.coalesce(F.size(vector), F.lit(0))
    return total


def object_label(id_column: str = "id", number: str = "number", vector: str = "vector", places: int = 4) -> Column:
    """Readable ``id: number, [v1, v2, ...]``; values are cut, not rounded, to
    ``places`` decimals, so the digits never depend on a tie."""
    unit = float(10**places)

    def show(value: Column) -> Column:
        return (F.floor(value * unit) / unit).cast(f"decimal(18,{places})").cast("string")

    values = F.concat(F.lit("["), F.array_join(F.transform(vector, show), ", "), F.lit("]"))
    shown = F.coalesce(show(F.col(number)), F.lit("null"))
    return F.concat(F.col(id_column).cast("string"), F.lit(": "), shown, F.lit(", "), F.coalesce(values, F.lit("null")))


def equal_groups(objects: DataFrame, by: Sequence[str] = ("number", "vector")) -> DataFrame:
    """Data values held by more than one object, with how many hold them.

    Counts combine before the shuffle, so a value shared by a third of all
    objects still sends one row per task."""
    return objects.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > 1)
