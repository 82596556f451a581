"""Which side of an excluded middle a distance falls on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INNER, OUTER, EXCLUDED = 0, 1, -1


def zone_of(dist: Column, in_upper: Column, out_lower: Column) -> Column:
    """Inner up to and including ``in_upper``, outer strictly beyond
    ``out_lower``, excluded between. A negative bound is an error."""
    refuse = F.raise_error(F.lit("split bound must not be negative")).cast("int")
    return (
        F.when(in_upper < 0, refuse)
        .when(dist <= in_upper, INNER)
        .when(dist > out_lower, OUTER)
        .otherwise(EXCLUDED)
    )
