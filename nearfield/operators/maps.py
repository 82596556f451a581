"""Batch queries over objects that are maps of named descriptors.

The map distance sums over the names both maps hold, so it obeys the triangle inequality
only among objects compared over the same names. Queries and objects are therefore taken
by their names: a query meets the objects that share a given set of names with it through
a grid of its own, over those names only, where the sum is a (pseudo-)metric. Objects that
share no name with a query lie at distance 0 and are answers of every radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.distances import MapMetric, l2
from nearfield.operators.probes import MAX_PROBES
from nearfield.operators.similarity import Grid, _with_knn_radius, nearest, plan_grid, range_query_batch
from nearfield.session import BROADCAST_ROWS, bounded_rows, lookup_join, stage

# Different sets of names that a table may hold.
MAX_NAME_SETS = 64


class SharedMapMetric(MapMetric):
    """The map distance over fixed names, for maps that hold all of them."""

    def __init__(self, names: tuple[str, ...], column: str = "descriptors"):
        super().__init__(column)
        self.names = names

    def _item(self, side: str, name: str) -> str:
        text = name.replace("\\", "\\\\").replace("'", "\\'")
        return f"try_element_at({side}, '{text}')"

    def sql(self, a, b, checked=True):
        (column,) = self.types
        return " + ".join(l2(self._item(a[column], n), self._item(b[column], n), None, checked) for n in self.names)

    def complete(self, a):
        (column,) = self.types
        return F.expr(" AND ".join(f"{self._item(a[column], n)} IS NOT NULL" for n in self.names))


def _names(column: str) -> Column:
    """The names a map has a descriptor for, sorted."""
    held = F.map_filter(column, lambda _, v: v.isNotNull())
    return F.array_sort(F.coalesce(F.map_keys(held), F.array().cast("array<string>")))


def range_query_batch_map(objects: DataFrame, queries: DataFrame, metric: MapMetric, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Answers (qid, id, dist) of range queries over maps, each with its own radius."""
    (column,) = metric.columns
    objects = objects.select("id", column).withColumn("_names", _names(column))
    queries = queries.select("qid", column, "radius").withColumn("_names", _names(column))
    held = [tuple(r[0]) for r in bounded_rows(objects.select("_names").distinct(), MAX_NAME_SETS, "sets of names")]
    asked = [tuple(r[0]) for r in bounded_rows(queries.select("_names").distinct(), MAX_NAME_SETS, "sets of names")]
    grids: dict[tuple[str, ...], Grid] = {}
    found = None
    for wanted in asked:
        mine = queries.where(_equal("_names", wanted))
        for shared in sorted({tuple(n for n in wanted if n in names) for names in held}):
            alike = [names for names in held if tuple(n for n in wanted if n in names) == shared]
            others = objects.where(F.expr(" OR ".join(f"({_equal_sql('_names', names)})" for names in alike)))
            if shared:
                over = SharedMapMetric(shared, column)
                if shared not in grids:
                    grids[shared] = plan_grid(objects, over)
                part = range_query_batch(others, mine, over, grids[shared], max_broadcast_rows)
            else:  # every such pair is an answer of distance 0
                left, right = others.select("id", F.lit(0).alias("_cell")), mine.where("radius >= 0").select("qid", F.lit(0).alias("_cell"))
                pairs = lookup_join(left, right, ["_cell"], right_split_on="qid", max_broadcast_rows=max_broadcast_rows)
                part = pairs.select("qid", "id", F.lit(0.0).alias("dist"))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.join(objects.select("id"), F.lit(False)).select("qid", "id", F.lit(0.0).alias("dist"))
    return found


def knn_map(objects: DataFrame, queries: DataFrame, k: int, metric: MapMetric, max_probes: int = MAX_PROBES) -> DataFrame:
    """The ``k`` nearest maps of every query: (qid, id, dist, rank)."""
    bounded = stage(_with_knn_radius(objects, queries, k, metric, max_probes), "knn-radius")
    return nearest(range_query_batch_map(objects, bounded, metric), k)


def _equal_sql(column: str, names: tuple[str, ...]) -> str:
    texts = ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names)
    return f"{column} = cast(array({texts}) as array<string>)"


def _equal(column: str, names: tuple[str, ...]) -> Column:
    return F.expr(_equal_sql(column, names))
