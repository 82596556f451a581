"""Distances as column expressions.

A *side* maps a descriptor name to SQL text, so the same metric works between two
columns of a row, between the two inputs of a join, and against a literal object
baked into the plan. Text keeps planning quick: dozens of distances to literal
objects are one parsed expression instead of thousands of calls into the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

Side = Mapping[str, str]

# Vectors up to this length are written out as scalar arithmetic, which stays
# inside generated code; longer ones use the array functions.
UNROLLED_LENGTH = 16

_LENGTH_ERROR = "cast(raise_error('vectors differ in number of dimensions') as {type})"


def number_distance(a: str, b: str) -> str:
    return f"abs(cast({a} as double) - cast({b} as double))"


def l2(a: str, b: str, length: int | None = None, checked: bool = True) -> str:
    """Euclidean distance; vectors of different length are an error.

    ``length`` promises the number of dimensions and allows the unrolled form.
    ``checked=False`` leaves the length test out for columns that passed it."""
    if length is not None and length <= UNROLLED_LENGTH:
        gaps = [f"(cast(get({a}, {i}) as double) - cast(get({b}, {i}) as double))" for i in range(length)]
        value = f"sqrt({' + '.join(['0D', *(f'{g} * {g}' for g in gaps)])})"
        bad = f"size({a}) <> {length} OR size({b}) <> {length}"
    else:
        gap = "(cast(x as double) - cast(y as double))"
        value = f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> {gap} * {gap}), 0D, (s, v) -> s + v))"
        bad = f"size({a}) <> size({b})"
    if not checked:
        return value
    error = _LENGTH_ERROR.format(type="double")
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {bad} THEN {error} ELSE {value} END"


class Metric:
    """A distance over named descriptor columns, given with their SQL types."""

    types: Mapping[str, str] = {}
    length: int | None = None

    @property
    def name(self) -> str:
        """What tells metrics over the same objects apart; stored with an index."""
        return f"{type(self).__name__}({', '.join(self.types)}; {self.length})"

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.types)

    def sql(self, a: Side, b: Side, checked: bool = True) -> str:
        raise NotImplementedError

    def distance(self, a: Side, b: Side, checked: bool = True) -> Column:
        return F.expr(self.sql(a, b, checked))

    def distances(self, side: Side, objects: Sequence[Row | Mapping], checked: bool = True) -> Column:
        """Distances to each literal object, as an array in their order."""
        texts = [self.sql(side, self.literal(o), checked) for o in objects]
        return F.expr(f"array({', '.join(texts)})")

    def looped_distances(self, side: Side, objects: Sequence[Row | Mapping]) -> Column:
        """The same by looping over one literal list: quicker to plan, slower
        per row."""
        return F.expr(f"transform({self._listed(objects)}, o -> {self.sql(side, {n: f'o.{n}' for n in self.types})})")

    def complete(self, a: Side) -> Column:
        """True where every descriptor is present; only such objects obey the
        triangle inequality and may be pruned or indexed."""
        return F.expr(" AND ".join(f"{a[name]} IS NOT NULL" for name in self.types))

    def validated(self, df: DataFrame) -> DataFrame:
        """``df`` with a failure raised for objects the index must refuse."""
        name = self.columns[0]
        refuse = F.raise_error(F.lit("object lacks a descriptor")).cast(df.schema[name].dataType)
        return df.withColumn(name, F.when(self.complete(columns(self)), F.col(name)).otherwise(refuse))

    def literal(self, row: Row | Mapping) -> dict[str, str]:
        return {name: _sql_literal(row[name], kind) for name, kind in self.types.items()}

    def _listed(self, objects: Sequence[Row | Mapping]) -> str:
        structs = []
        for o in objects:
            fields = ", ".join(f"'{n}', {text}" for n, text in self.literal(o).items())
            structs.append(f"named_struct({fields})")
        return f"array({', '.join(structs)})"


class NumberMetric(Metric):
    types = {"number": "double"}

    def sql(self, a, b, checked=True):
        return number_distance(a["number"], b["number"])


class VectorMetric(Metric):
    def __init__(self, length: int | None = None, column: str = "vector"):
        self.length = length
        self.types = {column: "array<double>"}

    def sql(self, a, b, checked=True):
        (name,) = self.types
        return l2(a[name], b[name], self.length, checked)

    def validated(self, df):
        return _check_length(super().validated(df), self.columns[0], self.length)


class CompositeMetric(Metric):
    """Number distance plus vector distance; a descriptor missing on either
    side adds nothing."""

    types = {"number": "double", "vector": "array<double>"}

    def __init__(self, length: int | None = None):
        self.length = length

    def parts(self, a: Side, b: Side, checked: bool = True) -> dict[str, str]:
        return {
            "d_number": number_distance(a["number"], b["number"]),
            "d_vector": l2(a["vector"], b["vector"], self.length, checked),
        }

    def sql(self, a, b, checked=True):
        return " + ".join(f"coalesce({part}, 0D)" for part in self.parts(a, b, checked).values())

    def breakdown(self, a: Side, b: Side) -> Column:
        """Both component distances and their sum in one struct."""
        parts = {**self.parts(a, b), "dist": self.sql(a, b)}
        return F.struct(*[F.expr(text).alias(name) for name, text in parts.items()])

    def validated(self, df):
        return _check_length(super().validated(df), "vector", self.length)


class MapMetric(Metric):
    """Sum of Euclidean distances over the names both maps hold."""

    def __init__(self, column: str = "descriptors"):
        self.types = {column: "map<string,array<double>>"}

    def parts(self, a: Side, b: Side) -> str:
        (name,) = self.types
        both = f"map_zip_with({a[name]}, {b[name]}, (k, x, y) -> {l2('x', 'y')})"
        return f"map_filter({both}, (k, d) -> d IS NOT NULL)"

    def sql(self, a, b, checked=True):
        return f"aggregate(map_values({self.parts(a, b)}), 0D, (s, v) -> s + v)"

    def complete(self, a):
        """A map is only comparable within one key set, so nothing is pruned."""
        return F.lit(False)


class CustomMetric(Metric):
    """A user's own distance: any function of two sides of Columns."""

    def __init__(self, types: Mapping[str, str], function: Callable[[Mapping[str, Column], Mapping[str, Column]], Column]):
        self.types = dict(types)
        self.function = function

    def distance(self, a, b, checked=True):
        return self.function(*({n: F.expr(text) for n, text in side.items()} for side in (a, b)))

    def distances(self, side, objects, checked=True):
        if not objects:
            return F.expr("cast(array() as array<double>)")
        return F.array(*[self.distance(side, self.literal(o), checked) for o in objects])

    def looped_distances(self, side, objects):
        own = {n: F.expr(text) for n, text in side.items()}
        return F.transform(F.expr(self._listed(objects)), lambda o: self.function(own, {n: o[n] for n in self.types}))


def columns(metric: Metric, prefix: str = "") -> dict[str, str]:
    return {name: f"`{prefix}{name}`" for name in metric.types}


def distances_to(metric: Metric, objects: Sequence[Row | Mapping], side: Side, checked: bool = True, looped: bool = False) -> Column:
    """Distances from one row to each literal object, as an array of doubles."""
    if not objects:
        return F.expr("cast(array() as array<double>)")
    return metric.looped_distances(side, objects) if looped else metric.distances(side, objects, checked)


def _sql_literal(value, kind: str) -> str:
    """A descriptor value as SQL text."""
    if value is None:
        return f"cast(NULL as {kind})"
    if isinstance(value, Mapping):
        entries = ", ".join(f"{_sql_text(name)}, {_sql_literal(item, 'array<double>')}" for name, item in value.items())
        return f"map({entries})"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(_sql_literal(x, 'double') for x in value)})" if value else f"cast(array() as {kind})"
    number = float(value)
    return f"{number!r}D" if math.isfinite(number) else f"double('{number!r}')"


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _check_length(df: DataFrame, name: str, length: int | None) -> DataFrame:
    if length is None:
        return df
    error = _LENGTH_ERROR.format(type=df.schema[name].dataType.simpleString())
    return df.withColumn(name, F.expr(f"CASE WHEN size(`{name}`) = {length} THEN `{name}` ELSE {error} END"))
