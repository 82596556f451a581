"""The partitioning tree: a bounded driver-side description, applied as columns.

Level by level, a binary tree of excluded-middle splits. All nodes of one depth
of a level share that depth's pivot. A node is numbered like a heap: root 1,
inner child 2n, outer child 2n + 1; a leaf's number is its bucket. Objects in
the middle of any split go on to the next level; the last level is one unsplit
leaf, so every object has exactly one (level, bucket)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.distances import Metric, columns, distances_to
from nearfield.schema import PRUNE_SLACK
from nearfield.session import local_table

ROOT = 1

# A level with at most this many inner nodes is applied as one CASE expression,
# a bigger one as a broadcast join on (level, node) per depth.
CASE_NODES = 256
# Query descent reads bounds from literal arrays up to this many slots per depth.
LITERAL_SLOTS = 1024
# The whole description must stay small enough to sit on the driver.
MAX_NODES = 500_000


# Distances to the pivots of the levels an object has passed, a list per level.
ALL_LEVELS = "array<array<double>>"
_PLACE = f"struct<level int, bucket int, pd {ALL_LEVELS}>"


def depth_of(node: int) -> int:
    return node.bit_length() - 1


@dataclass
class Level:
    pivots: list[Row] = field(default_factory=list)
    # inner node -> (in_upper, out_lower)
    nodes: dict[int, tuple[float, float]] = field(default_factory=dict)
    # leaves that a split cannot make smaller
    final: set[int] = field(default_factory=set)

    @property
    def depth(self) -> int:
        return 1 + max(map(depth_of, self.nodes)) if self.nodes else 0

    def leaves(self) -> list[int]:
        if not self.nodes:
            return [ROOT]
        children = (c for n in self.nodes for c in (2 * n, 2 * n + 1))
        return sorted(c for c in children if c not in self.nodes)


@dataclass
class Tree:
    metric: Metric
    rho: float
    levels: list[Level] = field(default_factory=lambda: [Level()])

    @property
    def max_pivots(self) -> int:
        return max(len(level.pivots) for level in self.levels)

    # -- placing objects -------------------------------------------------

    def assign(self, objects: DataFrame) -> DataFrame:
        """Add level, bucket and pd to every object: the first level that does
        not exclude it takes it. ``pd`` keeps its distances to the pivots of that
        level and of all levels before it.

        A few projections per level; the input is neither moved nor read twice,
        and a level's distances are computed only for objects still open."""
        side = columns(self.metric)
        names = objects.columns
        placed = self.metric.validated(objects).withColumn("_place", F.lit(None).cast(_PLACE))
        placed = placed.withColumn("_known", F.array().cast(ALL_LEVELS))
        for number, level in enumerate(self.levels):
            open_ = in_split_code(F.col("_place").isNull())
            placed = placed.withColumn("_pd", F.when(open_, distances_to(self.metric, level.pivots, side, checked=False)))
            placed = self.descend(placed, number)
            placed = placed.withColumn("_known", F.when(open_, F.array_append("_known", F.col("_pd"))))
            here = F.when(
                F.col("_node").isNotNull(),
                F.struct(F.lit(number).alias("level"), F.col("_node").alias("bucket"), F.col("_known").alias("pd")),
            )
            placed = placed.withColumn("_place", F.coalesce("_place", here)).drop("_pd", "_node")
        # Generated columns keep filters on level and bucket above this point;
        # pushed below, they would repeat the whole tree expression many times.
        return placed.select(*names, F.inline(F.array("_place")))

    def descend(self, df: DataFrame, level: int, pd: str = "_pd", node: str = "_node", compiled: bool = True) -> DataFrame:
        """Add ``node``: the leaf that takes a row with distances ``pd``, or null
        when a split on the way excludes it or ``pd`` is null.

        ``compiled=False`` leaves the decision tree to the interpreter: slower
        per row, but nothing to compile for a tree that is about to change."""
        tree = self.levels[level]
        if len(tree.nodes) <= CASE_NODES:
            # A decision tree as nested CASE, each node written once.
            path = F.expr(_decisions(tree.nodes, ROOT, pd))
            if not compiled:
                path = F.expr(f"get(transform(array({pd}), d -> {_decisions(tree.nodes, ROOT, 'd')}), 0)")
            return df.withColumn(node, F.when(in_split_code(F.col(pd).isNotNull()), path))
        df = df.withColumn(node, F.when(F.col(pd).isNotNull(), ROOT))
        for depth in range(tree.depth):
            df = self._with_bounds(df, depth, [level], node)
            dist, at = F.get(pd, F.lit(depth)), F.col(node)
            step = (
                F.when(F.col("_in").isNull(), at)
                .when(dist <= F.col("_in"), at * 2)
                .when(dist > F.col("_out"), at * 2 + 1)
            )
            df = df.withColumn(node, step).drop("_in", "_out")
        return df

    # -- finding buckets for queries -------------------------------------

    def touched(self, queries: DataFrame) -> DataFrame:
        """Buckets that a query ball reaches, before stopping rules.

        Adds to each query row: level, bucket, pd (the query's distances to that
        level's pivots), pds (to those of all levels), contains (the ball lies inside the bucket), own (the
        query object itself lies in it) and gap (how far outside it lies)."""
        side = columns(self.metric)
        by_level = F.array(*[distances_to(self.metric, lv.pivots, side, looped=True) for lv in self.levels])
        rows = queries.withColumn("_levels", by_level)
        rows = rows.select(*queries.columns, F.col("_levels").alias("pds"), F.posexplode("_levels").alias("level", "pd"))
        keep = rows.columns
        depths, levels = max(lv.depth for lv in self.levels), range(len(self.levels))
        literal = 0
        states = _START
        while literal < depths and (1 << literal) * len(levels) <= LITERAL_SLOTS:
            states = self._literal_step(states, literal)
            literal += 1
        rows = rows.select(*keep, F.explode(F.expr(states)).alias("_at"))
        for depth in range(literal, depths):
            rows = self._with_bounds(rows.withColumn("_node", F.col("_at.node")), depth, levels, "_node")
            step = _step("_at", "_in", "_out", f"get(pd, {depth})")
            rows = rows.select(*keep, F.explode(F.expr(step)).alias("_at"))
        return rows.select(*keep, F.expr("_at.node as bucket"), "_at.contains", "_at.own", "_at.gap")

    def _literal_step(self, states: str, depth: int) -> str:
        """One depth further for a list of states, bounds read from literals."""
        slots = 1 << depth
        inner, outer = [None] * (slots * len(self.levels)), [None] * (slots * len(self.levels))
        for number, level in enumerate(self.levels):
            for n, (low, high) in level.nodes.items():
                if depth_of(n) == depth:
                    inner[number * slots + n - slots], outer[number * slots + n - slots] = low, high
        slot = f"CASE WHEN s.node >= {slots} THEN level * {slots} + s.node - {slots} END"
        bounds = f"named_struct('i', get({_doubles(inner)}, {slot}), 'o', get({_doubles(outer)}, {slot}), 'd', get(pd, {depth}))"
        step = _step("s", "b.i", "b.o", "b.d")
        return f"flatten(transform({states}, s -> flatten(transform(array({bounds}), b -> {step}))))"

    def candidates(self, queries: DataFrame) -> DataFrame:
        """Buckets each query must read. Levels after one whose bucket contains
        the whole ball are left out; a level whose exclusion zone contains the
        ball has no touched bucket to begin with. A query that lacks a
        descriptor obeys no triangle inequality: it reads every bucket, and has
        no pivot distances to filter by."""
        whole = self.metric.complete(columns(self.metric))
        inside = F.when(F.col("contains"), F.col("level"))
        first = F.coalesce(F.min(inside).over(Window.partitionBy("qid")), F.lit(len(self.levels)))
        rows = self.touched(queries.where(whole)).withColumn("_first", first)
        rows = rows.where(F.col("level") <= F.col("_first")).drop("_first")
        return rows.unionByName(self._everywhere(queries.where(~whole)))

    def _everywhere(self, queries: DataFrame) -> DataFrame:
        """Every bucket for each query, in the shape of ``touched``."""
        found = [(number, n) for number, level in enumerate(self.levels) for n in level.leaves()]
        table = local_table(
            queries.sparkSession,
            {
                "_leaf": (range(len(found)), pa.int32()),
                "level": ([f[0] for f in found], pa.int32()),
                "bucket": ([f[1] for f in found], pa.int32()),
            },
        )
        rows = queries.withColumn("_leaf", F.explode(F.sequence(F.lit(0), F.lit(len(found) - 1))))
        rows = rows.join(F.broadcast(table), "_leaf").drop("_leaf")
        return rows.select(
            *queries.columns, F.lit(None).cast(ALL_LEVELS).alias("pds"), "level", F.lit(None).cast("array<double>").alias("pd"),
            "bucket", F.lit(False).alias("contains"), F.lit(True).alias("own"), F.lit(float("-inf")).alias("gap"),
        )

    # -- shared ----------------------------------------------------------

    def _with_bounds(self, df: DataFrame, depth: int, levels: Sequence[int], node: str) -> DataFrame:
        """Add ``_in`` and ``_out``: the bounds of inner nodes of one depth, null
        for rows that are not at one. A broadcast join with at most the level's
        nodes, whose number is bounded when the tree is built."""
        levels = list(levels)
        found = [
            (number, n, *bounds)
            for number in levels
            for n, bounds in self.levels[number].nodes.items()
            if depth_of(n) == depth
        ]
        table = local_table(
            df.sparkSession,
            {
                "_level": ([f[0] for f in found], pa.int32()),
                "_bound_node": ([f[1] for f in found], pa.int32()),
                "_in": ([f[2] for f in found], pa.float64()),
                "_out": ([f[3] for f in found], pa.float64()),
            },
        )
        match = F.col(node) == F.col("_bound_node")
        if len(levels) > 1:
            match = match & (F.col("level") == F.col("_level"))
        return df.join(F.broadcast(table), match, "left").drop("_level", "_bound_node")

    def node_rows(self) -> list[tuple]:
        """(level, node, depth, in_upper, out_lower, left, right, bucket, final)."""
        rows = []
        for number, level in enumerate(self.levels):
            for n, (low, high) in level.nodes.items():
                rows.append((number, n, depth_of(n), low, high, 2 * n, 2 * n + 1, None, False))
            for n in level.leaves():
                rows.append((number, n, depth_of(n), None, None, None, None, n, n in level.final))
        return rows

    def check_size(self) -> None:
        """Refuse a description that would not fit on the driver."""
        if 2 * sum(len(level.nodes) for level in self.levels) + len(self.levels) > MAX_NODES:
            raise ValueError(f"more than {MAX_NODES} tree nodes; raise the bucket capacity")

    def nodes_table(self, spark: SparkSession) -> DataFrame:
        rows = self.node_rows()
        kinds = {
            "level": pa.int32(), "node": pa.int32(), "depth": pa.int32(),
            "in_upper": pa.float64(), "out_lower": pa.float64(),
            "left": pa.int32(), "right": pa.int32(), "bucket": pa.int32(), "final": pa.bool_(),
        }
        return local_table(spark, {name: ([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})


def in_split_code(condition: Column) -> Column:
    """The same condition by way of an array function.

    A projection with one is compiled as many small methods instead of joining
    whole-stage code, where a few dozen distances make one method longer than
    the JVM's compiler accepts and run many times slower."""
    return F.exists(F.array(condition), lambda c: c)


def _decisions(nodes: dict[int, tuple[float, float]], node: int, pd: str) -> str:
    if node not in nodes:
        return str(node)
    inner, outer = nodes[node]
    dist = f"get({pd}, {depth_of(node)})"
    left, right = (_decisions(nodes, child, pd) for child in (2 * node, 2 * node + 1))
    return f"CASE WHEN {dist} <= {inner!r}D THEN {left} WHEN {dist} > {outer!r}D THEN {right} END"


def _doubles(values: Sequence[float | None]) -> str:
    """A literal array, folded into one constant by the optimizer."""
    items = ", ".join("cast(null as double)" if v is None else f"{v!r}D" for v in values)
    return f"array({items})"


# Where a query stands in a level: the node, whether the ball lies inside every
# split taken so far, whether the query object does, and how far outside it is.
_START = "array(named_struct('node', 1, 'contains', true, 'own', true, 'gap', double('-Infinity')))"


def _step(state: str, inner: str, outer: str, dist: str) -> str:
    """The children of a node that a ball reaches, or the node if it is a leaf."""
    reach = f"radius + {PRUNE_SLACK!r}D * (1D + abs({dist}) + radius)"

    def child(offset: int, contains: str, own: str, gap: str) -> str:
        return (
            f"named_struct('node', {state}.node * 2 + {offset}, 'contains', {state}.contains AND {contains}, "
            f"'own', {state}.own AND {own}, 'gap', greatest({state}.gap, {gap}))"
        )

    left = child(0, f"{dist} + {reach} <= {inner}", f"{dist} <= {inner}", f"{dist} - {inner}")
    right = child(1, f"{dist} - ({reach}) > {outer}", f"{dist} > {outer}", f"{outer} - {dist}")
    return (
        f"CASE WHEN {inner} IS NULL THEN array({state}) ELSE filter(array("
        f"CASE WHEN {dist} - ({reach}) <= {inner} THEN {left} END, "
        f"CASE WHEN {dist} + {reach} > {outer} THEN {right} END), c -> c IS NOT NULL) END"
    )
