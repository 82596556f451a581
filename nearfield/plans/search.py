"""Range queries through the index: choose buckets, read them, refine."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.distances import columns
from nearfield.operators.probes import pivot_gap_at_most, pivot_sum_at_most
from nearfield.operators.similarity import _with_knn_radius, crowd_answers, is_crowd, loosened, nearest
from nearfield.plans.index import NEAR, MetricIndex, near_columns
from nearfield.plans.tree import MAX_NODES, Tree, in_split_code
from nearfield.schema import ANSWER_TOLERANCE, PRUNE_SLACK
from nearfield.session import BROADCAST_ROWS, bounded_rows, lookup_join, stage
from nearfield.sources.buckets import bucket_filter

# Above this many distinct buckets a scan filter is not worth its length, and a
# table is narrowed by a join with the list instead.
PRUNED_BUCKETS = 10_000

# A pivot filter over more pivots than this loops instead of being written out.
UNROLLED_PIVOTS = 64

BUCKET_KEYS = ["level", "bucket"]

# Placed objects as a table, a function that gives the table of some buckets, or a stored
# index, which also skips buckets and pages by the distances to its first pivots.
Objects = DataFrame | Callable[[list[tuple[int, int]]], DataFrame] | MetricIndex

# Cells of an axis when pairs are counted by the distances to the first pivots.
MOST_BINS = 1024

# A pushed filter has at most so many intervals; closer ones are joined to fit.
PUSHED_INTERVALS = 64


def candidate_buckets(tree: Tree, queries: DataFrame) -> DataFrame:
    """(qid, level, bucket) to read for complete answers at any radius."""
    return tree.candidates(queries).select("qid", *BUCKET_KEYS)


def limited_radius(queries: DataFrame, rho: float) -> DataFrame:
    """Queries whose buckets are chosen with at most ``rho``; ``full`` keeps the
    radius the answers are held to."""
    return queries.withColumn("full", F.col("radius")).withColumn("radius", F.least("radius", F.lit(rho)))


def range_query_indexed(tree: Tree, objects: Objects, queries: DataFrame, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Complete answers (qid, id, dist)."""
    return _answers(tree, objects, queries, tree.candidates(queries), "radius", max_broadcast_rows).select("qid", "id", "dist")


def range_query_ids(tree: Tree, objects: Objects, queries: DataFrame, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Complete answers without distances: (qid, id). Pairs that the pivots
    already prove to be answers skip the exact distance."""
    return _sure_or_near(tree, objects, queries, tree.candidates(queries), max_broadcast_rows)


def _sure_or_near(tree: Tree, objects: Objects, queries: DataFrame, chosen: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """Answers (qid, id) in the chosen buckets; pairs that pivots prove are not measured,
    unless queries are so many that a grid leaves little else than answers."""
    if is_crowd(queries):
        return _answers(tree, objects, queries, chosen, "radius", max_broadcast_rows).select("qid", "id")
    probes = _probe_rows(tree, queries, chosen, "radius", objects)
    pairs = _filtered(tree, _read(tree, objects, probes, max_broadcast_rows))
    dist = tree.metric.distance(columns(tree.metric), columns(tree.metric, "q_"))
    sure = F.lit(False)
    for number, level in enumerate(tree.levels):
        pd, q_pd = F.get("pd", F.lit(number)), F.get("q_pd", F.lit(number))
        sure = sure | pivot_sum_at_most(pd, q_pd, F.col("radius"), len(level.pivots))
    return pairs.where(sure | (dist < F.col("radius") + ANSWER_TOLERANCE)).select("qid", "id")


def surviving_pairs(tree: Tree, objects: Objects, queries: DataFrame, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs (qid, id) of the buckets read that no known pivot distance excludes;
    only these need the exact distance."""
    read = _probe_rows(tree, queries, tree.candidates(queries), "radius", objects)
    return _filtered(tree, _read(tree, objects, read, max_broadcast_rows)).select("qid", "id")


def range_query_limited(tree: Tree, objects: Objects, queries: DataFrame, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """At most one bucket per level is read; answers up to rho are complete
    (``guaranteed``), farther ones are those that happened to be read."""
    limited = limited_radius(queries, tree.rho)
    found = _answers(tree, objects, limited, tree.candidates(limited), "full", max_broadcast_rows)
    return found.select("qid", "id", "dist", (F.col("dist") < tree.rho + ANSWER_TOLERANCE).alias("guaranteed"))


def approximate_plan(tree: Tree, queries: DataFrame) -> DataFrame:
    """Per query the buckets its own object falls in, one per level at most, and
    the certified radius: answers nearer than that are complete, because every
    bucket left out lies at least that far away. Null when nothing that the
    query reaches was left out."""
    reached = tree.candidates(queries)
    left_out = F.when(~F.col("own"), F.col("gap"))
    certified = reached.groupBy("qid").agg(
        F.min(left_out).alias("radius_certified"),
        F.collect_list(F.when(F.col("own"), F.struct("level", "bucket", "pds"))).alias("read"),
    )
    return certified


def range_query_approx(tree: Tree, objects: Objects, queries: DataFrame, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Answers from the query's own zone of every level: (qid, id, dist,
    guaranteed, radius_certified)."""
    plan = stage(approximate_plan(tree, queries), "approximate")
    own = plan.select("qid", F.explode("read").alias("r")).select("qid", "r.*")
    found = _answers(tree, objects, queries, own, "radius", max_broadcast_rows)
    found = lookup_join(found, plan.select("qid", "radius_certified"), ["qid"], "left")
    sure = F.col("radius_certified").isNull() | (F.col("dist") < F.col("radius_certified"))
    certified = F.coalesce("radius_certified", "radius")
    return found.select("qid", "id", "dist", sure.alias("guaranteed"), certified.alias("radius_certified"))


def pivot_included(objects: DataFrame, queries: DataFrame, pivots: int, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs (qid, id) that two known pivot distances prove to be answers,
    without computing the distance itself. Both inputs carry ``pd``.

    d(q, p) + d(o, p) <= r needs d(o, p) <= r - d(q, p), so per pivot a query
    wants objects in a prefix of the distance axis: joined on coarse bins of it,
    one pivot at a time, and a pair that several pivots prove is kept once."""
    found = None
    for i in range(pivots):
        near = F.get("pd", F.lit(i))
        reach = queries.select("qid", "radius", "pd").withColumn("_reach", F.col("radius") - near)
        reach = reach.where(F.col("_reach") >= 0)
        top = reach.agg(F.max("_reach")).first()[0]
        if top is None:
            continue
        width = max(top / 16, 1e-12)
        right = reach.select(
            "qid", "_reach", F.explode(F.sequence(F.lit(0), F.floor(F.col("_reach") / width).cast("int"))).alias("_bin")
        )
        left = objects.select("id", near.alias("_near")).where(F.col("_near") <= top)
        left = left.withColumn("_bin", F.floor(F.col("_near") / width).cast("int"))
        pairs = lookup_join(left, right, ["_bin"], right_split_on="qid", max_broadcast_rows=max_broadcast_rows)
        pairs = pairs.where(F.col("_near") <= F.col("_reach")).select("qid", "id")
        found = pairs if found is None else found.union(pairs)
    if found is None:
        return queries.select("qid", F.lit(None).cast("long").alias("id")).where(F.lit(False))
    return found.distinct() if pivots > 1 else found


def bucket_plan(index: MetricIndex, queries: DataFrame) -> DataFrame:
    """qid, level, bucket, n, inside: the buckets that hold answers of a query perhaps.
    ``inside`` says that all ``n`` objects of the bucket are answers: d(q, p) and the
    greatest distance to p that the bucket holds add up to no more than the radius."""
    reached = index.tree.candidates(queries).select("qid", "radius", *BUCKET_KEYS, "pds")
    boxes = F.broadcast(index.bucket_boxes())  # a row per bucket, bounded like the tree
    found = reached.join(boxes, BUCKET_KEYS).where(F.expr(f"{box_gap('pds')} <= radius + {_slack('radius')}"))
    return found.select("qid", *BUCKET_KEYS, "n", F.expr(inside_box("pds")).alias("inside"), "pds")


def answer_counts_indexed(index: MetricIndex, queries: DataFrame, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Number of answers per query (qid, n), zeros included. Buckets that lie inside a ball
    give their stored count and are not read; pairs that pivots prove are not measured."""
    plan = stage(bucket_plan(index, queries), "bucket-plan")
    known = plan.where("inside").groupBy("qid").agg(F.sum("n").alias("n"))
    rest = plan.where(~F.col("inside")).select("qid", *BUCKET_KEYS, "pds")
    found = _sure_or_near(index.tree, index, queries, rest, max_broadcast_rows)
    counted = found.groupBy("qid").agg(F.count("*").alias("n"))
    both = known.unionByName(counted).groupBy("qid").agg(F.sum("n").alias("n"))
    return queries.select("qid").join(both, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


def knn_indexed(index: MetricIndex, queries: DataFrame, k: int, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The ``k`` nearest stored objects of every query, exactly: (qid, id, dist, rank)."""
    return knn_rounds(index, queries, k, max_broadcast_rows)[0]


def knn_rounds(index: MetricIndex, queries: DataFrame, k: int, max_broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The nearest objects, and qid, buckets: how many buckets were read for a query.

    Best first, in rounds that all queries take together. A query first reads the bucket
    of every level that its own place is in; the k-th distance found there is its radius.
    Its other buckets within that radius are put in order of the least distance their
    split bounds and boxes allow, and read by rounds of 1, 2, 4, ... buckets. Each round
    shrinks the radius; a query is done when its next bucket cannot beat it.

    Very many queries would compare themselves with whole buckets: growing slices of the
    stored objects give them a radius instead, and then one round reads the buckets within it."""
    tree = index.tree
    queries = queries.select("qid", *tree.metric.columns)
    if is_crowd(queries):
        asked = stage(_with_knn_radius(index.objects(), queries, k, tree.metric, 0), "knn-queries")
        chosen = stage(_in_reach(index, tree.candidates(asked).select("qid", "radius", *BUCKET_KEYS, "pds")), "knn-buckets")
        best = nearest(_answers(tree, index, asked, chosen, "radius", max_broadcast_rows).drop("radius"), k)
        buckets = queries.select("qid").join(chosen.groupBy("qid").agg(F.count("*").alias("buckets")), "qid", "left")
        return best, buckets.select("qid", F.coalesce("buckets", F.lit(0)).alias("buckets"))
    everywhere = stage(queries.withColumn("radius", F.lit(float("inf"))), "knn-queries")
    boxes = F.broadcast(index.bucket_boxes())  # a row per bucket, bounded like the tree

    def reached(asked: DataFrame) -> DataFrame:
        found = tree.candidates(asked).select("qid", *BUCKET_KEYS, "pds", "own", "gap", "radius").join(boxes, BUCKET_KEYS)
        return found.withColumn("gap", F.greatest(F.col("gap") - F.expr(_slack("gap")), F.expr(box_gap("pds")))).drop("lo", "hi", "n")

    def answers(asked: DataFrame, chosen: DataFrame) -> DataFrame:
        probes = _probe_rows(tree, asked, chosen, "radius")
        return _refine(tree, _read(tree, index, probes, max_broadcast_rows)).select("qid", "id", "dist")

    def narrowed(best: DataFrame) -> DataFrame:
        """Queries with the k-th distance found so far."""
        kth = best.where(F.col("rank") == k).select("qid", loosened(F.col("dist")).alias("_kth"))
        return queries.join(kth, "qid", "left").select(*queries.columns, F.coalesce("_kth", F.lit(float("inf"))).alias("radius"))

    # a query that lacks a descriptor is at home in every bucket
    own = tree.candidates(queries.withColumn("radius", F.lit(0.0))).where("own")
    own = stage(own.select("qid", *BUCKET_KEYS, "pds"), "knn-own")
    best = stage(nearest(answers(everywhere, own), k), "knn-best")
    asked = stage(narrowed(best), "knn-queries")
    others = reached(asked).join(own.select("qid", *BUCKET_KEYS), ["qid", *BUCKET_KEYS], "left_anti").where("gap <= radius")
    order = Window.partitionBy("qid").orderBy("gap", *BUCKET_KEYS)
    others = stage(others.withColumn("turn", F.row_number().over(order)).drop("radius", "own"), "knn-buckets")
    read = own.groupBy("qid").agg(F.count("*").alias("buckets"))
    first, size = 1, 1
    while True:
        open_ = others.where(F.col("turn") >= first).join(asked.select("qid", "radius"), "qid").where("gap <= radius").drop("radius")
        now = stage(open_.where(F.col("turn") < first + size), "knn-turn")
        if now.isEmpty():
            # a query whose turns of this round lie beyond its radius is done: turns are in order
            break
        best = stage(nearest(best.drop("rank").unionByName(answers(asked, now)), k), "knn-best")
        asked = stage(narrowed(best), "knn-queries")
        read = read.unionByName(now.groupBy("qid").agg(F.count("*").alias("buckets")))
        first, size = first + size, 2 * size
    buckets = queries.select("qid").join(read.groupBy("qid").agg(F.sum("buckets").alias("buckets")), "qid", "left")
    return best, buckets.select("qid", F.coalesce("buckets", F.lit(0)).alias("buckets"))


def bucket_cost(tree: Tree, objects: Objects, queries: DataFrame, counts: DataFrame, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """What each query does in each bucket it reads: candidate objects there
    (from the stored counts, no scan) and those left for the exact distance
    after the pivot filter."""
    chosen = _probe_rows(tree, queries, tree.candidates(queries), "radius", objects)
    pairs = _surviving(tree, objects, chosen, max_broadcast_rows) if is_crowd(queries) else None
    if pairs is None:
        pairs = _filtered(tree, _read(tree, objects, chosen, max_broadcast_rows))
    after = pairs.groupBy("qid", *BUCKET_KEYS).agg(F.count("*").alias("after_filter"))
    zero = F.lit(0)
    # counts has one row per bucket, bounded like the tree itself
    return (
        chosen.select("qid", *BUCKET_KEYS)
        .join(F.broadcast(counts), BUCKET_KEYS, "left")
        .join(after, ["qid", *BUCKET_KEYS], "left")
        .select("qid", *BUCKET_KEYS, F.coalesce("n", zero).alias("candidates"), F.coalesce("after_filter", zero).alias("after_filter"))
    )


def query_cost(tree: Tree, objects: Objects, queries: DataFrame, counts: DataFrame, max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same per query, with the number of buckets read; queries that read
    none keep a row. Addressing adds one distance per pivot of the tree."""
    per_bucket = bucket_cost(tree, objects, queries, counts, max_broadcast_rows)
    totals = per_bucket.groupBy("qid").agg(
        F.count("*").alias("buckets"), F.sum("candidates").alias("candidates"), F.sum("after_filter").alias("after_filter")
    )
    zero = F.lit(0)
    return (
        queries.select("qid")
        .join(totals, "qid", "left")
        .select("qid", *[F.coalesce(c, zero).alias(c) for c in ("buckets", "candidates", "after_filter")])
    )


def _answers(tree: Tree, objects: Objects, queries: DataFrame, chosen: DataFrame, radius: str, max_broadcast_rows: int) -> DataFrame:
    """Answers (qid, id, dist, radius) among the objects of the chosen (qid, level, bucket)."""
    if not is_crowd(queries):
        probes = _probe_rows(tree, queries, chosen, radius, objects)
        return _refine(tree, _read(tree, objects, probes, max_broadcast_rows)).select("qid", "id", "dist", "radius")
    # Buckets grow with the table, so very many queries meet the objects of the buckets they
    # reach in the cells of a grid; an answer counts once for each time its bucket was chosen.
    place = chosen.select("qid", *BUCKET_KEYS, "pds")
    if isinstance(objects, MetricIndex):
        place = _in_reach(objects, queries.select("qid", F.col(radius).alias("radius")).distinct().join(place, "qid"))
    code = (F.shiftleft(F.col("level").cast("long"), 32) + F.col("bucket")).alias("_bucket")
    place = stage(place.select("qid", *BUCKET_KEYS, code), "probes")
    reached = bounded_rows(place.select(*BUCKET_KEYS).distinct(), MAX_NODES, "buckets")
    # at most as many a query as the tree has leaves
    buckets = place.groupBy("qid").agg(F.collect_list("_bucket").alias("_buckets"))
    asked = queries.select("qid", F.col(radius).alias("radius"), *tree.metric.columns).join(buckets, "qid")
    asked = stage(asked, "probes")
    held = _bucket_rows(objects, [(r["level"], r["bucket"]) for r in reached], place)
    held = held.select("id", *tree.metric.columns, code)
    found = crowd_answers(held, asked, tree.metric, max_broadcast_rows=max_broadcast_rows)
    found = found.where(F.array_contains("_buckets", F.col("_bucket")))
    once = F.explode(F.filter("_buckets", lambda b: b == F.col("_bucket"))).alias("_once")
    return found.select("qid", "id", "dist", "radius", once).drop("_once")


def _in_reach(index: MetricIndex, rows: DataFrame) -> DataFrame:
    """Chosen buckets (qid, radius, level, bucket, pds) without those whose boxes lie out of reach."""
    # the boxes are as many as the buckets, which are bounded; what is not stored has none
    boxed = rows.join(F.broadcast(index.bucket_boxes().drop("n")), BUCKET_KEYS)
    return boxed.where(F.expr(f"{box_gap('pds')} <= radius + {_slack('radius')}")).drop("lo", "hi")


def _surviving(tree: Tree, objects: Objects, probes: DataFrame, max_broadcast_rows: int) -> DataFrame | None:
    """The pairs that ``_filtered`` leaves of the probes' buckets, by cells of the distances
    to the first pivots; None if these are not all the pivots there are or some query does
    not know its own."""
    pivots = [len(level.pivots) for level in tree.levels]
    if not 1 <= pivots[0] <= len(NEAR) or sum(pivots) > pivots[0] or isinstance(objects, MetricIndex) or callable(objects):
        return None
    names = NEAR[: pivots[0]]
    ends = [end(f"q_{n}").alias(f"{end.__name__}_{n}") for n in names for end in (F.min, F.max)]
    lacking = F.count_if(F.greatest(*[F.col(f"q_{n}").isNull() for n in names])).alias("lacking")
    seen = probes.agg(lacking, F.percentile_approx("radius", 0.5).alias("r"), *ends).first()
    if seen["lacking"] or not seen["r"] or not math.isfinite(seen["r"]):
        return None
    reached = bounded_rows(probes.select(*BUCKET_KEYS).distinct(), MAX_NODES, "buckets")
    rows = _bucket_rows(objects, [(r["level"], r["bucket"]) for r in reached], probes)
    rows = rows.withColumns(near_columns(F.col("pd"))).select("id", *BUCKET_KEYS, *names)
    # a cell is about a radius wide; ``MOST_BINS`` an axis, the border cells hold what lies outside
    asked = probes.select("qid", "radius", *BUCKET_KEYS, *[f"q_{n}" for n in names])
    cells = []
    for n in names:
        low = seen[f"min_{n}"]
        width = max(seen["r"], (seen[f"max_{n}"] - low) / MOST_BINS) or 1.0

        def cell(value: str, low=low, width=width) -> str:
            return f"cast(greatest(least(floor(({value} - {low!r}D) / {width!r}D), {MOST_BINS}), -1) as int)"

        rows = rows.withColumn(f"_{n}", F.expr(cell(n)))
        asked = asked.withColumn(f"_{n}", F.explode(F.expr(f"sequence({cell(f'q_{n} - {_reach(n)}')}, {cell(f'q_{n} + {_reach(n)}')})")))
        cells.append(f"_{n}")
    pairs = lookup_join(rows, asked, [*BUCKET_KEYS, *cells], right_split_on="qid", max_broadcast_rows=max_broadcast_rows)
    return pairs.where(F.expr(" AND ".join(f"abs({n} - q_{n}) <= {_reach(n)}" for n in names)))


def _bucket_rows(objects: Objects, wanted: list[tuple[int, int]], probes: DataFrame) -> DataFrame:
    """The objects of some buckets, the (level, bucket) that ``probes`` hold."""
    if isinstance(objects, MetricIndex):
        return objects.bucket_objects(wanted)
    if callable(objects):
        return objects(wanted)
    if len(wanted) <= PRUNED_BUCKETS:
        return objects.where(bucket_filter(wanted))
    # at most as many rows as the tree has leaves
    return objects.join(F.broadcast(probes.select(*BUCKET_KEYS).distinct()), BUCKET_KEYS, "left_semi")


def _probe_rows(tree: Tree, queries: DataFrame, chosen: DataFrame, radius: str, objects: Objects | None = None) -> DataFrame:
    """The query side of the bucket join: one row per (query, bucket). With an index,
    buckets that its boxes prove out of reach are left out."""
    renamed = [F.col(c).alias("q_" + c) for c in tree.metric.columns]
    side = queries.select("qid", F.col(radius).alias("radius"), *renamed)
    place = chosen.select("qid", *BUCKET_KEYS, F.col("pds").alias("q_pd"))
    rows = side.join(place, "qid")
    if isinstance(objects, MetricIndex):
        # the boxes are as many as the buckets, which are bounded; what is not stored has none
        rows = rows.join(F.broadcast(objects.bucket_boxes().drop("n")), BUCKET_KEYS)
        rows = rows.where(F.expr(f"{box_gap('q_pd')} <= radius + {_slack('radius')}")).drop("lo", "hi")
    rows = rows.withColumns({f"q_{name}": value for name, value in near_columns(F.col("q_pd")).items()})
    return stage(rows, "probes")


def _slack(value: str) -> str:
    return f"{PRUNE_SLACK!r}D * (1D + abs({value}))"


def box_gap(pds: str) -> str:
    """SQL of how far a query lies outside a bucket's box at least, over all pivots of the
    first level; what is not known bounds nothing. Float error is taken off."""
    gap = f"coalesce(greatest(d - element_at(hi, i + 1), element_at(lo, i + 1) - d) - {_slack('d')}, 0D)"
    return f"coalesce(array_max(transform(slice(get({pds}, 0), 1, size(lo)), (d, i) -> {gap})), 0D)"


def inside_box(pds: str) -> str:
    """SQL of whether some pivot proves that a bucket lies inside the query's ball."""
    return f"coalesce(exists(transform(slice(get({pds}, 0), 1, size(hi)), (d, i) -> d + element_at(hi, i + 1) <= radius), x -> x), false)"


def _reach(axis: str) -> str:
    """How far an answer's distance to a first pivot may lie from the query's own."""
    return f"(radius + {PRUNE_SLACK!r}D * (1D + radius + abs(q_{axis})))"


def _intervals(rows: list, low: str, high: str) -> list[tuple[float, float]] | None:
    """The union of the rows' intervals as a bounded list, or None if one is not known."""
    if any(r[low] is None or r[high] is None for r in rows):
        return None
    joined: list[tuple[float, float]] = []
    for a, z in sorted((r[low], r[high]) for r in rows):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(joined[-1][1], z))
        else:
            joined.append((a, z))
    while len(joined) > PUSHED_INTERVALS:
        k = min(range(len(joined) - 1), key=lambda i: joined[i + 1][0] - joined[i][1])
        joined[k : k + 2] = [(joined[k][0], joined[k + 1][1])]
    return joined


def _near_filter(rows: list):
    """A filter on ``NEAR`` that every answer passes, from the reached buckets."""
    keep = F.lit(True)
    for i, name in enumerate(NEAR):
        spans = _intervals(rows, f"lo{i}", f"hi{i}")
        if spans and all(map(math.isfinite, (spans[0][0], spans[-1][1]))):
            some = F.lit(False)
            for a, z in spans:
                some = some | F.col(name).between(a, z)
            keep = keep & some
    return keep


def _read(tree: Tree, objects: Objects, probes: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """Objects of the chosen buckets next to the queries that chose them, without pairs
    that the first pivots exclude: flat columns, tested as part of the join."""
    ends = []
    for i, name in enumerate(NEAR):
        q, reach = f"q_{name}", _reach(name)
        # a query that knows no distance may have answers at any
        low, high = (F.when(F.count(q) == F.count("*"), F.expr(end)) for end in (f"min({q} - {reach})", f"max({q} + {reach})"))
        ends += [low.alias(f"lo{i}"), high.alias(f"hi{i}")]
    reached = bounded_rows(probes.groupBy(*BUCKET_KEYS).agg(*ends), MAX_NODES, "buckets")
    wanted = [(r["level"], r["bucket"]) for r in reached]
    if isinstance(objects, MetricIndex):
        objects = objects.bucket_objects(wanted, _near_filter(reached) if objects.tree.levels[0].pivots else None)
    else:
        objects = _bucket_rows(objects, wanted, probes)
    flat = set(NEAR) <= set(objects.columns)
    pairs = lookup_join(objects, probes, BUCKET_KEYS, right_split_on="qid", max_broadcast_rows=max_broadcast_rows)
    if flat:
        pairs = pairs.where(F.expr(" AND ".join(f"coalesce(abs({n} - q_{n}) <= {_reach(n)}, true)" for n in NEAR)))
        # Later filters must not become part of the join, where their long code would run
        # for every pair of a bucket; they do not pass a column that depends on the row.
        pairs = pairs.withColumn("_pair", F.monotonically_increasing_id()).where(F.col("_pair") >= 0)
    return pairs


def _filtered(tree: Tree, pairs: DataFrame) -> DataFrame:
    """Pairs that no pivot of any level both sides know proves too far apart."""
    if sum(len(level.pivots) for level in tree.levels) > UNROLLED_PIVOTS:
        slack = f"radius + {PRUNE_SLACK!r}D * (1D + radius + abs(y))"
        level = f"forall(zip_with(a, b, (x, y) -> coalesce(abs(x - y) <= {slack}, true)), ok -> ok)"
        return pairs.where(F.expr(f"coalesce(forall(zip_with(pd, q_pd, (a, b) -> coalesce({level}, true)), ok -> ok), true)"))
    keep = F.lit(True)
    for number, level in enumerate(tree.levels):
        pd, q_pd = F.get("pd", F.lit(number)), F.get("q_pd", F.lit(number))
        keep = keep & pivot_gap_at_most(pd, q_pd, F.col("radius"), len(level.pivots))
    # kept out of the join's code, which stays small enough to be compiled
    return pairs.where(in_split_code(keep))


def _refine(tree: Tree, pairs: DataFrame) -> DataFrame:
    """Cheap pivot filter first, exact distance for what is left."""
    dist = tree.metric.distance(columns(tree.metric), columns(tree.metric, "q_"))
    return _filtered(tree, pairs).withColumn("dist", dist).where(F.col("dist") < F.col("radius") + ANSWER_TOLERANCE)

