"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with equal shingle sets are one node. A node's shingles get a global order:
frequent ones last, the rest by hash. If two sets are similar enough, their prefixes of
``size - least overlap + l`` shingles share at least ``l``. Every node chooses its ``l``
from the lengths of the posting lists its prefix meets: a longer prefix reads a few more
postings, and the pairs to verify fall with the number of shared shingles they must have.

Large groups of near copies would put all their pairs into every list. So each list first
offers only pairs with one leader; verified ones are merged into components, and after
that a list offers only pairs whose ends lie in different components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.graph import components
from nearfield.llm.words import MIX, MIX_2, MIX_3, WordHashes, finish, free_names, map_texts
from nearfield.session import Stages, fits_broadcast, stage

#: Longest lengthening of a prefix.
MOST_MATCHES = 5
#: Cost of verifying a pair against reading one posting.
VERIFY_COST = 20.0
#: Shingle hashes below this share of the hash range are all counted: prefixes of sets by
#: hash lie there, apart from very small sets. Of the others, those are counted that a batch
#: of documents holds ``OFTEN`` times. Which shingles count as frequent only decides the
#: order, and so the speed; any fixed choice gives the same links.
BAND = 0.15
OFTEN = 3
#: Shingles looked at together for that.
HELD = 1_000_000
#: At most this many frequent shingles are ordered last; their least count follows from it.
FREQUENT = 1 << 17
FREQUENT_FROM = 8
#: Buckets of a set's sketch: how many of its shingles fall into each.
SKETCH = 128
#: Pairs of one node that one task verifies.
VERIFY_ROWS = 2_000
LEADER_ROUNDS = 2
#: Lists with more members than this get leaders.
LONG = 16


def shingle_set(text: bytes, width: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word ``width``-grams of a text, A-Z lower-cased; the
    whole word sequence where there are fewer words; empty without words."""
    h = memo.of(text.lower().split())
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    size = min(width, len(h))
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * MIX_3 + h[j : j + n]
    total += np.uint64((size * int(MIX)) % 2**64)
    return np.unique(finish(total))


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set: equal sets have equal names (different ones share a
    name with a chance of 2**-64 a pair)."""
    with np.errstate(over="ignore"):
        mixed = finish(shingles * MIX_2 + np.uint64(len(shingles)))
        return int(finish(np.array([mixed.sum(dtype=np.uint64) + np.uint64(len(shingles))]))[0].astype(np.int64))


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares with any set similar enough to it."""
    return -(-n * percent // 100)


def prefix_length(n: Column, matches: Column | int, percent: int) -> Column:
    return n - F.ceil(n * percent / 100).cast("int") + matches


def sets(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, th (hash of the text), n, node and the hashes in the counted band; the last
    row of a batch also has the hashes outside it that the batch holds often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        limit = np.uint64(int(BAND * 2**64))
        for batch in batches:
            counts, nodes, bands, ends, outside, often, times = [], [], [], [0], [], [], []

            def count_often(outside: list[np.ndarray], often: list, times: list) -> None:
                token, n = np.unique(np.concatenate(outside), return_counts=True)
                often.append(token[n >= OFTEN].view(np.int64))
                times.append(n[n >= OFTEN])

            held = 0
            for value in batch.column("text"):
                s = shingle_set(value.as_buffer().to_pybytes() if value.is_valid else b"", width, memo)
                band = s[: np.searchsorted(s, limit)]
                counts.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                bands.append(band.view(np.int64).copy())  # a view would keep the whole set
                ends.append(ends[-1] + len(band))
                outside.append(s[len(band) :])
                held += len(outside[-1])
                if held >= HELD:
                    count_often(outside, often, times)
                    outside, held = [], 0
            if not counts:
                continue
            if outside:
                count_often(outside, often, times)
            before = [None] * (len(counts) - 1)
            listed = lambda x: pa.array([*before, np.concatenate(x).astype(np.int64)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("th"), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands))),
                    listed(often), listed(times),
                ],
                names=["doc_id", "th", "n", "node", "band", "often", "times"],
            )

    return map_texts(keyed(documents), run, "doc_id long, th long, n long, node long, band array<long>, often array<long>, times array<long>")


def keyed(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def frequent(found: DataFrame, write: Callable[[DataFrame, str], DataFrame] = stage) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent counted shingles, at most ``FREQUENT``, with their counts.

    Counts cover all documents; the least count is the smallest at which the list stays
    within its bound, read from how many shingles have which count."""
    inside = found.select(F.explode("band").alias("token"), F.lit(1).cast("long").alias("k"))
    outside = found.where(F.col("often").isNotNull()).select(F.explode(F.arrays_zip("often", "times")).alias("e")).select("e.often", "e.times")
    counts = inside.union(outside).groupBy("token").agg(F.sum("k").alias("df"))
    counts = write(counts.where(F.col("df") >= FREQUENT_FROM), "frequent")
    by_count = counts.groupBy(F.ceil(F.log2("df") * 8).cast("int").alias("step")).agg(F.count("*").alias("n"), F.min("df").alias("df"))
    least, held = None, 0
    for row in sorted(by_count.collect(), key=lambda r: -r["step"]):  # at most 8 * 64 rows
        held += row["n"]
        if held > FREQUENT:
            break
        least = row["df"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where(F.col("df") >= least).toPandas()
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], rows["df"].to_numpy(np.int64)[order]


def prefixes(documents: DataFrame, width: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """node, n, the longest prefix and the sketch of each node."""
    tokens, counts = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            nodes, sizes, parts, ends, sketches = [], [], [], [0], []
            seen = set()
            for value in batch.column("text"):
                s = shingle_set(value.as_buffer().to_pybytes() if value.is_valid else b"", width, memo)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                sketches.append(np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.int32))
                length = min(len(s), len(s) - least_overlap(len(s), percent) + MOST_MATCHES)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    df = np.where(tokens[at] == s, counts[at], 0)
                    if df.any():
                        s = s[np.argsort(df, kind="stable")]
                nodes.append(node)
                sizes.append(len(s))
                parts.append(s[:length].view(np.int64).copy())
                ends.append(ends[-1] + length)
            flat = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * SKETCH, pa.int32()), pa.array(np.concatenate(sketches or [np.zeros(0, np.int32)]))),
                ],
                names=["node", "n", "tokens", "sketch"],
            )

    rows = map_texts(keyed(documents), run, "node long, n long, tokens array<long>, sketch array<int>")
    return rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "tokens", "sketch")))


def postings(prefix: DataFrame, percent: int, inner: Stages) -> DataFrame:
    """token, node, n, pos, matches, sketch: the prefix of each node at the ``l`` it chose,
    shared shingles only; the sketch only in long lists.

    The prefix for ``l`` meets some postings of other nodes, and about as many nodes share
    ``l`` of its shingles as its ``l``-th longest list has others (exactly, where lists lie
    within one another); ``l`` makes postings plus pairs to verify cheapest. It is never more
    than the node shares with any similar one, so no pair has to share more than it must."""
    each = prefix.select("node", "n", F.posexplode("tokens").alias("pos", "token"))
    shared = each.groupBy("token").agg(F.count("*").alias("listed")).where(F.col("listed") > 1)
    met = inner(each.join(shared, "token"), "postings")
    costs = []
    for matches in range(1, MOST_MATCHES + 1):
        read = F.sum(F.when(F.col("pos") < prefix_length(F.col("n"), matches, percent), F.col("listed") - 1).otherwise(0))
        costs.append(read.alias(f"read{matches}"))
    chosen = met.groupBy("node").agg(F.first("n").alias("n"), *costs, F.sort_array(F.collect_list(F.col("listed") - 1), asc=False).alias("others"))
    pairs = lambda m: VERIFY_COST * F.coalesce(F.get("others", F.lit(m - 1)), F.lit(0))
    allowed = lambda m: F.ceil(F.col("n") * percent / 100) >= m
    chosen = chosen.select("node", *(F.when(allowed(m), F.col(f"read{m}") + pairs(m)).alias(f"c{m}") for m in range(1, MOST_MATCHES + 1)))
    best = F.array_position(F.array(*(F.col(f"c{m}") for m in range(1, MOST_MATCHES + 1))), F.least(*(F.col(f"c{m}") for m in range(1, MOST_MATCHES + 1))))
    chosen = chosen.select("node", best.cast("int").alias("matches"))
    kept = met.join(chosen, "node").where(F.col("pos") < prefix_length(F.col("n"), F.col("matches"), percent))
    kept = kept.select("token", "node", "n", "pos", "matches", "listed")
    sketches = kept.where(F.col("listed") > LONG).join(prefix.select("node", "sketch"), "node").drop("listed")
    return sketches.unionByName(kept.where(F.col("listed") <= LONG).drop("listed").withColumn("sketch", F.lit(None).cast("array<int>")))


def possible(x: str, y: str, percent: int, matches: Column | None = None) -> Column:
    """A shared shingle that counts for a pair. For these two sizes the sets must share
    ``a`` shingles, so the first ``size - a + l`` of each share ``l`` at least; a shingle
    behind them is none of these."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    overlap = F.ceil((n + m) * percent / (100 + percent))
    matches = F.least(f"{x}.matches", f"{y}.matches") if matches is None else matches
    fits = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    return fits & (F.col(f"{x}.pos") < n - overlap + matches) & (F.col(f"{y}.pos") < m - overlap + matches)


def overlapping(x: str, y: str, percent: int) -> Column:
    """Whether the sketches leave room for the shingles that a pair must share: in each
    bucket two sets share no more than the smaller of their counts."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = F.aggregate(F.zip_with(f"{x}.sketch", f"{y}.sketch", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, v: s + v)
    return F.coalesce(n + m - apart >= 2 * F.ceil((n + m) * percent / (100 + percent)), F.lit(True))


def enough(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that share as many shingles as both prefixes call for. Input: one row
    per pair and shared shingle, with ``wanted``, the smaller ``l`` of the two."""
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("wanted").alias("wanted"))
    return counted.where(F.col("shared") >= F.col("wanted")).select("a", "b")


def leader_pairs(lists: DataFrame, number: int, percent: int) -> DataFrame:
    """The members of each long list paired with one of them, its leader, where they may
    be similar and are not connected yet. Lists get different leaders, so a group of near
    copies is connected through many of its members."""
    member = F.struct("node", "n", "pos", "root")
    leader = lists.groupBy("token").agg(F.min_by(member, F.xxhash64("token", "node", F.lit(number))).alias("top"), F.count("*").alias("c"))
    leader = leader.where(F.col("c") > LONG).select("token", "top.*").alias("x")
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & possible("x", "y", percent, F.lit(1))
    return lists.alias("y").join(leader, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def mixed(lists: DataFrame) -> DataFrame:
    """The lists that hold more than one component, each with its largest component."""
    per = lists.groupBy("token", "root").agg(F.count("*").alias("members"))
    top = per.groupBy("token").agg(F.max(F.struct("members", "root")).alias("top"), F.count("*").alias("roots"))
    return lists.join(top.where(F.col("roots") > 1).select("token", F.col("top.root").alias("main")), "token")


def cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list whose ends lie in different components. A pair has at least one
    end outside the list's largest component, so only those ends look for partners."""
    others = lists.where(F.col("root") != F.col("main")).alias("x")
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & once & possible("x", "y", percent) & overlapping("x", "y", percent)
    rows = others.join(lists.alias("y"), meet)
    return enough(rows.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.least("x.matches", "y.matches").alias("wanted")))


def verified(pairs: DataFrame, documents: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar: their whole texts are fetched and compared.

    The rows of one node come to a task behind the node's own text; a node with many
    partners is spread over tasks."""
    with Stages(documents.sparkSession) as inner:
        return stage(_compared(inner(pairs, "pairs"), documents, classes, width, percent, inner), "links")


def _compared(pairs: DataFrame, documents: DataFrame, classes: DataFrame, width: int, percent: int, inner: Stages) -> DataFrame:
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = classes.join(ends, "node").select("node", F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    small = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    source = keyed(documents)
    texts = source.join(small, source["doc_id"].eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("node", "text")
    texts = inner(texts.dropDuplicates(["node"]), "texts")  # repeated rows hold the same text
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / VERIFY_ROWS).cast("int").alias("parts"))
    first = parts.join(texts, parts["a"] == texts["node"]).select("a", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    second = pairs.join(parts, "a").join(texts, F.col("b") == F.col("node"))
    second = second.select("a", (F.pmod(F.xxhash64("b"), F.col("parts")) + 1).cast("int").alias("part"), "b", "text")
    rows = first.unionByName(second).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        at, left = None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, b, value in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text")):
                s = shingle_set(value.as_buffer().to_pybytes() if value.is_valid else b"", width, memo)
                if b is None:
                    at, left = a, s
                elif at == a:
                    common = len(np.intersect1d(left, s, assume_unique=True))
                    if 100 * common >= percent * (len(left) + len(s) - common):
                        out_a.append(a)
                        out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def rooted(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Lists with the component of each node so far."""
    roots = components(links)
    return lists.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def links_of(documents: DataFrame, common: tuple[np.ndarray, np.ndarray], classes: DataFrame, width: int, percent: int) -> DataFrame:
    spark = documents.sparkSession
    with Stages(spark) as old, Stages(spark) as new:
        prefix = old(prefixes(documents, width, percent, common), "prefixes")
        lists = new(postings(prefix, percent, old), "lists").withColumn("root", F.col("node"))
        links = None
        for number in range(LEADER_ROUNDS):
            old.clear()
            old, new = new, old  # the lists with the components so far, and those that follow
            found = verified(leader_pairs(lists, number, percent), documents, classes, width, percent)
            links = found if links is None else links.unionByName(found)
            lists = new(rooted(lists, links), "lists")
        old.clear()
        return links.unionByName(verified(cross_pairs(mixed(lists), percent), documents, classes, width, percent))


def similarity_classes(documents: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, th, n_shingles, node, component_id of every document row.

    Two documents link when ``100 * |intersection| >= percent * |union|`` of their shingle
    sets; ``component_id`` is the smallest doc_id reachable by links. A text that is null,
    empty or blank has no shingles and links with nothing: its own id is its component.
    Repeated rows are repeated; a null id takes the smallest id of its component, or stays
    null alone. ``th`` is a hash of the text that tells rows of one id apart."""
    with Stages(documents.sparkSession) as inner:
        found = inner(sets(documents, width), "sets")
        rows = stage(found.drop("band", "often", "times"), "set-sizes")
        common = frequent(found, inner)
    classes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("r"))
    classes = stage(classes.select("node", F.col("r.doc_id").alias("doc_id"), F.col("r.th").alias("th")), "classes")
    roots = stage(components(links_of(documents, common, classes, width, percent)), "roots")
    named = classes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = stage(named.join(smallest, "root").select(F.col("node").alias("_node"), "component_id"), "labels")
    rows = rows.join(labels, F.col("node") == F.col("_node"), "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "th", F.col("n").alias("n_shingles"), "node", own.alias("component_id"))


def one_of_each(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without the later ones of each group of similar documents: the row
    with the smallest id stays, with its columns as they are.

    Null, empty and blank texts belong to no group and all stay; rows without id come behind
    the others of their group; of equal rows (id and text) one stays; texts may have any
    length, an empty table stays empty."""
    own, text_hash, stays = free_names(documents.columns, "_id", "_th", "_stays")
    labelled = stage(similarity_classes(documents, width, percent).where(F.col("node").isNotNull()), "labelled")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    # A component without any id falls back on its nodes.
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("node")).alias("alone")]
    rows = labelled.groupBy(*group, "doc_id", "th").agg(F.count("*").alias("copies"))
    first = rows.groupBy("component_id", "alone").agg(F.min(key).alias("first"))
    rows = rows.join(first, rows["component_id"].eqNullSafe(first["component_id"]) & rows["alone"].eqNullSafe(first["alone"])).select(key.alias("k"), "copies", "first")
    gone = stage(rows.where((F.col("k") != F.col("first")) | (F.col("copies") > 1)).select(F.col("k.doc_id").alias(own), F.col("k.th").alias(text_hash), (F.col("k") == F.col("first")).alias(stays)), "gone")
    small = F.broadcast(gone) if fits_broadcast(gone) else gone
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text_hash))
    names = documents.columns
    single = documents.join(small, same, "left_anti")
    # Equal rows that stay: one of them.
    repeated = documents.join(small.where(F.col(stays)), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated).select(*(F.col(f"`{name}`") for name in names))


def op10_adaptive_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id")
