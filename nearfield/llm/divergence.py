"""Audit of how far sources diverge in their words, by run-length columns.

Every (lang, source) group is a column of counts over the lang's vocabulary, zeros included.
Terms are ordered so that equal counts lie together: terms with the same counts in all
groups become one entry with a length, and entries are sorted by the group whose counts
take the fewest values, then the next, so that columns consist of long runs. The ordered
vocabulary is cut into blocks; in a block each column is run-length encoded, the run ends
of two columns are intersected, and a pair's contribution is f times the length, added over
the pieces. All values are whole numbers: probabilities are scaled by 10 ** 9."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.session import fits_broadcast, stage

SCALE = 1_000_000_000
MIN_DOCUMENTS = 3
TOP_TERMS = 200

#: Counted (lang, source, term) triples that a task holds before it sends them.
HELD_TERMS = 200_000
#: Counts in a block of the ordered vocabulary.
BLOCK_COUNTS = 400_000

#: Bytes of a term: letters, lower-cased, and all of other than ASCII; the rest cuts.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), d (documents): summed by task, not in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurring: dict[tuple, Counter] = {}
        documents_: dict[tuple, Counter] = {}
        held = 0

        def summed() -> pa.RecordBatch:
            lang, source, term, c, d = [], [], [], [], []
            for group, counts in occurring.items():
                lang += [group[0]] * len(counts)
                source += [group[1]] * len(counts)
                term += counts.keys()
                c += counts.values()
                d += map(documents_[group].__getitem__, counts)
            columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(c, pa.int64()), pa.array(d, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "c", "d"])

        for batch in batches:
            for group, value in zip(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()), batch.column("text")):
                counts = Counter(value.as_buffer().to_pybytes().translate(_LETTERS).split())
                if group not in occurring:
                    occurring[group], documents_[group] = Counter(), Counter()
                mine = occurring[group]
                held -= len(mine)
                mine.update(counts)
                documents_[group].update(counts.keys())
                held += len(mine)
                if held >= HELD_TERMS:
                    yield summed()
                    occurring, documents_, held = {}, {}, 0
        if occurring:
            yield summed()

    return _read(documents).mapInArrow(run, "lang string, source string, term binary, c long, d long")


def _read(documents: DataFrame) -> DataFrame:
    return documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_counts(documents: DataFrame) -> DataFrame:
    """lang, term, c, by (structs of source and c): the terms in enough documents of their
    lang, with their counts in all and by source (sources without the term left out)."""
    per_group = term_counts(documents).groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    per_term = per_group.groupBy("lang", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"), F.collect_list(F.struct("source", "c")).alias("by"))
    return per_term.where(F.col("d") >= MIN_DOCUMENTS).select("lang", F.col("term").cast("string").alias("term"), "c", "by")


def share(count, total, size) -> str:
    """SQL of p for a count, of ``total`` occurrences over ``size`` terms; exact at any size."""
    return f"1 + ({SCALE}BD * (cast({count} as decimal(20, 0)) + 1)) div (cast({total} as decimal(20, 0)) + {size})"


def distance(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def groups_of(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n (occurrences of kept terms), v (kept terms of the lang), l (its
    occurrences) and no: the group's place in its lang, groups with few different counts first."""
    occurring = _read(documents).select("lang", "source").distinct()
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("c").alias("l"))
    values = kept.select("lang", F.explode("by").alias("b")).groupBy("lang", "b.source", "b.c").agg(F.count("*").alias("terms"))
    sums = values.groupBy("lang", "source").agg(F.sum(F.col("c") * F.col("terms")).alias("n"), F.count("*").alias("different"))
    rows = occurring.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "different", "v", "l"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("different", "source"))
    return rows.select("lang", "source", "n", "v", "l", place.alias("no"))


def _known(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if fits_broadcast(groups) else groups


def ordered_blocks(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, block, at, counts (structs of no and c), length: the vocabulary in order, cut
    into blocks; terms with the same counts everywhere are one entry."""
    flat = kept.select("lang", "term", F.explode("by").alias("b")).select("lang", "term", "b.source", "b.c")
    flat = flat.join(_known(groups.select("lang", "source", "no")), ["lang", "source"])
    column = flat.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("no", "c"))).alias("counts"))
    entries = stage(column.groupBy("lang", "counts").agg(F.count("*").alias("length")), "entries")
    size = entries.agg(F.count("*").alias("rows"), F.max(F.size("counts")).alias("widest")).first()
    blocks = 1 + (size["rows"] or 0) * (size["widest"] or 0) // BLOCK_COUNTS
    dealt = entries.repartitionByRange(blocks, "lang", "counts").sortWithinPartitions("lang", "counts")
    return stage(dealt.select("lang", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("at"), "counts", "length"), "blocks")


def encoded(sizes: np.ndarray, no: np.ndarray, c: np.ndarray, length: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Columns of a block as (run ends, counts), by group; groups that have none of the
    block's terms are left out. An entry has ``sizes`` counts ``c`` of the groups ``no``."""
    entry = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(length)
    columns = {}
    for group in np.unique(no).tolist():
        full = np.zeros(len(sizes), np.int64)
        mine = no == group
        full[entry[mine]] = c[mine]
        last = np.append(full[1:] != full[:-1], True)
        columns[group] = ends[last], full[last]
    return columns


def shares(counts: np.ndarray, total: int, size: int) -> np.ndarray:
    """p for each count, in whole numbers of any size."""
    different, which = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (c + 1) // (total + size) for c in different.tolist()], np.int64)[which]


def pair_sums(columns: dict[int, tuple[np.ndarray, np.ndarray]], groups: dict[int, tuple[int, int]], terms: int) -> Iterator[tuple[int, int, int, int]]:
    """(group, other, sum of f over the block, terms) for pairs that have a term of it.

    A group without any is one run of zeros. Pairs of two such groups are left to the
    caller, who knows f for a run of zeros in both."""
    coded = {g: (ends, shares(c, *groups[g])) for g, (ends, c) in columns.items()}
    zero = {g: (np.array([terms]), shares(np.zeros(1, np.int64), *of)) for g, of in groups.items() if g not in coded}
    for a, (a_ends, p) in coded.items():
        for b, (b_ends, q) in (coded | zero).items():
            if b in coded and b <= a:
                continue
            ends = np.union1d(a_ends, b_ends)
            length = np.diff(ends, prepend=0)
            x, y = p[np.searchsorted(a_ends, ends)], q[np.searchsorted(b_ends, ends)]
            square = (x - y) * (x - y)
            yield a, b, int((square // y * length).sum()), terms
            yield b, a, int((square // x * length).sum()), terms


SUMS = "lang string, no int, other int, value long, covered long"


def block_sums(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, no, other, value, covered: the pairs' sums, block by block."""
    wanted = blocks.select("lang", "block").distinct().join(groups.select("lang", "no", "n", "v"), "lang")
    names = [f.split()[0] for f in SUMS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(table: pa.Table, of: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows:
            table = table.sort_by("at").combine_chunks()
            counts = table.column("counts").combine_chunks()
            flat, length = counts.flatten(), table.column("length").to_numpy()
            sizes = np.diff(counts.offsets.to_numpy())
            columns = encoded(sizes, flat.field("no").to_numpy(), flat.field("c").to_numpy(), length)
            totals = {no: (n, v) for no, n, v in zip(*(of.column(c).to_pylist() for c in ("no", "n", "v")))}
            lang = table.column("lang")[0].as_py()
            rows = [(lang, *r) for r in pair_sums(columns, totals, int(length.sum()))]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=names)

    right = wanted.toDF("lang_", "block_", "no", "n", "v").groupBy("lang_", "block_")
    return blocks.groupBy("lang", "block").cogroup(right).applyInArrow(run, SUMS)


def source_divergence(documents: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank.

    ``pair`` compares a source with each other one of its lang over all kept terms, ``term``
    lists the terms that a source uses more than its lang does, the 200 strongest. Null
    text, lang and source are empty strings; only these columns are read, so others may
    have any names. Texts are taken whole, equal rows count as often as they occur. A lang
    whose terms are all too rare has pairs of value 0 and no terms; a group without terms
    takes part in pairs with count 0 throughout. An empty table gives an empty table."""
    kept = stage(kept_counts(documents), "kept-terms")
    groups = stage(groups_of(documents, kept), "groups")
    sums = block_sums(ordered_blocks(kept, groups), groups).groupBy("lang", "no", "other").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered"))
    # a run of zeros in both columns, over all terms that no block covered
    mine = groups.select("lang", "source", "no", "n", "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("other"), F.col("n").alias("m"))
    pairs = mine.join(other, "lang").where(F.col("no") != F.col("other")).join(sums, ["lang", "no", "other"], "left")
    pairs = pairs.withColumns({"p": F.expr(f"CASE WHEN v > 0 THEN {share('0', 'n', 'v')} END"), "q": F.expr(f"CASE WHEN v > 0 THEN {share('0', 'm', 'v')} END")})
    rest = F.expr(f"coalesce(({distance('p', 'q')}) * (v - coalesce(covered, 0L)), 0L)")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + rest).alias("value"))

    terms = kept.select("lang", "term", F.col("c").alias("all"), F.explode("by").alias("b")).select("lang", "term", "all", "b.source", "b.c")
    terms = terms.join(_known(groups.select("lang", "source", "n", "v", "l")), ["lang", "source"])
    terms = terms.withColumns({"p": F.expr(share("c", "n", "v")), "q": F.expr(share("all", "l", "v"))}).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)


def op13_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op13_run_lengths": r"""
WITH t AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
e AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM t),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM e GROUP BY ALL HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS l FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM t),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM e SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (n.n + v.v) AS p,
    1 + 1000000000::HUGEINT * (k.c + 1) // (v.l + v.v) AS q
  FROM n JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(f), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS f
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200"""
}
