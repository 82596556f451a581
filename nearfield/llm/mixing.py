"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a hash. A source that should give ``r`` more words than its whole
copies takes the documents whose hash lies below a threshold. The threshold is found
without sorting: words are summed by source and hash bucket, the bucket in which the
running total passes ``r`` is the boundary, and only that bucket is divided again. Budgets
nest: a smaller budget takes a subset of a larger one. All of it is DataFrame work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.words import WORD, free_names
from nearfield.session import fits_broadcast, stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0

#: Hash bits: 15 hexadecimal digits of an md5. Each level divides a bucket into 4,096.
BITS = 60
LEVEL_BITS = 12


def words_in(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id, text):
    """60 bits of a hash of the id and the text; equal rows have equal hashes."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sized(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words_in(F.col("text").cast("string")).alias("size"),
        document_hash(F.col("doc_id"), F.col("text").cast("string")).alias("h"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target of every source.

    Sources weigh ``weights`` in turn by code point, a null source last. They divide
    ``share`` of all words by weight; none gets more than ``most`` times its size, and what
    is above goes to the others by weight until none is above. That ends at one level of
    words per weight, which is read off the sources ordered by their ceiling per weight.
    The windows run over one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kind = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = table.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (kind + 1).cast("int")))
    table = table.withColumn("most", F.lit(most) * F.col("source_size"))
    all_rows = Window.partitionBy()
    upward = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("budget", F.lit(share) * F.sum("source_size").over(all_rows))
    table = table.withColumn("rest_w", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    table = table.withColumn("rest", F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    # The level if this source and all above it were the ones below their ceiling.
    table = table.withColumn("level", F.col("rest") / F.col("rest_w"))
    first = F.min(F.when(F.col("most") > F.col("level") * F.col("w"), F.struct(F.col("most") / F.col("w"), F.col("level")))).over(all_rows)
    level = first["level"]
    target = F.when(level.isNull(), F.col("most")).otherwise(F.least(F.col("most"), level * F.col("w")))
    return table.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, copies, below: take each document ``copies`` times, and once more where its
    hash is under ``below``.

    ``wanted`` has source, source_size and target. Each level sums words by bucket inside
    the boundary bucket of the level before; at the last level a bucket is one hash value,
    and it is taken if that brings the total nearer to the target."""
    same = F.col("r.source").eqNullSafe(F.col("s.source"))
    state = wanted.select(
        "source",
        F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(2)).cast("long").alias("copies"),
        "target",
        "source_size",
    )
    state = state.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    state = state.select("source", "copies", "left", F.lit(0).cast("long").alias("low"))
    shift = BITS
    while shift:
        wide, shift = shift, shift - LEVEL_BITS
        bucket = F.shiftright(F.col("r.h"), shift)
        inside = rows.alias("r").join(state.alias("s"), same & (F.shiftright(F.col("r.h"), wide) == F.shiftright(F.col("s.low"), wide)))
        sums = inside.groupBy(F.col("s.source").alias("source"), bucket.alias("bucket")).agg(
            F.sum("r.size").alias("words"), F.first("s.left").alias("left"), F.first("s.copies").alias("copies"), F.first("s.low").alias("low")
        )
        until = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(until), F.lit(0)))
        # The boundary: the last bucket that starts within what is left.
        edge = sums.where(F.col("before") <= F.col("left")).groupBy("source").agg(
            F.max(F.struct("bucket", "before", "words", "left", "copies")).alias("e")
        )
        low = F.shiftleft(F.col("e.bucket"), shift)
        if shift == 0:
            nearer = F.abs(F.col("e.before") + F.col("e.words") - F.col("e.left")) <= F.abs(F.col("e.left") - F.col("e.before"))
            low = F.when(nearer, low + 1).otherwise(low)
        state = edge.select("source", F.col("e.copies").alias("copies"), (F.col("e.left") - F.col("e.before")).alias("left"), low.alias("low"))
        state = stage(state, "mix-edge")
    return state.select("source", "copies", F.col("low").alias("below"))


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document.

    A null text has size 0, a null source is a source of its own, repeated rows share a
    hash and so a verdict. An empty table gives an empty result; a source without words
    has target 0 and gives none."""
    rows = stage(sized(documents), "mix-sizes")
    wanted = stage(targets(rows), "mix-targets")
    edges = thresholds(rows, wanted)
    plan = wanted.alias("t").join(edges.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
    plan = plan.select(F.col("t.source"), "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("below", F.lit(0)).alias("below"))
    times = F.col("p.copies") + (F.col("r.h") < F.col("p.below")).cast("long")
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    return joined.select("r.doc_id", "r.size", "p.source_size", "p.target", (F.col("r.size") * F.least(times, F.lit(2))).alias("taken"))


def take(documents: DataFrame) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it, with its
    columns as they are.

    Sizes, sources and verdicts are those of ``mix``: a null, empty or blank text has no
    words and follows its hash like any other, a null source is a source, repeated rows share
    a verdict, texts may have any length, an empty table stays empty."""
    h, times, copy = free_names(documents.columns, "_h", "_times", "_copy")
    rows = stage(sized(documents), "mix-sizes")
    wanted = stage(targets(rows), "mix-targets")
    edges = thresholds(rows, wanted)
    few = F.broadcast(edges) if fits_broadcast(edges) else edges
    mine = documents.withColumn(h, document_hash(F.col("doc_id"), F.col("text").cast("string"))).alias("d")
    found = mine.join(few.alias("e"), F.col("d.source").cast("string").eqNullSafe(F.col("e.source")))
    often = F.least(F.col("e.copies") + (F.col(f"d.{h}") < F.col("e.below")).cast("long"), F.lit(2)).cast("int")
    repeated = found.withColumn(times, often).where(F.col(times) > 0)
    copies = repeated.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return copies.select(*(F.col(f"d.`{name}`") for name in documents.columns))


def op8_hash_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same choice with running totals over sorted hashes. Sources with equal ceilings per
#: weight come out alike in any order.
SQL = {
    "op8_hash_thresholds": """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
             CASE (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
      FROM s),
l AS (SELECT source, source_size, most, w, most / w AS ratio,
             (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY most / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(level, ratio) FILTER (WHERE most > level * w) AS level FROM l),
t AS (SELECT source, source_size, greatest(coalesce(least(most, c.level * w), most), 0) AS target FROM l, c),
g AS (SELECT d.source, h, sum(size) AS words FROM d GROUP BY d.source, h),
r AS (SELECT g.source, g.h, g.words, least(floor(target / greatest(source_size, 1)), 2) AS copies,
             target - least(floor(target / greatest(source_size, 1)), 2) * source_size AS room,
             coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
k AS (SELECT source, h, copies + CASE WHEN before + words <= room
               OR before <= room AND abs(before + words - room) <= abs(room - before) THEN 1 ELSE 0 END AS times
      FROM r)
SELECT d.doc_id, d.size, t.source_size, t.target, (d.size * least(k.times, 2))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
}
