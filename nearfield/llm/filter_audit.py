"""Audit of five filters: what each removes at each step of every order they can run in.

A document's verdict is a mask of the filters it fails. Each of the 32 masks stands for one
big integer with a field for every outcome of all 120 orders of five steps: 600 fields
that say the document is kept after the step, 600 that say it is removed there, 600 that
the step's filter would have removed it but an earlier one did. One addition of big
integers counts all 1,800 at once; documents are counted by mask first, so a part adds
32 products, and its sums are unpacked field by field. Fields are as wide as the part's
number of documents needs, so no field runs into the next."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.session import lookup_join

FILTERS = "ABCDE"
STEPS = len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
FIELDS = len(ORDERS) * STEPS
DUPLICATE = 1 << FILTERS.index("E")

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
MARKS = b"#$%&*|"
_NO_CAPITALS = bytes(range(65, 91))

MASKS = "doc_id long, part string, mask int, h1 long, h2 long"


def outcome(mask: int, order: str, step: int) -> tuple[bool, bool, bool]:
    """Kept after the step, removed by it, failing its filter but removed before."""
    fails = [bool(mask >> FILTERS.index(f) & 1) for f in order]
    before = any(fails[:step])
    return not before and not fails[step], fails[step] and not before, fails[step] and before


@cache
def packed(mask: int, width: int) -> tuple[int, int, int]:
    """The mask's big integers for kept, removed and redundant; field 5 * order + step."""
    sums = [0, 0, 0]
    for i, order in enumerate(ORDERS):
        for step in range(STEPS):
            for kind, hit in enumerate(outcome(mask, order, step)):
                if hit:
                    sums[kind] |= 1 << (width * (STEPS * i + step))
    return tuple(sums)


def unpacked(total: int, width: int) -> list[int]:
    """The 600 fields of a sum of big integers."""
    least = (1 << width) - 1
    return [total >> (width * i) & least for i in range(FIELDS)]


def text_mask(text: bytes) -> int:
    """Filters A to D that a text fails, as bits in their order."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _NO_CAPITALS))
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    fails = (n < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * points, len(text.translate(None, MARKS)) < len(text))
    return sum(bit << i for i, bit in enumerate(fails))


def text_masks(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask of A to D, and 128 bits that name the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, names = [], []
            for value in batch.column("text"):
                text = value.as_buffer().to_pybytes()
                masks.append(text_mask(text))
                names.append(xxhash.xxh3_128_digest(text))
            name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            columns = [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "mask", "h1", "h2"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text("lang").alias("part"), text("text").alias("text")).mapInArrow(run, MASKS)


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents by part and by the filters they fail.

    E asks for the smallest id of each text. Rows are counted by text, id and kind first,
    then by text and kind with the smallest id's count beside, so a text that very many
    rows share is a handful of rows when its smallest id is looked for."""
    of = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    rows = lookup_join(text_masks(documents), of, ["doc_id"], "left", split_on="doc_id")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["h1", "h2", "part", "mask", "good", "toxic"]
    rows = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    rows = rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("h1", "h2"))
    fresh = F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    rows = rows.select(*kind, "n", fresh.alias("fresh"))
    either = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + DUPLICATE).alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))))
    rows = rows.select("part", "good", "toxic", either.alias("k")).select("part", "good", "toxic", "k.mask", "k.n")
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


AUDIT = (
    "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def part_audit(part: str, masks: list[int], good: list[bool], toxic: list[bool], n: list[int]) -> list[tuple]:
    """The 600 rows of a part from its documents by mask and label."""
    width = max(1, sum(n).bit_length())

    def summed(kind: int, chosen: list[bool]) -> list[int]:
        return unpacked(sum(packed(m, width)[kind] * c for m, c, take in zip(masks, n, chosen) if take), width)

    everyone = [True] * len(n)
    kept, removed, redundant = (summed(kind, everyone) for kind in range(3))
    good_lost, toxic_lost = summed(1, good), summed(1, toxic)
    alone = {f: sum(c for m, c in zip(masks, n) if m == 1 << i) for i, f in enumerate(FILTERS)}
    share = dict.fromkeys(FILTERS, 0)
    for i, order in enumerate(ORDERS):
        for step, f in enumerate(order):
            share[f] += removed[STEPS * i + step]
    return [
        (part, order, step + 1, f, kept[at], removed[at], redundant[at], alone[f], good_lost[at], toxic_lost[at], share[f])
        for i, order in enumerate(ORDERS)
        for step, f in enumerate(order)
        for at in [STEPS * i + step]
    ]


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (a lang value; null is the empty string), order and step.

    Needs doc_id, text and lang of documents and doc_id, quality and toxic of labels; other
    columns may have any names. Null texts are empty: they fail A alone, and E after the
    first. Rows that share an id and a text repeat nothing, as neither id is smaller; rows
    without id never fail E, make nobody else fail it, and have no label. Several labels of
    an id count if one of them does. Texts are taken whole. An empty table has no parts."""

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("mask", "good", "toxic", "n")]
        rows = part_audit(table.column("part")[0].as_py(), *columns)
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 7]
        names = [f.split()[0] for f in AUDIT.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return mask_counts(documents, labels).groupBy("part").applyInArrow(run, AUDIT)


def op12_packed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return audit_filters(documents, labels).drop("filter")


SQL = {
    "op12_packed_counters": r"""
WITH l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, i::INT AS step, substr(filter_order, i, 1) AS f, substr(filter_order, 1, i - 1) AS earlier FROM o, range(1, 6) r(i)),
k AS (SELECT c.*, s.*, contains(fails, f) AS hit, translate(earlier, fails, '') <> earlier AS gone FROM c CROSS JOIN s),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
}
