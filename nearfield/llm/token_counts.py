"""Token counts by offset-mapped attribution.

A whole document is encoded once. The character spans of its tokens are joined with the
spans of its sections by their ends (both are sorted, so one search per section places all
tokens), and each token is given to sections by an explicit rule:

* ``largest``: to the section that holds most of its characters, the earlier one on a tie;
* ``start``: to the section in which it starts;
* ``share``: to every section it touches, by its share of characters.

Sections lie next to each other or apart, never over one another; characters in no section
belong to none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.tokens import encoder, tokenizer_path

#: Characters of a section after the first line in the registered query.
STRETCH = 2_000
RULES = ("largest", "start", "share")
SCHEMA = "doc_id long, section int, start long, end long, n_tokens double, n_crossing long, doc_tokens long, outside long"


def overlaps(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """token, section and common characters of every token and section that meet. Tokens
    and sections are sorted; tokens may share characters, sections may not."""
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(starts, spans[:, 1], side="left")
    n = np.maximum(last - first, 0)
    token = np.repeat(np.arange(len(spans)), n)
    section = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    common = np.minimum(spans[token, 1], ends[section]) - np.maximum(spans[token, 0], starts[section])
    some = common > 0
    return token[some], section[some], common[some]


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of each section, tokens of each section that cross its border, and tokens
    that were given to no section."""
    k = len(starts)
    token, section, common = overlaps(spans, starts, ends)
    width = spans[token, 1] - spans[token, 0]
    crossing = np.bincount(section[common < width], minlength=k)
    if rule == "share":
        counts = np.bincount(section, common / width, k)
        given = len(np.unique(token))
    else:
        if rule == "largest":
            order = np.lexsort((section, -common, token))
        else:
            inside = np.flatnonzero(starts[section] <= spans[token, 0])
            order = inside[np.argsort(token[inside], kind="stable")]
        one = order[np.unique(token[order], return_index=True)[1]]
        counts = np.bincount(section[one], minlength=k).astype(float)
        given = len(one)
    return counts, crossing, len(spans) - given


def layout_sections(text: Column, stretch: int = STRETCH) -> Column:
    """Sections of a document by its layout: its first line, then the rest in stretches."""
    at = F.when(F.locate("\n", text) > 0, F.locate("\n", text)).otherwise(F.length(text)).cast("long")
    end = F.length(text).cast("long")
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    first = span(F.lit(0).cast("long"), F.when(F.locate("\n", text) > 0, at - 1).otherwise(end))
    begins = F.when(at < end, F.sequence(at, end - 1, F.lit(stretch).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.concat(F.array(first), F.transform(begins, lambda a: span(a, F.least(a + stretch, end))))


def token_counts(documents: DataFrame, tokenizer: str, rule: str = "largest") -> DataFrame:
    """One row per document and section: its place, tokens, tokens that cross its border,
    and the tokens of the whole document and of no section.

    ``documents`` needs doc_id, text and ``sections``, an array of structs (start, end) in
    code points, sorted and apart. Other columns are ignored; repeated rows are repeated. A
    null text is empty; null or no sections give one row with section -1 and all tokens
    outside. An empty section gets no token."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer, True)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]] for f in SCHEMA.split(", ")]
        try:
            for batch in batches:
                rows: list[list] = [[] for _ in names]
                ids, sections = batch.column("doc_id").to_pylist(), batch.column("sections").to_pylist()
                for doc_id, cut, (_, spans) in zip(ids, sections, known.offsets(batch.column("text"))):
                    n = len(spans)
                    if not cut:
                        found = [(doc_id, -1, 0, 0, 0.0, 0, n, n)]
                    else:
                        starts, ends = np.array([c["start"] for c in cut]), np.array([c["end"] for c in cut])
                        counts, crossing, outside = attribute(spans, starts, ends, rule)
                        found = [(doc_id, i, int(starts[i]), int(ends[i]), float(counts[i]), int(crossing[i]), n, outside) for i in range(len(cut))]
                    for row in found:
                        for column, value in zip(rows, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)
        finally:
            known.forget()

    text = F.col("text").cast("string")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("sections").alias("sections"))
    return source.mapInArrow(run, SCHEMA)


def op5_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = documents.withColumn("sections", layout_sections(F.coalesce("text", F.lit(""))))
    return token_counts(cut, tokenizer_path("word_bpe_49k.json"))
