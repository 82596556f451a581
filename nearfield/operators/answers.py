"""Ranking, counting and merging answers of many queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.ordering import GROUP_ROWS, running_total
from nearfield.schema import RANK_PLACES
from nearfield.session import stage


def ranked_answers(answers: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``rank`` within each query by (distance, id), from 1.

    A query with very many answers is ranked piece by piece."""
    kept = stage(answers.withColumn("_d", F.round("dist", RANK_PLACES)), "answers")
    ranked = running_total(kept, ["qid"], ["_d", "id"], F.lit(1), "rank", group_rows)
    return ranked.withColumn("rank", F.col("rank").cast("int")).drop("_d")


def answer_counts(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers per query; queries without any keep a row with zero."""
    counts = answers.groupBy("qid").agg(F.count("*").alias("n"))
    return queries.select("qid").join(counts, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


def merge_answers(*parts: DataFrame) -> DataFrame:
    """One answer set per query out of partial ones: each (query, object) once,
    at its smallest reported distance. Answers stay rows, so no query has to fit
    in one row or task."""
    union = parts[0].select("qid", "id", "dist")
    for part in parts[1:]:
        union = union.unionByName(part.select("qid", "id", "dist"))
    return union.groupBy("qid", "id").agg(F.min("dist").alias("dist"))
