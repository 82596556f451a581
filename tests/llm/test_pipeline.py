"""The pipeline's stages in a row, and the registered queries with SQL."""

import duckdb

import __spark_entry__
import corpus_pipeline
from nearfield import llm

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, SF).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    # So few labels teach little here; accuracy is tested on a larger table.
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[3] < sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed) >= docs.count()


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in llm.oracle_sql().items():
        df = llm.registered()[name](spark, SF)
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        cell = lambda v: round(v, 6) if isinstance(v, float) else v
        want = sorted(tuple(map(cell, r)) for r in found.fetchall())
        assert sorted(tuple(map(cell, r)) for r in df.select(*names).collect()) == want and len(names) == len(df.columns)
