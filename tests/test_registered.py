"""Every query of the reference's operators against its SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from nearfield import oracle, workload
from tests.conftest import SF_DIR

SQL, QUERIES = oracle.oracle_sql(), workload.registered()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    expected = duck.execute(SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(df.collect(), df.columns) == normal(expected.fetchall(), names)
