"""Stage tables of queries can be removed when their results are used up."""

from nearfield import session
from nearfield import workload as w
from tests.conftest import SF_DIR


def test_release_removes_what_queries_staged(spark):
    kept = session.staged_paths(spark)
    for query in (w.ranked_answers, w.query_cost, w.knn):
        assert query(spark, SF_DIR).count() > 0
    mine = [p for p in session.staged_paths(spark) if p not in kept]
    assert mine and any(session.path_exists(spark, p) for p in mine)
    session.release(spark, kept)
    assert not any(session.path_exists(spark, p) for p in mine) and session.staged_paths(spark) == kept


def test_a_write_returns_the_drivers_free_memory(spark):
    app = spark.sparkContext.applicationId
    session._returned[app] = -1e9
    session.stage(spark.range(3), "returned")
    assert session._returned[app] > 0
    assert not session.return_memory(spark)  # not after every write
    assert session.return_memory(spark, 0)
    session._trim_native_heap(spark)  # this JVM has the command
