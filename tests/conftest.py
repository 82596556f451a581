import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def objects(spark):
    """All orders as objects, staged once."""
    from nearfield import workload
    from nearfield.session import stage

    return stage(workload.metric_objects(spark, SF_DIR), "test-objects")


@pytest.fixture(scope="session")
def brute(objects):
    """A plain numpy model of the composite distance over the same objects."""
    import numpy as np

    rows = sorted(objects.collect(), key=lambda r: r["id"])
    ids = np.array([r["id"] for r in rows])
    number = np.array([r["number"] for r in rows])
    vector = np.array([r["vector"] for r in rows])

    class Model:
        pass

    model = Model()
    model.ids = ids
    model.rows = rows

    def distances(row):
        return np.abs(number - row["number"]) + np.sqrt(((vector - np.array(row["vector"])) ** 2).sum(axis=1))

    model.distances = distances
    model.within = lambda row, r: {int(i) for i, d in zip(ids, distances(row)) if round(d, 9) <= r}
    return model
