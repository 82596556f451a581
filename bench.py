"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query is timed from plan to last row (a no-op sink where it has no report of
its own). One untimed run of the smallest query comes first, so the numbers do not
contain the start of the session."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import workload as w
from nearfield.operators import answers, probes, similarity, splits
from nearfield.plans import search
from nearfield.plans.index import MetricIndex
from nearfield.session import stage, stage_path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RADII = (0.05, 0.1, 0.2)
N_QUERIES, MANY_QUERIES = 20, 1_000


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    objects = stage(w.metric_objects(spark, SF_DIR).select("id", "number", "vector", "grp"), "bench-objects")
    probe = w.first_objects(objects, 1)[0]
    drain(similarity.range_query(objects, probe, 0.1, w.METRIC))

    seconds: dict[str, float] = {}

    def timed(name: str, run):
        start = time.perf_counter()
        result = run()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    total = objects.count()
    index = timed(
        "bulk_build",
        lambda: MetricIndex.build(
            objects, stage_path(spark, "bench-index"), w.METRIC, rho=w.RHO / 2,
            limits=w.limits_for(total), fixed_pivots=w.first_objects(objects, 2),
        ),
    )
    counts = index.bucket_counts()
    read = {}
    for radius in RADII:
        q = w.batch(objects, radius, N_QUERIES)
        timed(f"range_query_batch_r{radius}", lambda: drain(similarity.range_query_batch(objects, q, w.METRIC)))
        timed(f"range_query_indexed_r{radius}", lambda: drain(search.range_query_indexed(index.tree, index, q)))
        cost = search.query_cost(index.tree, index, q, counts)
        sums = cost.agg(F.sum("candidates"), F.sum("after_filter")).first()
        read[f"r{radius}"] = {
            "share_read": round(sums[0] / (total * N_QUERIES), 4),
            "share_compared": round(sums[1] / (total * N_QUERIES), 4),
        }
    q = w.batch(objects, 0.1, MANY_QUERIES)
    timed("range_query_batch_many", lambda: drain(similarity.range_query_batch(objects, q, w.METRIC)))
    timed("range_query_indexed_many", lambda: drain(search.range_query_indexed(index.tree, index, q)))
    q = w.batch(objects, 0.2, N_QUERIES)
    timed("range_query", lambda: drain(similarity.range_query(objects, probe, 0.2, w.METRIC)))
    timed("range_query_approx", lambda: drain(search.range_query_approx(index.tree, index, q)))
    timed("knn", lambda: drain(similarity.knn(objects, q, 5, w.METRIC)))
    timed("ranked_answers", lambda: drain(answers.ranked_answers(similarity.range_query_batch(objects, q, w.METRIC))))
    timed("assign_address", lambda: drain(index.tree.assign(objects.select("id", "number", "vector"))))
    near = w.first_objects(objects, 2)
    timed("pivot_distances", lambda: drain(probes.pivot_distances(objects, near, w.METRIC)))
    distances = probes.distance_report(objects, probe, w.METRIC).join(objects.select("id", "grp"), "id")
    timed("balanced_split", lambda: drain(splits.balanced_split(distances, ["grp"], w.RHO)))
    timed("incremental_insert", lambda: index.insert(objects.where(F.col("id") % 50 == 0).withColumn("id", -F.col("id") - 1)))
    line = {
        "metric": "metric similarity search, total of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "objects": total,
        "read": read,
        "sf": SF_DIR.rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
