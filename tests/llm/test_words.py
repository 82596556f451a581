"""Memory of the workers that read whole texts."""

import os
import sys
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import words


def resident_mb():
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc, trims glibc's heap")
def test_a_task_gives_its_free_memory_back():
    """Freed blocks below one that stays are kept by the allocator, unless it is told to trim."""
    stays = []

    def hold(batches):
        blocks = [np.ones(1 << 13) for _ in range(4000)]  # 250 MB in blocks of 64 KB
        stays.append(np.ones(1 << 13))
        yield from batches
        blocks.clear()

    conf = SimpleNamespace(getAll={words.BATCH_KEY: "1"})
    rows = SimpleNamespace(sparkSession=SimpleNamespace(conf=conf), mapInArrow=lambda fn, schema: fn)
    before = resident_mb()
    assert list(words.map_texts(rows, hold, "")(iter([1, 2]))) == [1, 2]
    assert resident_mb() - before < 100


def test_long_texts_come_few_at_a_time(spark):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    before = spark.conf.get(words.BATCH_KEY, None)
    spark.conf.unset(words.BATCH_KEY)
    try:
        texts = spark.range(0, 12, 1, 1).select(F.repeat(F.lit("a"), 1_000_000).alias("text"))
        found = [r["n"] for r in words.map_texts(texts, sizes, "n long").collect()]
    finally:
        if before is not None:
            spark.conf.set(words.BATCH_KEY, before)
    assert sum(found) == 12 and max(found) <= 4
