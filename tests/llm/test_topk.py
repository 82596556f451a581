"""Dual-tree search against brute force."""

import random

import numpy as np
import pytest

from nearfield.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, asked):
    usable = [(i, np.floor(64 * np.array(v, float))) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if asked(q):
            scores = sorted((-int(np.dot(a, b)), i) for i, b in usable if i != q)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "SLICE", 2)
    rng, nrng = random.Random(4), np.random.default_rng(4)
    middles = nrng.normal(size=(6, 8))
    rows = [(i, np.float32(middles[i % 6] + spread * nrng.normal(size=8)).tolist(), 0) for i in range(700)]
    rows += [(700 + i, rows[5][1], 0) for i in range(100)]  # one vector a hundred times
    rows += [(900, None, 0), (920, [float("nan")] * 8, 0), (940, [None] + [0.0] * 7, 0), (960, [float("inf")] * 8, 0), (None, [1.0] * 8, 0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 7).collect()
    assert sorted(map(tuple, got)) == brute(rows, 7, lambda i: i % 20 == 0)


def test_few_rows_and_empty(spark):
    rows = [(0, [0.5, -0.5], 1), (20, [], 1), (3, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 20 = 0"), 20).collect()))
    assert got == [(0, 1, 3, 0), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 3, 0)]
    assert topk.top_k(df.limit(0), df.limit(0), 20).count() == 0


def test_repeated_rows_are_each_answered(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (0, [1.0], 1), (1, [2.0], 1)], SCHEMA)
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id = 0"), 5).collect()))
    assert got == [(0, 1, 1, 8192), (0, 1, 1, 8192)]


def test_tree_covers_and_separates():
    points = np.random.default_rng(0).normal(size=(600, 3)) * 40
    tree = topk.Tree(points)
    assert sorted(tree.rows.tolist()) == list(range(600)) and len(tree.centre) > 10

    def rows_of(node):
        lo, hi = tree.child[node]
        return tree.rows[slice(*tree.run[node])] if lo == hi else np.concatenate([rows_of(c) for c in range(lo, hi)])

    for node in range(len(tree.centre)):
        away = np.sqrt(((points[rows_of(node)] - points[tree.centre[node]]) ** 2).sum(1))
        assert away.max() <= tree.radius[node] + 1e-9
        lo, hi = tree.child[node]
        centres = points[tree.centre[lo:hi]]
        gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(hi - lo) * 1e9
        assert lo == hi or gaps.min() > tree.radius[node] / topk.BASE


def test_pruning_happens():
    nrng = np.random.default_rng(1)
    middles = nrng.normal(size=(8, 4)) * 100
    data = np.floor(middles[np.arange(4000) % 8] + nrng.normal(size=(4000, 4)))
    queries = topk.Block(np.arange(100_000, 100_400), data[:400])
    block, best, seen = topk.Block(np.arange(4000), data), topk.Best(400, 10), []
    real = best.add
    best.add = lambda rows, scores, ids: (seen.append(scores.size), real(rows, scores, ids))
    topk.search(queries, block, best)
    assert sum(seen) < 0.5 * 400 * 4000
    want = np.sort(data[:400] @ data.T, axis=1)[:, -10:][:, ::-1]
    assert (best.score == want).all()
