"""Elias-Fano sequences, tries and scores against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from nearfield.llm import lm


@pytest.mark.parametrize("n, top", [(0, 10), (1, 1 << 63), (1000, 1200), (5000, 1 << 62), (3000, 10**9)])
def test_sequence(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
    ef = lm.EliasFano(*lm.EliasFano.encode(values, top))
    assert (ef.access(np.arange(len(values))) == values).all()
    assert (ef.find(values) == np.arange(len(values))).all()
    others = np.setdiff1d(np.concatenate([values + np.uint64(1), rng.integers(0, top, 500, dtype=np.uint64)]), values)
    assert (ef.find(others) == -1).all()
    if n > 100 and top > 1 << 40:  # close to the bound of 2 bits and the low bits
        assert ef.low.nbytes + ef.high.nbytes < len(values) * (math.log2(top / len(values)) + 3) / 8 + 64


def plain(rows, mu):
    docs = [(i, [*(t or "").encode().lower().split(), "END"]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    c, pair = Counter(), Counter()
    for (_, w), out in zip(docs, held):
        if not out:
            c.update(w)
            pair.update(zip(["BEGIN", *w], w))
    c["BEGIN"] = c["END"]
    total, distinct = sum(c.values()) - c["BEGIN"], len(+c) - (c["BEGIN"] > 0)
    p = lambda w: (c[w] + 0.5) / (total + 0.5 * (distinct + 1))
    for (i, w), out in zip(docs, held):
        base = sum(math.log10(p(x)) for x in w)
        score = sum(math.log10((pair[u, x] + mu * p(x)) / (c[u] + mu)) for u, x in zip(["BEGIN", *w], w))
        yield i, out, len(w), sum(c[x] > 0 for x in w), total, base, score


def close(got, want):
    order = lambda r: (repr(r[:5]), round(r[5], 3))
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6
        assert abs(a[6] - b[6]) < 0.02 * b[2]  # one byte for a value


def test_scores_over_many_shards(make_documents, hard_texts, monkeypatch):
    monkeypatch.setattr(lm, "SENT_TOKENS", 5_000)
    monkeypatch.setattr(lm, "HOT_SHARE", 0.01)
    rng = np.random.default_rng(3)
    rows = [(100 + i, " ".join(f"v{min(rng.geometric(0.05), 90)}" for _ in range(rng.integers(0, 80)))) for i in range(200)] + hard_texts
    close(lm.scores(make_documents(rows), 20.0, 3_000).collect(), plain(rows, 20.0))


def with_a_hot_pair():
    """Documents in which a third of the tokens are one pair."""
    rng = np.random.default_rng(5)
    return [(i, " ".join(w for _ in range(12) for w in ("the", "the", f"v{rng.integers(400)}", f"u{rng.integers(400)}"))) for i in range(300)]


def test_scores_with_a_hot_pair(make_documents, monkeypatch):
    monkeypatch.setattr(lm, "SENT_TOKENS", 500)
    rows = with_a_hot_pair()
    exact = []
    counted = lm.pair_counts
    monkeypatch.setattr(lm, "pair_counts", lambda *x: exact.append(x) or counted(*x))
    close(lm.scores(make_documents(rows), 20.0, 1_000).collect(), plain(rows, 20.0))
    assert len(exact) == 1


def test_no_shard_takes_a_whole_hot_pair(make_documents, monkeypatch):
    monkeypatch.setattr(lm, "SENT_TOKENS", 500)
    sent, most = lm.sent_tokens, []

    def watched(*args):
        rows = sent(*args)
        got = Counter()
        for r in rows.collect():
            got[r["shard"]] += len(lm._unblob(r["data"])[6])  # a row for each pair and document, before: each token
        most.append((max(got.values()), sum(got.values())))
        return rows

    monkeypatch.setattr(lm, "sent_tokens", watched)
    lm.scores(make_documents(with_a_hot_pair()), 20.0, 500).collect()
    ((largest, rows),) = most
    tokens = 300 * (12 * 4 + 1)
    assert rows < 0.85 * tokens and largest < 0.08 * tokens  # the pair has 0.24 of all tokens


def test_nothing_to_learn_from(make_documents):
    rows = [(next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1), "a b")]
    (row,) = lm.scores(make_documents(rows)).collect()
    assert row["held_out"] and row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0.0
    assert lm.scores(make_documents([])).count() == 0


def test_held_out_text_is_likelier_than_by_words_alone(spark):
    got = lm.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got["s"] > got["b"]
