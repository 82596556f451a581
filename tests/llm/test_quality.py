"""The byte network: tables equal the plain network, gradients, held-out accuracy."""

import numpy as np

from nearfield.llm import quality

SF = "/root/testdata/sf0.1"


def plain_score(net, text):
    rows = quality.windows(np.frombuffer(text, np.uint8))
    y = np.tanh(net.embed[rows].reshape(len(rows), -1) @ net.filters + net.filter_bias)
    chunks = np.stack([y[a:b].max(0) for a, b in quality.chunk_bounds(len(rows))])
    hidden = np.tanh(quality.pooled(chunks) @ net.hidden + net.hidden_bias)
    return float(quality.sigmoid(hidden @ net.out + net.out_bias[0]))


def test_tables_equal_the_network():
    net, rng = quality.initial(), np.random.default_rng(0)
    scorer = quality.Scorer(net)
    for size in (0, 1, 7, 8, 9, 511, 512, 513, 5_000, 70_001):
        text = rng.integers(0, 256, size, np.uint8).tobytes()
        assert abs(scorer.score(text) - plain_score(net, text)) < 1e-4


def test_chunks_cover_every_window():
    for n in (1, 31, 32, 33, 256, 257, 1000, 4097):
        seen = np.zeros(n, bool)
        for a, b in quality.chunk_bounds(n):
            seen[a:b] = True
        assert seen.all()


def test_gradients():
    net = quality.initial(3)
    batch = [np.frombuffer(b"the quick brown fox " * 40, np.uint8), np.frombuffer(b"xyz", np.uint8)]
    labels = np.array([1.0, 0.0], np.float32)

    def loss():
        p = [plain_score(net, b.tobytes()) for b in batch]
        return -(np.log(p[0]) + np.log(1 - p[1])) / 2

    grads = quality.step_gradients(net, batch, labels)
    for p, g in zip(net.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, eps = p[at], 1e-2
        p[at] = keep + eps
        up = loss()
        p[at] = keep - eps
        down = loss()
        p[at] = keep
        assert abs((up - down) / (2 * eps) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net = quality.train(documents, labels, 400)
    rows = quality.score(documents, net).where("held_out").join(labels, "doc_id").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_hard_texts_and_stage_form(spark, make_documents, hard_texts):
    net, df = quality.initial(), make_documents(hard_texts)
    rows = quality.score(df, net).collect()
    assert len(rows) == len(hard_texts) and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality.keep_good(df, net)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in rows)
    empty = make_documents([])
    assert quality.score(empty, net).count() == 0 == quality.keep_good(empty, net).count()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(df, none) is None and quality.score(df, None).where("score = 0.5").count() == len(hard_texts)


def test_repeated_rows_and_labels_crowd_nothing_out(spark, monkeypatch):
    rows = [(i, f"text number {i} " * 5) for i in range(400)] + [(5, "text number 5 " * 5)] * 3000
    labels = [(i, i % 2) for i in range(400)] + [(5, 1)] * 500
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda texts, marks: seen.update(texts=texts, marks=marks) or Zero())
    quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), 60)
    assert sorted(set(seen["marks"].tolist())) == [0, 1] and (seen["marks"] == 0).sum() == (seen["marks"] == 1).sum() == 60
    assert len(set(seen["texts"])) == 120


class Zero:
    out_bias = np.zeros(1, np.float32)
