"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded and read by learned filters, eight bytes wide, at every second
byte. Filter outputs are max-pooled over overlapping chunks that cover the whole text; the
largest, the mean and the smallest chunk value of each filter go through one hidden layer
to a probability. Fitting uses a bounded, documented sample of labelled rows; scoring
covers every byte of every text.

For scoring, embedding and filter are multiplied out once into tables over byte pairs, so
a window costs four table rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.words import held_out, map_texts

WIDTH = 8  # bytes a filter sees
STEP = 2  # bytes between windows
CHUNK = 256  # windows of a chunk
OVERLAP = 32  # windows two neighbouring chunks share
EMBED = 8
FILTERS = 32
HIDDEN = 16

#: Bounds of the fitting sample: rows of each label, and the longest text used in it.
SAMPLE_ROWS = 1_500
SAMPLE_BYTES = 32_768
EPOCHS = 8
THRESHOLD = 0.7
#: Windows scored at a time: bounds a worker's memory however long a text is.
BLOCK = 1 << 15
#: Whole rows that a worker sends back at a time.
KEPT_AT_ONCE = 500


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    filter_bias: np.ndarray
    hidden: np.ndarray  # 3 * FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.filter_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def windows(data: np.ndarray) -> np.ndarray:
    """Windows of ``WIDTH`` bytes at every ``STEP``-th byte, as rows; short texts are
    filled up with zero bytes, and so is the end of a text, which loses no byte."""
    count = max(1, -(-(len(data) - WIDTH) // STEP) + 1)
    padded = np.zeros((count - 1) * STEP + WIDTH, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STEP]


def chunk_bounds(n: int) -> np.ndarray:
    """Starts and ends of overlapping chunks over ``n`` windows."""
    starts = np.arange(0, max(1, n - OVERLAP), CHUNK - OVERLAP)
    return np.stack([starts, np.minimum(starts + CHUNK, n)], 1)


def pooled(chunks: np.ndarray) -> np.ndarray:
    return np.concatenate([chunks.max(0), chunks.mean(0), chunks.min(0)])


def initial(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return Network(
        normal(256, EMBED, scale=0.5),
        normal(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
        np.zeros(FILTERS, np.float32),
        normal(3 * FILTERS, HIDDEN, scale=(3 * FILTERS) ** -0.5),
        np.zeros(HIDDEN, np.float32),
        normal(HIDDEN, scale=HIDDEN**-0.5),
        np.zeros(1, np.float32),
    )


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def step_gradients(net: Network, batch: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss over a batch of texts.

    The maximum passes its gradient to one window per chunk and filter, so going back
    touches few rows."""
    grads = [np.zeros_like(p) for p in net.parameters()]
    g_embed, g_filters, g_bias, g_hidden, g_hbias, g_out, g_obias = grads
    for data, label in zip(batch, labels):
        rows = windows(data)
        x = net.embed[rows].reshape(len(rows), -1)
        y = x @ net.filters
        bounds = chunk_bounds(len(rows))
        best = np.stack([a + y[a:b].argmax(0) for a, b in bounds])  # chunks x filters
        value = np.tanh(np.take_along_axis(y, best, 0) + net.filter_bias)
        feature = pooled(value)
        hidden = np.tanh(feature @ net.hidden + net.hidden_bias)
        error = (sigmoid(hidden @ net.out + net.out_bias[0]) - label) / len(batch)
        g_out += error * hidden
        g_obias += error
        back = error * net.out * (1 - hidden**2)
        g_hidden += np.outer(feature, back)
        g_hbias += back
        f = (net.hidden @ back).reshape(3, FILTERS)
        each = np.repeat(f[1:2] / len(bounds), len(bounds), 0)
        columns = np.arange(FILTERS)
        each[value.argmax(0), columns] += f[0]
        each[value.argmin(0), columns] += f[2]
        each *= 1 - value**2
        g_bias += each.sum(0)
        flat = best.ravel()
        into = each.astype(np.float32).ravel()
        filt = np.tile(columns, len(bounds))
        picked = x[flat]
        np.add.at(g_filters.T, filt, picked * into[:, None])
        back_x = (net.filters.T[filt] * into[:, None]).reshape(-1, EMBED)
        np.add.at(g_embed, rows[flat].ravel(), back_x)
    return grads


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam over small batches in a fixed random order."""
    net = initial(seed)
    rng = np.random.default_rng(seed)
    data = [np.frombuffer(t, np.uint8) for t in texts]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    at, total = 0, epochs * -(-len(data) // 24)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for begin in range(0, len(order), 24):
            picked = order[begin : begin + 24]
            grads = step_gradients(net, [data[i] for i in picked], labels[picked])
            at += 1
            rate = 0.01 * (1 - at / (total + 1))
            for p, g, (m, v) in zip(net.parameters(), grads, state):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**at)) / (np.sqrt(v / (1 - 0.99**at)) + 1e-8)
    return net


class Scorer:
    """The network with embedding and filters multiplied out over byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        parts = net.embed @ net.filters.reshape(WIDTH, EMBED, FILTERS)  # WIDTH x 256 x FILTERS
        pair = np.arange(1 << 16)
        self.tables = [parts[k][pair & 255] + parts[k + 1][pair >> 8] for k in range(0, WIDTH, 2)]

    def chunk_values(self, data: np.ndarray) -> np.ndarray:
        count = max(1, -(-(len(data) - WIDTH) // STEP) + 1)
        padded = np.zeros((count - 1) * STEP + WIDTH, np.uint8)
        padded[: len(data)] = data
        pairs = padded.view("<u2")
        bounds = chunk_bounds(count)
        found = np.empty((len(bounds), FILTERS), np.float32)
        per_block = max(1, BLOCK // (CHUNK - OVERLAP))
        for k in range(0, len(bounds), per_block):
            some = bounds[k : k + per_block]
            lo, hi = int(some[0, 0]), int(some[-1, 1])
            y = self.tables[0][pairs[lo:hi]]
            for j in range(1, WIDTH // 2):
                y += self.tables[j][pairs[lo + j : hi + j]]
            for i, (a, b) in enumerate(some - lo):
                y[a:b].max(0, out=found[k + i])
        return np.tanh(found + self.net.filter_bias)

    def score(self, text: bytes) -> float:
        net = self.net
        feature = pooled(self.chunk_values(np.frombuffer(text, np.uint8)))
        hidden = np.tanh(feature @ net.hidden + net.hidden_bias)
        return float(sigmoid(float(hidden @ net.out) + float(net.out_bias[0])))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Network | None:
    """Fit on at most ``sample_rows`` rows of each label, chosen by a hash of the id among
    all labelled rows outside the held-out part with texts of at most ``sample_bytes``, each
    id once however often its rows or labels repeat; the
    shares of the labels are counted over all labelled training rows and put back into the
    bias. None where no row is labelled."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    known = known.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    short = documents.where(F.octet_length(F.coalesce("text", F.lit(""))) <= sample_bytes).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = {row["quality"]: row["n"] for row in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(2))
    ids = None
    for value in shares:  # two labels at most; a quarter more ids than rows wanted, as long texts fall out
        some = known.where(F.col("quality") == value).distinct().orderBy(order, "doc_id").limit(sample_rows + sample_rows // 4)
        ids = some if ids is None else ids.unionAll(some)
    if ids is None:
        return None
    # one text of an id, so that repeated rows cannot crowd out others
    rows = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy(order, "doc_id").collect()
    texts: list[bytes] = []
    marks: list[int] = []
    for value in sorted(shares):
        some = [row["text"].encode() for row in rows if row["quality"] == value][:sample_rows]
        texts += some
        marks += [value] * len(some)
    if not texts:
        return None
    net = fit(texts, np.array(marks, np.float32))
    used = [max(1, marks.count(v)) for v in (0, 1)]
    net.out_bias += np.float32(np.log((shares.get(1, 0) + 1) / (shares.get(0, 0) + 1)) - np.log(used[1] / used[0]))
    return net


def score(documents: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document.

    Only ``text`` is an input of the score. A null text scores as an empty one, which is a
    window of zero bytes; repeated rows give repeated results; a null id is not held out.
    Without a fitted network every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net is not None else None
        for batch in batches:
            values = [
                0.5 if scorer is None else scorer.score(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(values, pa.float64())], names=["doc_id", "held_out", "score"]
            )

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = source.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(documents: DataFrame, net: Network | None) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns as they are.
    The score is computed beside the row, so repeated ids cannot mix up verdicts. A null
    text is scored as an empty one, texts may have any length, an empty table stays empty;
    without a fitted network all stay. Rows go back in small batches."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net is not None else None
        at = names.index("text")
        for batch in batches:
            for begin in range(0, batch.num_rows, KEPT_AT_ONCE):
                some = batch.slice(begin, KEPT_AT_ONCE)
                keep = [
                    True if scorer is None else scorer.score(v.as_buffer().to_pybytes() if v.is_valid else b"") >= THRESHOLD for v in some.column(at)
                ]
                yield some.filter(pa.array(keep, pa.bool_()))

    return map_texts(documents, run, documents.schema)


def op1_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
