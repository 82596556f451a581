"""Language-model scoring with Elias-Fano n-gram tries.

The model has two levels, words and the words before them:
``p(w | u) = (c(u w) + mu p(w)) / (c(u) + mu)`` with ``p(w) = (c(w) + 1/2) / (N + (V+1)/2)``.
It grows with the corpus, so it is cut into shards by word; a word so frequent that it
would fill a shard is cut again by the word before it. A pair that would fill one by itself
is cut by parcels of documents, and its training count is summed before. Tokens travel to
the shard of their word, as counts by pair and document. There the training tokens are counted into a trie: words and contexts as Elias-Fano
sequences, monotone pointers from a word to the run of its contexts, and one byte for each
quantised smoothed numerator, laid out in one memory-mapped scratch file. A token is looked
up by successor search, the context relative to its word's run. What a word contributes as
the context of its follower needs only its own count, so each token is looked up once."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.words import MIX_2, WordHashes, finish, held_out
from nearfield.session import stage

#: No word contains a blank, so these are no words.
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b" begin"))

MU = 100.0
SHARD_TOKENS = 4_000_000
#: Words with more than this share of the training tokens are cut by context; there are at
#: most as many as the reciprocal.
HOT_SHARE = 2.0**-16
#: A pair may be cut by parcel if so many training tokens taken together have it at least.
PAIR_LEAST = 8
#: Tokens of documents sent together.
SENT_TOKENS = 3_000_000
LEVELS = 256


# -- Elias-Fano -------------------------------------------------------------


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each 64-bit word, by halving."""
    at = np.zeros(len(words), np.uint64)
    k = k.astype(np.int64)
    for size in (32, 16, 8, 4, 2, 1):
        mask = np.uint64((1 << size) - 1)
        low = np.bitwise_count((words >> at) & mask).astype(np.int64)
        up = k >= low
        k = np.where(up, k - low, k)
        at = np.where(up, at + np.uint64(size), at)
    return at.astype(np.int64)


class EliasFano:
    """A sorted sequence of whole numbers: low bits packed, high bits in unary."""

    def __init__(self, arrays: dict[str, np.ndarray], n: int, bits: int):
        self.n, self.bits = n, bits
        self.low, self.high, self.ones, self.zeros = (arrays[k] for k in ("low", "high", "ones", "zeros"))
        # every byte offset as the start of a 64-bit word
        self.at = np.lib.stride_tricks.as_strided(self.low[:8].view("<u8"), (len(self.low) - 7,), (1,))
        self.mask = np.uint64((1 << bits) - 1)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[dict[str, np.ndarray], int, int]:
        n = len(values)
        bits = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        low = np.zeros(n * bits // 8 + 16, np.uint8)
        if bits and n:
            width = (values & np.uint64((1 << bits) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)
            packed = np.packbits(np.unpackbits(width, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little")
            low[: len(packed)] = packed
        top = int(values[-1] >> np.uint64(bits)) if n else 0
        unary = np.zeros(-(-(n + top + 2) // 64) * 64, np.uint8)
        unary[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(count)])
        zeros = np.concatenate([[0], np.cumsum(64 - count)])
        return {"low": low, "high": high, "ones": ones, "zeros": zeros}, n, bits

    def _low(self, i: np.ndarray) -> np.ndarray:
        place = i * self.bits
        return (self.at[place >> 3] >> (place & 7).astype(np.uint64)) & self.mask

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero; behind the last there are only zeros."""
        k = np.minimum(k, self.zeros[-1] - 1)
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word * 64 + _select(~self.high[word], k - self.zeros[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each number, or -1: successor search among those with its high bits."""
        if not self.n:
            return np.full(len(x), -1)
        bucket = np.minimum(x >> np.uint64(self.bits), np.uint64(self.zeros[-1])).astype(np.int64)
        lo = np.where(bucket > 0, self._zero(np.maximum(bucket - 1, 0)) - (bucket - 1), 0)
        end = self._zero(bucket) - bucket
        want, hi = x & self.mask, end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        inside = np.flatnonzero(lo < end)
        hit = inside[self._low(lo[inside]) == want[inside]]
        found = np.full(len(x), -1)
        found[hit] = lo[hit]
        return found


class Trie:
    """Words with exact counts, and the contexts of each with a quantised numerator."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, n: np.ndarray, p: np.ndarray, mu: float):
        """``words`` sorted, ``pairs`` (word, context) sorted with counts ``n``; ``p`` is
        p(w) of each word."""
        contexts = np.unique(pairs[:, 1])
        word = np.searchsorted(words, pairs[:, 0])
        rank = np.searchsorted(contexts, pairs[:, 1])
        self.width = max(1, len(contexts))
        key = word.astype(np.uint64) * np.uint64(self.width) + rank.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, word = key[order], word[order]
        value = np.log10(n[order] + mu * p[word])
        lo, hi = (float(value.min()), float(value.max())) if len(value) else (0.0, 0.0)
        step = (hi - lo) / (LEVELS - 1) or 1.0
        first = np.searchsorted(word, np.arange(len(words) + 1)).astype(np.uint64)
        parts = {
            "words": EliasFano.encode(words, 1 << 64),
            "contexts": EliasFano.encode(contexts, 1 << 64),
            "pointers": EliasFano.encode(first, len(key) + 1),
            "pairs": EliasFano.encode(key, max(1, len(words) * self.width)),
        }
        flat = {f"{a}.{b}": x for a, (arrays, _, _) in parts.items() for b, x in arrays.items()}
        flat |= {"counts": counts.astype(np.int64), "values": np.rint((value - lo) / step).astype(np.uint8), "steps": lo + step * np.arange(LEVELS)}
        self.file = tempfile.TemporaryFile()  # without a name: it ends with the task
        places = {}
        for name, x in flat.items():
            self.file.write(b"\0" * (-self.file.tell() % 8))
            places[name] = (self.file.tell(), x.dtype, len(x))
            self.file.write(np.ascontiguousarray(x).tobytes())
        self.file.write(b"\0" * 8)
        self.file.flush()
        self.size = self.file.tell()
        data = np.memmap(self.file, np.uint8, "r")
        level = {name: data[a : a + k * dtype.itemsize].view(dtype) for name, (a, dtype, k) in places.items()}
        self.words, self.contexts, self.pointers, self.pairs = (
            EliasFano({b: level[f"{a}.{b}"] for b in ("low", "high", "ones", "zeros")}, *parts[a][1:]) for a in ("words", "contexts", "pointers", "pairs")
        )
        self.counts, self.values, self.steps = level["counts"], level["values"], level["steps"]

    def look_up(self, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each word, and the stored log10 numerator of each pair (NaN: unseen)."""
        w = self.words.find(word)
        count = np.where(w >= 0, self.counts[np.maximum(w, 0)] if len(self.counts) else 0, 0)
        numerator = np.full(len(word), np.nan)
        known = np.flatnonzero(w >= 0)
        if len(known) and self.pairs.n:
            run = w[known]
            some = self.pointers.access(run) < self.pointers.access(run + 1)  # the word has contexts
            known = known[some]
            u = self.contexts.find(context[known])
            known, u = known[u >= 0], u[u >= 0]
            at = self.pairs.find(w[known].astype(np.uint64) * np.uint64(self.width) + u.astype(np.uint64))
            hit = at >= 0
            numerator[known[hit]] = self.steps[self.values[at[hit]]]
        return count, numerator


# -- tokens -----------------------------------------------------------------


def tokens_of(text: bytes, memo: WordHashes) -> np.ndarray:
    return np.append(memo.of(text.lower().split()), END)


def with_contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of several texts, the one before each, and the length of each text."""
    word = np.concatenate(texts)
    sizes = np.array([len(t) for t in texts])
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(sizes) - sizes] = BEGIN
    return word, context, sizes


def pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return finish(word * MIX_2 + finish(context))


def place(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which numbers are among sorted ``names``, and where."""
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    hit = np.flatnonzero(names[at] == x)
    return hit, at[hit]


def shard_of(word: np.ndarray, context: np.ndarray, hot: tuple[np.ndarray, np.ndarray], hot_pairs: tuple[np.ndarray, ...], parcel: int, shards: int) -> np.ndarray:
    """A word's shard; for a hot word one of its several, by context; for a hot pair one of
    its several, by parcel."""
    key = word.copy()
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], word), len(hot[0]) - 1)
        cut = np.flatnonzero(hot[0][at] == word)
        key[cut] += finish(context[cut]) % hot[1][at[cut]].astype(np.uint64)
        name = pair_key(word[cut], context[cut])
        hit, at = place(hot_pairs[0], name)  # the word of a hot pair is hot
        key[cut[hit]] = name[hit] + finish(np.array([parcel], np.uint64)) % hot_pairs[1][at].astype(np.uint64)
    return (finish(key) % np.uint64(shards)).astype(np.int64)


def _blob(value) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, protocol=5))


def _unblob(value: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(value))


def source(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 5, 1).alias("held_out"), F.col("text").cast("string").alias("text")
    )


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text"):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def trained_batches(documents: DataFrame, run, schema: str) -> DataFrame:
    """What ``run`` makes of the training texts, given as lists of about SENT_TOKENS tokens."""
    most = SENT_TOKENS

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, size = WordHashes(), [], 0
        for batch in batches:
            for text in _texts(batch):
                held.append(tokens_of(text, memo))
                size += len(held[-1])
                if size >= most:
                    yield run(held)
                    held, size = [], 0
        if held:
            yield run(held)

    return source(documents).where(~F.col("held_out")).select("text").mapInArrow(batched, schema)


COUNTED = "word long, context long, n long"


def word_counts(documents: DataFrame) -> DataFrame:
    """word, context, n over the training documents, the end included: words, without a
    context, and pairs that may be hot. Those are counted only where they are a fair part
    of the tokens taken together: at most ``HOT_SHARE / 2`` of all tokens, or fewer than
    ``PAIR_LEAST`` for each time, are missed. So this finds what to cut, not exact counts."""
    share, fewest = HOT_SHARE / 2, PAIR_LEAST

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        word, context, _ = with_contexts(held)
        words, n = np.unique(word, return_counts=True)
        least = max(fewest, int(share * len(word)))
        rows, _ = place(words[n >= least], word)
        _, first, times = np.unique(pair_key(word[rows], context[rows]), return_index=True, return_counts=True)
        first, times = rows[first[times >= least]], times[times >= least]
        contexts = [pa.nulls(len(words), pa.int64()), pa.array(context[first].view(np.int64))]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([words, word[first]]).view(np.int64)), pa.concat_arrays(contexts), pa.array(np.concatenate([n, times]).astype(np.int64))],
            names=["word", "context", "n"],
        )

    return trained_batches(documents, counted, COUNTED).groupBy("word", "context").agg(F.sum("n").alias("n"))


def pair_counts(documents: DataFrame, names: np.ndarray) -> DataFrame:
    """The exact training counts of the pairs with these names: at, the place of the name, and n."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        word, context, _ = with_contexts(held)
        n = np.bincount(place(names, pair_key(word, context))[1], minlength=len(names))
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n[at].astype(np.int64))], names=["at", "n"])

    return trained_batches(documents, counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))


SENT = "shard int, kind int, parcel long, data binary"


def sent_tokens(documents: DataFrame, hot: tuple[np.ndarray, np.ndarray], hot_pairs: tuple[np.ndarray, ...], shards: int) -> DataFrame:
    """The tokens of all documents by shard: how often each document has a word and the one
    before it, with words as places in a list of the different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        part = TaskContext.get().partitionId()
        parcel = 0
        held: list[tuple] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            word, context, sizes = with_contexts([h[2] for h in held])
            doc = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
            shard = shard_of(word, context, hot, hot_pairs, (part << 36) + parcel, shards)
            order = np.argsort(shard, kind="stable")
            present, at = np.unique(shard[order], return_index=True)
            ids = [h[0] for h in held]
            train = np.array([h[1] for h in held])
            for s, rows in zip(present, np.split(order, at[1:])):
                words, w = np.unique(word[rows], return_inverse=True)
                contexts, u = np.unique(context[rows], return_inverse=True)
                docs, d = np.unique(doc[rows], return_inverse=True)
                run_ = np.lexsort((d, u, w))
                w, u, d = w[run_], u[run_], d[run_]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (u[1:] != u[:-1]) | (d[1:] != d[:-1])
                first = np.flatnonzero(new)
                w, u, d, times = w[first], u[first], d[first], np.diff(first, append=len(new))
                narrow = lambda x: x.astype(np.uint16 if x.max() < 1 << 16 else np.uint32)
                # The ids travel once for a parcel, by way of its first shard.
                names = ids if s == present[0] else None
                data = _blob((docs.astype(np.uint32), names, train[docs], words, contexts, np.bincount(w), narrow(u), narrow(d), narrow(times)))
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([1], pa.int32()), pa.array([(part << 36) + parcel]), pa.array([data], pa.binary())], names=["shard", "kind", "parcel", "data"])

        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            for doc_id, away, text in zip(ids, out, _texts(batch)):
                held.append((doc_id, not away, tokens_of(text, memo)))
                size += len(held[-1][2])
                if size >= SENT_TOKENS:
                    yield from send()
                    held, size = [], 0
                    parcel += 1
        if held:
            yield from send()

    return source(documents).mapInArrow(run, SENT)


def sent_counts(counts: DataFrame, hot: tuple[np.ndarray, np.ndarray], shards: int) -> DataFrame:
    """The word counts by shard; a hot word goes to each of its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column("word").to_numpy().view(np.uint64)
            n = batch.column("n").to_numpy()
            if not len(word):
                continue
            key = word.copy()
            rows = np.arange(len(word))
            if len(hot[0]):
                at = np.minimum(np.searchsorted(hot[0], word), len(hot[0]) - 1)
                times = np.where(hot[0][at] == word, hot[1][at], 1)
                rows = np.repeat(rows, times)
                key = word[rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
            shard = (finish(key) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            present, first = np.unique(shard[order], return_index=True)
            for s, some in zip(present, np.split(order, first[1:])):
                data = _blob((word[rows[some]], n[rows[some]]))
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([0], pa.int32()), pa.array([None], pa.int64()), pa.array([data], pa.binary())], names=["shard", "kind", "parcel", "data"])

    return counts.mapInArrow(run, SENT)


PARTIAL = "parcel long, data binary"
WHOLE = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def scored_shard(lists: list[tuple], parcels: list[tuple], hot_pairs: tuple[np.ndarray, ...], total: int, distinct: int, mu: float) -> Iterator[tuple]:
    """For each parcel its documents' numbers, the ids if they came, and their tokens, known tokens and
    two scores over the tokens of one shard."""
    scale = total + 0.5 * (distinct + 1)
    # All different pairs of the shard, and which are trained how often.
    w = np.concatenate([np.repeat(p[3], p[5]) for p in parcels])
    u = np.concatenate([p[4][p[6]] for p in parcels])
    order = np.lexsort((u, w))
    w, u = w[order], u[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (u[1:] != u[:-1])
    pair_of = np.empty(len(w), np.int64)
    pair_of[order] = np.cumsum(new) - 1
    w, u = w[new], u[new]
    trained = np.concatenate([p[2][p[7]] for p in parcels])
    n = np.bincount(pair_of[trained], np.concatenate([p[8] for p in parcels])[trained], len(w)).astype(np.int64)
    hit, at = place(hot_pairs[0], pair_key(w, u))  # here is only a part of their tokens
    n[hit] = hot_pairs[2][at]
    seen = n > 0
    words, first = np.unique(np.concatenate([*(x[0] for x in lists), w[hit]]), return_index=True)
    counts = np.concatenate([*(x[1] for x in lists), hot_pairs[3][at]])[first]
    p_word = (counts + 0.5) / scale
    trie = Trie(words, counts, np.stack([w[seen], u[seen]], 1), n[seen], p_word, mu)

    base, score, known = np.empty(len(w)), np.empty(len(w)), np.empty(len(w), bool)
    for lo in range(0, len(w), 1 << 18):
        at = slice(lo, lo + (1 << 18))
        count, numerator = trie.look_up(w[at], u[at])
        p = (count + 0.5) / scale
        base[at], known[at] = np.log10(p), count > 0
        # The last part is the token as the context of its follower; the end stands in for
        # the beginning, which is as frequent.
        score[at] = np.where(np.isnan(numerator), np.log10(mu * p), numerator) - np.log10(count + mu)
    done = 0
    for docs, names, _, _, _, _, context, doc, times in parcels:
        mine = pair_of[done : done + len(context)]
        done += len(context)
        k = len(docs)
        tokens, mine_known = np.bincount(doc, times, k), np.bincount(doc, known[mine] * times, k)
        small = np.uint16 if tokens.max() < 1 << 16 else np.uint64
        yield docs, names, tokens.astype(small), mine_known.astype(small), np.bincount(doc, base[mine] * times, k), np.bincount(doc, score[mine] * times, k)


def summed(partial: DataFrame) -> DataFrame:
    """Whole documents from the parts that the shards sent back, parcel by parcel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcel, parts = None, []

        def done() -> pa.RecordBatch:
            ids = next(names for _, names, *_ in parts if names is not None)
            sums = np.zeros((4, len(ids)))
            for docs, _, *values in parts:
                for k, v in enumerate(values):
                    sums[k, docs] += v
            whole = [pa.array(sums[k].astype(np.int64)) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *whole, pa.array(sums[2]), pa.array(sums[3])], names=[f.split()[0] for f in WHOLE.split(", ")])

        for batch in batches:
            for p, data in zip(batch.column("parcel").to_pylist(), batch.column("data")):
                if p != parcel and parts:
                    yield done()
                    parts = []
                parcel = p
                parts.append(_unblob(data.as_py()))
        if parts:
            yield done()

    return partial.repartition("parcel").sortWithinPartitions("parcel").mapInArrow(run, WHOLE)


def scores(documents: DataFrame, mu: float = MU, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every
    document; both scores are log10 probabilities of the whole text.

    The model learns from the documents that are not held out. A null text is empty: only
    its end is scored. Repeated rows are scored and learned from as often as they come; a
    null id is not held out. An empty table gives an empty result, and without training
    documents every token is unknown."""
    found = stage(word_counts(documents), "word-counts")
    counts = found.where(F.col("context").isNull()).select("word", "n")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(size["n"]), int(size["v"])
    shards = max(1, -(-total * 5 // (4 * shard_tokens)))  # about a fifth more tokens are scored
    often = F.col("n") > max(1, int(total * HOT_SHARE))
    frequent = counts.where(often).toPandas()  # at most 1 / HOT_SHARE rows
    word, n = frequent["word"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64)
    pieces = lambda n: np.minimum(shards, np.ceil(4 * shards * n / max(1, total))).astype(np.int64)
    order = np.argsort(word)
    word, n, times = word[order], n[order], pieces(n[order])
    hot = (word[times > 1], times[times > 1])

    # Name, pieces, exact count and the word's count of each hot pair; its word is hot.
    pairs = found.where(F.col("context").isNotNull() & often & (F.col("n") > total // (4 * shards))).toPandas()
    first, second = (pairs[c].to_numpy(np.int64).view(np.uint64) for c in ("word", "context"))
    name, order = np.unique(pair_key(first, second), return_index=True)
    exact = np.zeros(len(name), np.int64)
    if len(name):
        rows = pair_counts(documents, name).toPandas()
        exact[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    hot_pairs = (name, pieces(exact), exact, n[np.searchsorted(word, first[order])])

    rows = sent_counts(counts, hot, shards).unionByName(sent_tokens(documents, hot, hot_pairs, shards))
    # Two shards to a task on average, one after another, so that tasks come out more even.
    rows = rows.repartition(-(-shards // 2), "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lists, parcels, numbers = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if parcels:
                for number, part in zip(numbers, scored_shard(lists, parcels, hot_pairs, total, distinct, mu)):
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_blob(part)], pa.binary())], names=["parcel", "data"])

        for batch in batches:
            for s, kind, number, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "parcel")), batch.column("data")):
                if s != shard:
                    yield from done()
                    shard, lists, parcels, numbers = s, [], [], []
                if kind:
                    parcels.append(_unblob(data.as_py()))
                    numbers.append(number)
                else:
                    lists.append(_unblob(data.as_py()))
        yield from done()

    whole = summed(rows.mapInArrow(run, PARTIAL))
    names = ("n_tokens", "n_known", "base_score", "score")
    columns = {n: F.col(n) for n in names}
    return whole.select(
        "doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), *(columns[n] for n in names[:2]), F.lit(total).cast("long").alias("train_tokens"), *(columns[n] for n in names[2:])
    )


def op6_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
