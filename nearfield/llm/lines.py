"""Line dedup by a deletion-neighbourhood join.

A line is a sequence of words. It repeats an earlier line if it is equal to it, or if one
word less, one more or one other word makes it equal (for lines long enough that a word is
a small part). Equal lines are merged first. Then lines emit hashed keys of their whole
word sequence and of every sequence with one word left out; lines with a common key are at
most an edit apart or two, the earliest of a key is the witness of the others, and the
edit distance is verified on the words. Only lines that share an unchanged half with
another line emit keys, since one edit leaves a half unchanged: nothing is lost by that.
Halves and keys travel with one hash of their line only; places and words join those that
another line shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.words import MIX, MIX_2, MIX_3, WordHashes, finish, free_names, map_texts
from nearfield.session import Stages, fits_broadcast, stage

#: Defaults: shorter lines are left alone, as they repeat in any prose, and words from which
#: on one edited word still counts as the same line.
MIN_WORDS = 4
NEAR_WORDS = 10
#: Rows of deletion keys sent at a time.
KEYS_AT_ONCE = 50_000
#: Words whose lines are hashed together.
HASHED_WORDS = 300_000
LAST = (1 << 63) - 1  # orders rows without id behind the others

_ODD = int(MIX) | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def words(line: Column) -> Column:
    return F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def keyed(documents: DataFrame) -> DataFrame:
    """id (rows without one last), th (hash of the text) and text."""
    text = F.col("text").cast("string")
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


class Runs:
    """Hashes of runs of words in a long sequence, from running sums of word hashes times
    powers of an odd number: any run costs two look-ups."""

    def __init__(self, h: np.ndarray, odd: int):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(odd, len(h)), dtype=np.uint64)])
        self.back = powers(pow(odd, -1, 1 << 64), len(h) + 1)

    def of(self, start: np.ndarray, end: np.ndarray, mark: np.ndarray | int = 0) -> np.ndarray:
        total = (self.sums[end] - self.sums[start]) * self.back[start]
        return finish(total + (end - start + mark).astype(np.uint64) * MIX_2).view(np.int64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers, kept by the worker."""
    if base not in _powers or len(_powers[base]) < n:
        ones = np.full(max(n, 1 << 16), base, np.uint64)
        ones[0] = 1
        _powers[base] = np.cumprod(ones, dtype=np.uint64)
    return _powers[base][:n]


def line_hashes(h: np.ndarray, sizes: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two hashes of each line and, for the long ones, the keys of their halves: as a line of
    its length, and as the longer of two lines that differ by an inserted word."""
    end = np.cumsum(sizes)
    start = end - sizes
    first, second = Runs(h, _ODD), Runs(h, int(MIX_3) | 1)
    halves = []
    begin, stop = start[long], end[long]
    for n in (sizes[long], np.maximum(sizes[long] - 1, 0)):
        cut = n // 2
        halves += [first.of(begin, begin + cut, 4 * n), first.of(stop - (n - cut), stop, 4 * n + 1)]
    return first.of(start, end), second.of(start, end), np.stack(halves, 1)


def occurrences(documents: DataFrame, least_words: int, near_words: int) -> DataFrame:
    """Every line with enough words: id, th, number, words, two hashes and, for lines that an
    edit may join to others, half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            row, number, sizes, held, size = [], [], [], [], 0

            def hashed() -> pa.RecordBatch:
                n = np.array(sizes)
                long = n >= near_words - 1
                h1, h2, halves = line_hashes(np.concatenate(held), n, long)
                at = pa.array(row)
                until = np.concatenate([np.zeros(1, np.int64), np.cumsum(4 * long)])
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(at), batch.column("th").take(at), pa.array(number, pa.int64()), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2),
                        pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.array(halves.ravel())),
                    ],
                    names=["id", "th", "no", "n", "h1", "h2", "halves"],
                )

            for i, value in enumerate(batch.column("text")):
                if not value.is_valid:
                    continue
                for no, line in enumerate(value.as_buffer().to_pybytes().split(b"\n")):
                    some = line.split()
                    if some and len(some) >= least_words:
                        row.append(i)
                        number.append(no)
                        sizes.append(len(some))
                        held.append(memo.of(some))
                        size += len(some)
                if size >= HASHED_WORDS:
                    yield hashed()
                    row, number, sizes, held, size = [], [], [], [], 0
            if row:
                yield hashed()

    return map_texts(keyed(documents), run, "id long, th long, no long, n long, h1 long, h2 long, halves array<long>")


def place() -> Column:
    return F.struct("id", "no", "th")


def variants(lines: DataFrame) -> DataFrame:
    """h1, key and place of the word left out (-1: none) of each line's deletion
    neighbourhood. All keys of a line come from sums over its words, so they take time in
    proportion to its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            held: list[tuple[int, np.ndarray]] = []
            size = 0

            def together() -> pa.RecordBatch:
                n = np.array([len(key) for _, key in held])
                h1 = np.repeat(np.array([h for h, _ in held], np.int64), n)
                out = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) - 1
                key = np.concatenate([key for _, key in held]).view(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(h1), pa.array(key), pa.array(out, pa.int32())], names=["h1", "key", "out"])

            for name, line in zip(batch.column("h1").to_pylist(), batch.column("w").to_pylist()):
                h = memo.of([w.encode() for w in line])
                n = len(h)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(_ODD, n), dtype=np.uint64)])
                without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)
                key = np.concatenate([finish(sums[-1:] + np.uint64(n * int(MIX_2) % 2**64)), finish(without + np.uint64((n - 1) * int(MIX_2) % 2**64))])
                held.append((name, key))
                size += n + 1
                if size >= KEYS_AT_ONCE:
                    yield together()
                    held, size = [], 0
            if held:
                yield together()

    return lines.select("h1", "w").mapInArrow(run, "h1 long, key long, out int")


def shared(rows: DataFrame, key: str, inner: Stages) -> DataFrame:
    """The keys that two lines or more have, to be joined: broadcast if they are few."""
    found = rows.groupBy(key).agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where(F.col("lo") < F.col("hi"))
    found = inner(found.select(key), f"shared-{key}")
    return F.broadcast(found) if fits_broadcast(found) else found


def one_edit(a: list[str], b: list[str]) -> bool:
    """At most one word inserted, removed or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    head = 0
    while head < short and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < short - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head + tail >= max(len(a), len(b)) - 1


def near_lines(documents: DataFrame, lines: DataFrame, firsts: DataFrame, near_words: int, inner: Stages) -> DataFrame:
    """h1, h2 of the distinct lines that are one edit away from an earlier line."""
    halves = lines.select("h1", F.explode("halves").alias("half"))
    several = halves.join(shared(halves, "half", inner), "half").select("h1").distinct()
    hopeful = firsts.join(several, "h1").select("h1", "h2", F.col("first.id").alias("id"), F.col("first.no").alias("no"), F.col("first.th").alias("th"))
    hopeful = inner(hopeful, "hopeful")
    homes = inner(hopeful.select("id", "th").distinct(), "hopeful-documents")
    small = F.broadcast(homes) if fits_broadcast(homes) else homes
    cut = keyed(documents).join(small, ["id", "th"]).select("id", "th", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    texts = cut.join(hopeful, ["id", "th", "no"]).select("h1", "h2", "id", "no", "th", words(F.col("line")).alias("w"))
    texts = inner(texts.dropDuplicates(["h1", "h2"]), "hopeful-lines")

    every = inner(variants(texts), "variants")
    rows = every.join(shared(every, "key", inner), "key").join(texts.select("h1", "h2", "id", "no", "th"), "h1")
    rows = inner(rows, "shared-variants")
    place_of = F.struct("id", "no", "th", "h1", "h2")
    whole, less = F.col("out") < 0, F.col("out") >= 0
    by_key = rows.groupBy("key").agg(F.min(F.when(whole, place_of)).alias("whole"), F.min(F.when(less, place_of)).alias("less"))
    inserted = rows.join(by_key, "key").select(place_of.alias("me"), F.when(whole, F.col("less")).otherwise(F.col("whole")).alias("witness"))
    by_place = rows.where(less).groupBy("key", "out").agg(F.min(place_of).alias("witness"), F.count("*").alias("c")).where(F.col("c") > 1)
    replaced = rows.where(less).join(by_place, ["key", "out"]).select(place_of.alias("me"), "witness")
    pairs = inserted.unionByName(replaced).where(F.col("witness") < F.col("me"))
    pairs = pairs.select(F.col("me.h1").alias("h1"), F.col("me.h2").alias("h2"), F.col("witness.h1").alias("g1"), F.col("witness.h2").alias("g2")).distinct()
    pairs = inner(pairs, "line-pairs")
    other = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("w").alias("v"))
    both = pairs.join(texts.select("h1", "h2", "w"), ["h1", "h2"]).join(other, ["g1", "g2"]).where(F.greatest(F.size("w"), F.size("v")) >= near_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [one_edit(a, b) for a, b in zip(batch.column("w").to_pylist(), batch.column("v").to_pylist())]
            yield batch.select(["h1", "h2"]).filter(pa.array(keep, pa.bool_()))

    return both.select("h1", "h2", "w", "v").mapInArrow(run, "h1 long, h2 long").distinct()


def dropped(documents: DataFrame, least_words: int, near_words: int, inner: Stages) -> DataFrame:
    """id, th, exact and near: the numbers of the lines that each text loses."""
    lines = inner(occurrences(documents, least_words, near_words), "lines")
    mark = F.xxhash64("id", "no", "th")
    firsts = lines.groupBy("h1", "h2").agg(F.min(place()).alias("first"), (F.min(mark) < F.max(mark)).alias("again"))
    firsts = inner(firsts, "first-lines")
    near = inner(near_lines(documents, lines, firsts, near_words, inner), "near-lines").withColumn("near", F.lit(True))
    repeated = firsts.join(near, ["h1", "h2"], "left").where(F.col("near") | F.col("again"))
    repeated = inner(repeated.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "repeated-lines")
    small = F.broadcast(repeated) if fits_broadcast(repeated) else repeated
    hit = lines.select("id", "th", "no", "h1", "h2").join(small, ["h1", "h2"])
    hit = hit.withColumn("later", place() > F.col("first")).where(F.col("near") | F.col("later"))
    no = F.col("no").cast("int")
    return hit.groupBy("id", "th").agg(F.collect_set(F.when(F.col("later"), no)).alias("exact"), F.collect_set(F.when(~F.col("later"), no)).alias("near"))


def without(lines: Column, lost: Column) -> Column:
    """The text of ``lines`` but for those numbered in ``lost``. The lines are bound once, so
    that a text of very many lines is cut a single time."""

    def joined(pieces: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), lost)
        return F.array_join(F.transform(kept, lambda i: F.element_at(pieces, i + 1)), "\n")

    return F.element_at(F.transform(F.array(lines), joined), 1)


def dedup_lines(documents: DataFrame, least_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """Documents without the lines that repeat an earlier line, and counts of them.

    Earlier means a smaller doc_id (rows without id come last), then a smaller line number.
    All columns stay; ``text`` is shortened, and ``_n_lines``, ``_n_exact`` and ``_n_near`` are
    added (with more underscores where a column has that name). Lines under ``least_words``
    words stay, blank ones always; one edited word counts where the longer of two lines has
    ``near_words`` words. A line is compared with all lines of the input, with those too that
    are dropped themselves, so near lines may follow each other in a chain. Equal rows hold
    the same occurrences and keep the same lines. A null text stays null and counts no line; a
    text may become empty. A text without such lines is unchanged; an empty table gives an
    empty result; a text may have any length and number of lines."""
    names = free_names(documents.columns, "_id", "_th", "_exact", "_near", "_n_lines", "_n_exact", "_n_near")
    return _deduped(documents, least_words, near_words, names)


def _deduped(documents: DataFrame, least_words: int, near_words: int, names: list[str]) -> DataFrame:
    own, th, exact, near, n_lines, n_exact, n_near = names
    with Stages(documents.sparkSession) as inner:
        lost = stage(dropped(documents, least_words, near_words, inner), "lost-lines")
    lost = lost.select(F.col("id").alias(own), F.col("th").alias(th), F.col("exact").alias(exact), F.col("near").alias(near))
    small = F.broadcast(lost) if fits_broadcast(lost) else lost
    text = F.col("text").cast("string")
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col(own)) & (F.xxhash64(text) == F.col(th))
    rows = documents.join(small, same, "left")
    new = F.when(F.col(own).isNull(), text).otherwise(without(F.split(text, "\n"), F.concat(exact, near)))
    ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    count = lambda c: F.when(F.col(own).isNull(), 0).otherwise(F.size(c)).cast("long")
    columns = [new.alias("text") if name == "text" else F.col(f"`{name}`") for name in documents.columns]
    return rows.select(*columns, F.coalesce(ends + 1, F.lit(0)).cast("long").alias(n_lines), count(exact).alias(n_exact), count(near).alias(n_near))


def without_repeated_lines(documents: DataFrame, least_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """The shortened documents with their columns as they are; a document that loses its
    last word goes, one that had no word from the start (null, empty or blank) stays.
    ``n_chars``, where there is such a column, follows the text. Repeated rows, very long
    texts and empty tables are treated as in ``dedup_lines``."""
    names = free_names(documents.columns, "_id", "_th", "_exact", "_near", "_n_lines", "_n_exact", "_n_near")
    rows = _deduped(documents, least_words, near_words, names)
    changed = F.col(names[5]) + F.col(names[6]) > 0
    emptied = changed & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = rows.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType))
    return rows.select(*(F.col(f"`{name}`") for name in documents.columns))


def op4_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_exact").alias("n_exact"), F.col("_n_near").alias("n_near"), "text")
