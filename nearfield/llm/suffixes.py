"""Exact removal of passages that an earlier document has, by families of suffix arrays.

A string of ``length`` bytes repeats if it also starts in a document with a smaller id.
Each such string is filed under its *seed*: the 24 bytes inside it whose hash is least (the
leftmost of equal ones). Equal strings have equal seeds, so only strings under the same
seed are ever compared; neighbouring strings with one seed travel as one piece of text.

Pieces first go by hash alone, packed by parcel and range of seeds (some 15 bytes a piece),
and equal ones fold into the one of the smallest id: a later document's copy of a piece is
repeated for certain. Only where different pieces share a
seed does text travel, one copy of each, dealt out by seed. There they come in batches
ordered by seed and document. A batch gets a suffix array (its strings sorted to ``length``
bytes), is merge-scanned against the levels that earlier batches of the seed left, and
becomes a level itself; levels of about equal size merge, so a family has a number of
levels logarithmic in its size. Since earlier batches hold smaller ids, a level answers
exactly what is asked: does a document with a smaller id have the string. A family goes
when its seed has passed.

Seeds under which very many pieces differ (the borders of a common passage, say) do not
stay in one family: their strings are filed one by one under their own hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.words import MIX, MIX_2, MIX_3, finish
from nearfield.session import fits_broadcast, stage

LENGTH = 50
#: Three words of eight bytes: long enough that few seeds are shared by chance.
SEED_BYTES = 24
#: Bytes of text whose seeds are found at a time (2 ** 24 at most), and pieces looked at
#: together for copies before they are sent.
PIECE_BYTES = 1 << 20
PARCEL_PIECES = 400_000
#: Bytes of texts whose pieces make a shard: about two million pieces.
SHARD_BYTES = 28 << 20
MOST_SHARDS = (1 << 16) - 1
#: Pieces of a shard that are unpacked and judged at a time; one with more (seeds of which
#: very many differ) stays packed and is judged by parts.
JUDGED_PIECES = 4_000_000
#: Bytes of texts returned at a time.
KEPT_BYTES = 8 << 20
BATCH_ROWS = 10_000
#: A seed with so many pieces left after folding is hot; below, a family stays under some
#: dozens of megabytes.
HOT_PIECES = 20_000
HOT = 1 << 62
#: Hot strings that a task folds at a time.
HELD_STRINGS = 200_000

_PLACES = np.uint64((1 << 24) - 1)
_BASE = int(MIX_3) | 1
_BACK = pow(_BASE, -1, 1 << 64)
_HASH = np.uint64((1 << 48) - 1)

#: A place in a text, as one long: 24 bits of the text's hash (they tell rows of one id
#: apart), 31 bits of start, 9 bits of size.
_START_BITS, _SIZE_BITS = 31, 9
_TEXT_SHIFT = _START_BITS + _SIZE_BITS


def powers(base: int, n: int) -> np.ndarray:
    ones = np.full(n, base, np.uint64)
    ones[:1] = 1
    return np.cumprod(ones, dtype=np.uint64)


def seeds_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, count and seed hash of the pieces in texts laid end to end (``ends`` says
    where each ends): ``count`` strings start at ``start`` and after it and share a seed."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    eight = np.ndarray((n - 7,), "<u8", data, strides=(1,)).copy()
    h = finish(eight[: n - SEED_BYTES + 1] + MIX_3)
    for at in range(8, SEED_BYTES, 8):
        h = finish(h * MIX + eight[at : at + len(h)])
    best = (h & ~_PLACES) | np.arange(len(h), dtype=np.uint64)
    width, have = length - SEED_BYTES + 1, 1
    while have < width:  # the least of ``have`` neighbours, doubled
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    place = (best & _PLACES).astype(np.int64)
    inside = np.ones(n - length + 1, bool)  # strings that do not run past their text
    for end in ends[:-1]:
        inside[max(0, end - length + 1) : end] = False
    first = np.empty(len(place), bool)
    first[0] = True
    np.not_equal(place[1:], place[:-1], out=first[1:])
    first[1:] |= inside[1:] != inside[:-1]
    start = np.flatnonzero(first)
    count = np.diff(np.append(start, len(place)))
    real = inside[start]
    start, count = start[real], count[real]
    return start, count, h[place[start]]


class Pieces:
    """Rows of texts cut into pieces of bounded size, laid end to end by parcels."""

    def __init__(self, length: int):
        self.length = length
        # a piece holds PIECE_BYTES and what its last string takes beyond
        self.power = powers(_BASE, PIECE_BYTES + length)
        self.back = powers(_BACK, PIECE_BYTES + length + 1)

    def of(self, texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """data, row of each text piece, its offset in the row, and where it ends."""
        held: list[bytes] = []
        row, offset, size = [], [], 0
        for i, text in texts:
            for at in range(0, max(1, len(text) - self.length + 1), PIECE_BYTES):
                part = text[at : at + PIECE_BYTES + self.length - 1]
                if len(part) < self.length:
                    continue
                if size + len(part) > PIECE_BYTES + self.length - 1:
                    yield self._laid(held, row, offset)
                    held, row, offset, size = [], [], [], 0
                held.append(part)
                row.append(i)
                offset.append(at)
                size += len(part)
        if held:
            yield self._laid(held, row, offset)

    @staticmethod
    def _laid(held: list[bytes], row: list[int], offset: list[int]):
        data = np.frombuffer(b"".join(held), np.uint8)
        return data, np.array(row), np.array(offset), np.cumsum([len(p) for p in held])

    def hashes(self, data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function from starts and sizes of runs to 64-bit hashes of their bytes."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])

        def of(start: np.ndarray, size: np.ndarray) -> np.ndarray:
            return finish((sums[start + size] - sums[start]) * self.back[start] + size.astype(np.uint64) * MIX_2)

        return of


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for i, value in enumerate(batch.column("text")):
        if value.is_valid:
            yield i, value.as_buffer().to_pybytes()


def _keyed(documents: DataFrame) -> DataFrame:
    """doc, th (hash of the text) and text of the rows that have both an id and a text."""
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.where(F.col("doc").isNotNull() & F.col("text").isNotNull())


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it, in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def text_tag(th: np.ndarray) -> np.ndarray:
    """A text's part of its places, from the 64-bit hashes of texts."""
    return (th & ((1 << 24) - 1)) << _TEXT_SHIFT


def starts_and_ends(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = place >> _SIZE_BITS & ((1 << _START_BITS) - 1)
    return start, start + (place & ((1 << _SIZE_BITS) - 1))


def narrow(x: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest needs (the first byte), as unsigned."""
    x = np.ascontiguousarray(x).astype("<u8")
    size = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + x.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def wide(data: bytes) -> np.ndarray:
    body = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    out = np.zeros((len(body), 8), np.uint8)
    out[:, : data[0]] = body
    return out.view("<u8").ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as the first and the differences; a running total undoes it."""
    return np.diff(x.astype("<u8"), prepend=np.uint64(0))


#: A row holds the pieces that one parcel has for one shard. ``docs`` and ``tags`` list their
#: texts, ``who`` points into the lists; rows of certain copies have no ``seeds`` and ``whole``.
PACKED = "shard int, docs binary, tags binary, who binary, start binary, size binary, seeds binary, whole binary"


def _parcel(docs: np.ndarray, tags: np.ndarray, route: np.ndarray, whole: np.ndarray, who: np.ndarray, start: np.ndarray, size: np.ndarray, shards: int) -> pa.RecordBatch:
    """The pieces of some texts by shard. Of equal pieces those of the smallest id are sent
    with their hashes; the others repeat it for certain."""
    order = np.lexsort((tags, docs))
    new = _runs(docs[order], tags[order])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    docs, tags, who = docs[order][new], tags[order][new], number[who]
    order = np.lexsort((whole, route))
    route, whole, who, start, size = (c[order] for c in (route, whole, who, start, size))
    doc, first = docs[who], np.flatnonzero(_runs(route, whole))
    sent = doc == np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
    rows: list[tuple] = []

    def add(shard: np.ndarray, *columns: np.ndarray) -> None:
        """Rows of pieces that lie in the order of their shard."""
        cuts = np.flatnonzero(_runs(shard))
        for a, z in zip(cuts, np.append(cuts[1:], len(shard))):
            who, start, size, *hashes = (c[a:z] for c in columns)
            used = np.zeros(len(docs), bool)
            used[who] = True
            names = narrow(_steps(docs[used])), narrow(tags[used]), narrow((np.cumsum(used) - 1)[who])
            keys = (narrow(_steps(hashes[0])), narrow(hashes[1])) if hashes else (None, None)
            rows.append((int(shard[a]), *names, narrow(start), narrow(size), *keys))

    add((route[sent] * np.uint64(shards)) >> np.uint64(48), who[sent], start[sent], size[sent], route[sent], whole[sent])
    anywhere = finish(doc[~sent].astype(np.uint64)) % np.uint64(shards)
    order = np.argsort(anywhere, kind="stable")
    add(anywhere[order], *(c[~sent][order] for c in (who, start, size)))
    kinds = (pa.int32(), *[pa.binary()] * 7)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in PACKED.split(", ")])


def folded_pieces(documents: DataFrame, length: int, shards: int) -> DataFrame:
    """The pieces of all documents with the hashes of their seed and of all their bytes,
    packed by shard: columns in as few bytes as they need, seeds sorted and as steps. A
    shard is a range of seed hashes."""
    most = PARCEL_PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(length)
        held: list[tuple[np.ndarray, ...]] = []
        count = known = 0
        for batch in batches:
            ids, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "th"))
            tag = th & ((1 << 24) - 1)
            for data, row, offset, ends in pieces.of(_texts(batch)):
                start, n, seed = seeds_of(data, ends, length)
                if not len(start):
                    continue
                piece = np.searchsorted(ends, start, "right")
                whole = pieces.hashes(data)(start, n + length - 1)
                at = start - np.concatenate([[0], ends[:-1]])[piece] + offset[piece]
                held.append((ids[row], tag[row], seed & _HASH, whole & _HASH, known + piece, at, n + length - 1))
                count += len(seed)
                known += len(row)
                if count >= most:
                    yield _parcel(*(np.concatenate(c) for c in zip(*held)), shards)
                    held, count, known = [], 0, 0
        if held:
            yield _parcel(*(np.concatenate(c) for c in zip(*held)), shards)

    return _keyed(documents).mapInArrow(run, PACKED)


def _places(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """doc and place of a row's pieces."""
    docs, tags, who = np.cumsum(wide(row["docs"])).view(np.int64), wide(row["tags"]), wide(row["who"]).astype(np.int64)
    place = tags[who] << np.uint64(_TEXT_SHIFT) | wide(row["start"]) << np.uint64(_SIZE_BITS) | wide(row["size"])
    return docs[who], place.view(np.int64)


def _count(rows: list[dict]) -> int:
    return sum((len(r["size"]) - 1) // r["size"][0] for r in rows)


def _slices(rows: list[dict], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """route, whole, doc and place of a shard's pieces in the order of route and whole, about
    ``most`` at a time; equal pieces stay together."""
    parts = max(1, -(-_count(rows) // most))
    for part in range(parts if rows else 0):
        held = []
        for row in rows:
            columns = (np.cumsum(wide(row["seeds"])), wide(row["whole"]), *_places(row))
            mine = columns[1] % np.uint64(parts) == part
            held.append(tuple(c[mine] for c in columns) if parts > 1 else columns)
        route, whole, doc, place = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((whole, route))
        if len(order):
            yield route[order], whole[order], doc[order], place[order]


def _judged(rows: list[dict], hot: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """doc, place and route of a shard's pieces: without route those that an earlier
    document has for certain, with it the first of their kind where others share the seed."""
    for row in rows:
        if row["seeds"] is None:
            yield *_places(row), None
    rows = [row for row in rows if row["seeds"] is not None]
    only = list(_slices(rows, most)) if _count(rows) <= most else None
    seen = []
    for route, whole, doc, _ in only or _slices(rows, most):
        first = np.flatnonzero(_runs(route))
        n = np.diff(np.append(first, len(doc)))
        seen.append((route[first], n, whole[first], whole[first + n - 1], np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)))
    if not seen:
        return
    routes, *columns = (np.concatenate(c) for c in zip(*seen))
    order = np.argsort(routes, kind="stable")
    first = np.flatnonzero(_runs(routes[order]))
    routes = routes[order][first]
    with_all = (np.add, np.minimum, np.maximum, np.minimum, np.maximum)
    n, least, most_whole, first_doc, last_doc = (f.reduceat(c[order], first) for f, c in zip(with_all, columns))
    differ = (least < most_whole) & (first_doc < last_doc)
    for route, whole, doc, place in only or _slices(rows, most):
        first = np.flatnonzero(_runs(route, whole))
        copy = doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
        yield doc[copy], place[copy], None
        which = np.searchsorted(routes, route)
        asked = differ[which] & ~copy
        yield doc[asked], place[asked], route[asked].astype(np.int64) + np.where(n[which[asked]] >= hot, HOT, 0)


def _shards(documents: DataFrame) -> int:
    """As many shards as shuffle partitions, more where the texts ask for it."""
    size = _keyed(documents).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_SHARDS, max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES)))


def judged_pieces(documents: DataFrame, length: int) -> DataFrame:
    """doc, copied (places that an earlier document has for certain) and asked (place and
    route of pieces that are the first of their kind, where others share the seed; bit
    ``HOT`` of the route is set where very many do)."""
    hot, most = HOT_PIECES, JUDGED_PIECES

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        for doc, place, route in _judged(rows, hot, most):
            routes = pa.nulls(len(doc), pa.int64()) if route is None else pa.array(route, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), routes], names=["doc", "place", "route"])

    rows = folded_pieces(documents, length, _shards(documents)).groupBy("shard").applyInArrow(judge, "doc long, place long, route long")
    asked = F.collect_list(F.when(F.col("route").isNotNull(), F.struct("place", "route")))
    return rows.groupBy("doc").agg(F.collect_list(F.when(F.col("route").isNull(), F.col("place"))).alias("copied"), asked.alias("asked"))


def asked_texts(rows: DataFrame, length: int) -> DataFrame:
    """route, doc, place, s: the text of asked pieces. Strings under hot seeds go one by
    one; of equal ones in a task the smallest id's go, the others are certain (no text).

    ``rows`` holds doc, th, text and the arrays place and route of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        waiting: dict[bytes, list[tuple[int, int]]] = {}
        strings = 0

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["route", "doc", "place", "s"])

        def folded() -> Iterator[pa.RecordBatch]:
            out = []
            for s, places in waiting.items():
                route = xxhash.xxh3_64_intdigest(s) >> 1
                for doc, place in places:
                    sent = doc == least[s]
                    out.append((route if sent else route ^ (place & 0xFFFFFF), doc, place, s if sent else None))
                if len(out) >= BATCH_ROWS:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

        for batch in batches:
            out, held = [], 0
            tags = text_tag(batch.column("th").to_numpy(zero_copy_only=False)).tolist()
            columns = [batch.column(c) for c in ("place", "route")]
            for (i, text), doc in zip(_texts(batch), batch.column("doc").to_pylist()):
                places = columns[0][i].values.to_numpy()
                mine = (places >> _TEXT_SHIFT) << _TEXT_SHIFT == tags[i]
                starts, ends = starts_and_ends(places)
                routes = columns[1][i].values.to_numpy()
                hot = routes >= HOT
                for k in np.flatnonzero(mine & ~hot):
                    out.append((int(routes[k]), doc, int(places[k]), text[starts[k] : ends[k]]))
                for k in np.flatnonzero(mine & hot):
                    for at in range(int(starts[k]), int(ends[k]) - length + 1):
                        s = text[at : at + length]
                        least[s] = min(least.get(s, doc), doc)
                        waiting.setdefault(s, []).append((doc, tags[i] | at << _SIZE_BITS | length))
                        strings += 1
                if len(out) >= BATCH_ROWS:
                    yield made(out)
                    out = []
                if strings >= HELD_STRINGS:
                    yield from folded()
                    least, waiting, strings = {}, {}, 0
            if out:
                yield made(out)
        yield from folded()

    return rows.select("doc", "th", "text", "place", "route").mapInArrow(run, "route long, doc long, place long, s binary")


class SuffixFamily:
    """Suffix arrays of growing size over strings of one length, each string with the
    smallest id that has it."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def least(self, strings: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For sorted strings the smallest id known here, or the given one."""
        least = doc.copy()
        for known, ids in self.levels:
            at = np.minimum(np.searchsorted(known, strings), len(known) - 1)
            same = known[at] == strings
            least[same] = np.minimum(least[same], ids[at[same]])
        return least

    def add(self, strings: np.ndarray, doc: np.ndarray) -> None:
        """A new level of sorted, different strings; equal-sized levels merge."""
        if not len(strings):
            return
        self.levels.append((strings, doc))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            both, ids = np.concatenate([a, b]), np.concatenate([x, y])
            order = np.argsort(both, kind="stable")
            both, ids = both[order], ids[order]
            first = np.flatnonzero(_runs(both))
            self.levels.append((both[first], np.minimum.reduceat(ids, first)))


def suffix_array(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings at ``start`` in order, equal ones as they come, and that order."""
    strings = np.lib.stride_tricks.sliding_window_view(data, length)[start]
    strings = np.ascontiguousarray(strings).view(f"S{length}").ravel()
    order = np.argsort(strings, kind="stable")
    return strings[order], order


def repeated_pieces(rows: DataFrame, length: int) -> DataFrame:
    """doc and place of what repeats, from pieces in the order of route and doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, seed = SuffixFamily(), None

        def found(doc, place):
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int64())], names=["doc", "place"])

        for batch in batches:
            sure = batch.column("s").is_null()
            some = batch.filter(sure)
            if some.num_rows:
                yield some.select(["doc", "place"])
            batch = batch.filter(pc.invert(sure))
            if not batch.num_rows:
                continue
            key, doc, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("route", "doc", "place"))
            if key[0] != seed:
                family = SuffixFamily()
            carried, seed = key == seed, key[-1]
            # a seed that only one row has, and that no other batch can have, repeats nothing
            n = np.diff(np.append(np.flatnonzero(_runs(key)), len(key)))
            used = np.repeat(n > 1, n) | carried | (key == seed)
            batch = batch.filter(pa.array(used))
            key, doc, place, carried = (c[used] for c in (key, doc, place, carried))
            s = batch.column("s").cast(pa.binary())
            data = np.frombuffer(s.buffers()[2], np.uint8)
            ends = np.frombuffer(s.buffers()[1], np.int32)[s.offset : s.offset + len(s) + 1].astype(np.int64)
            strings = np.diff(ends) - length + 1
            total = int(strings.sum())
            inside = np.arange(total) - np.repeat(np.cumsum(strings) - strings, strings)
            owner = np.repeat(np.arange(len(key)), strings)
            ordered, order = suffix_array(data, ends[owner] + inside, length)
            ids = doc[owner][order]
            new = _runs(ordered)
            first = np.flatnonzero(new)
            different, least = ordered[first], np.minimum.reduceat(ids, first)
            known = family.least(different, least) if carried.any() else least
            repeats = np.empty(total, bool)
            repeats[order] = ids > known[np.cumsum(new) - 1]
            going = (key[owner] == seed)[order][first]
            if not carried[-1]:
                family = SuffixFamily()
            family.add(different[going], least[going])
            # runs of repeated strings, piece by piece
            before, after = np.concatenate([[False], repeats[:-1]]), np.append(repeats[1:], False)
            a = np.flatnonzero(repeats & ((inside == 0) | ~before))
            z = np.flatnonzero(repeats & ((np.append(inside[1:], 0) == 0) | ~after))
            who = owner[a]
            tag = (place[who] >> _TEXT_SHIFT) << _TEXT_SHIFT
            start = starts_and_ends(place[who])[0] + inside[a]
            yield found(doc[who], tag | start << _SIZE_BITS | inside[z] - inside[a] + length)

    return rows.select("route", "doc", "place", "s").mapInArrow(run, "doc long, place long")


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, tag, starts, ends: what texts lose, as sorted runs of bytes that do not touch.
    Only texts that lose something have a row; ``tag`` is 24 bits of the text's xxhash64."""
    if not SEED_BYTES + 8 <= length <= 255:
        raise ValueError(f"length must be {SEED_BYTES + 8} to 255 bytes")
    judged = stage(judged_pieces(documents, length), "judged-pieces")
    # The list grows with the texts, so it is never broadcast: one plan at every size.
    asked = judged.where(F.size("asked") > 0).select("doc", "asked.place", "asked.route")
    texts = asked_texts(_keyed(documents).join(asked.hint("merge"), "doc"), length)
    dealt = texts.repartition("route").sortWithinPartitions("route", "doc", "place")
    found = stage(repeated_pieces(dealt, length).groupBy("doc").agg(F.collect_list("place").alias("found")), "found-pieces")
    rows = judged.select("doc", "copied").join(found, "doc", "full")
    places = F.concat(F.coalesce("copied", F.array().cast("array<long>")), F.coalesce("found", F.array().cast("array<long>")))
    return stage(rows.select("doc", places.alias("places")).where(F.size("places") > 0).mapInArrow(_span_rows, SPANS), "spans")


SPANS = "doc long, tag long, starts array<long>, ends array<long>"


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each document as runs, text by text."""
    for batch in batches:
        docs, tags, starts, ends = [], [], [], []
        for doc, places in zip(batch.column("doc").to_pylist(), batch.column("places")):
            place = np.sort(places.values.to_numpy())
            text = place >> _TEXT_SHIFT
            cuts = np.flatnonzero(_runs(text))
            for a, z in zip(cuts, np.append(cuts[1:], len(place))):
                start, end = joined_spans(*starts_and_ends(place[a:z]))
                docs.append(doc)
                tags.append(int(text[a]) & (1 << 24) - 1)
                starts.append(start)
                ends.append(end)
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array(starts, lists), pa.array(ends, lists)], names=["doc", "tag", "starts", "ends"])


def joined_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs with those that touch or overlap made one."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    first = np.concatenate([[0], np.flatnonzero(start[1:] > reach[:-1]) + 1])
    return start[first], np.maximum.reduceat(end, first)


KEPT = "doc_id long, kept binary, spans array<struct<start: bigint, end: bigint>>, n_bytes long, n_removed long"


def without_passages(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every document without the strings of ``length`` bytes that also start in a
    document with a smaller doc_id: doc_id, kept (the remaining bytes), spans (the
    maximal removed runs, byte offsets in the text), n_bytes, n_removed.

    One row per input row; only ``doc_id`` and ``text`` are read, so other columns may
    have any names. A null text counts as empty. Texts under ``length`` bytes lose
    nothing. A row without id loses nothing and is no witness for others. Rows that share
    an id are no witnesses for each other, whatever their texts; repeated rows lose the
    same. Texts of any length are worked through in pieces of bounded size. An empty
    table gives an empty table."""
    spans = repeated_spans(documents, length)
    small = F.broadcast(spans) if fits_broadcast(spans) else spans
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).bitwiseAND((1 << 24) - 1).alias("th"))
    rows = rows.join(small, (F.col("doc_id") == F.col("doc")) & (F.col("th") == F.col("tag")), "left").select("doc_id", "text", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = (batch.column(c) for c in ("doc_id", "starts", "ends"))
            from_, kept, runs, sizes, removed, held = 0, [], [], [], [], 0

            def done(upto: int) -> pa.RecordBatch:
                flat = np.concatenate([np.stack(r, 1) for r in runs]) if runs else np.zeros((0, 2), np.int64)
                pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
                offsets = pa.array(np.cumsum([0, *(len(r[0]) for r in runs)]), pa.int32())
                columns = [ids.slice(from_, upto - from_), pa.array(kept, pa.binary()), pa.ListArray.from_arrays(offsets, pairs), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "kept", "spans", "n_bytes", "n_removed"])

            for i, value in enumerate(batch.column("text")):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                start = end = np.zeros(0, np.int64)
                rest = data
                if starts[i].is_valid:
                    start, end = starts[i].values.to_numpy(), ends[i].values.to_numpy()
                    rest = b"".join(data[a:z] for a, z in zip([0, *end.tolist()], [*start.tolist(), len(data)]))
                kept.append(rest)
                runs.append((start, end))
                sizes.append(len(data))
                removed.append(len(data) - len(rest))
                held += len(data)
                if held >= KEPT_BYTES:
                    yield done(i + 1)
                    from_, kept, runs, sizes, removed, held = i + 1, [], [], [], [], 0
            if kept:
                yield done(batch.num_rows)

    return rows.mapInArrow(run, KEPT)


def op11_suffix_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "spans")
