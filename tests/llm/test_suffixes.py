"""Repeated passages against a plain version that looks at every string."""

import hashlib
import random

import numpy as np
import pytest

from nearfield.llm import suffixes
from tests.conftest import SF_DIR


def plain(rows, length):
    """Digest of every row, by looking every string up among those of smaller ids."""
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        if i is not None:
            for at in range(len(data) - length + 1):
                s = data[at : at + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        lost = np.zeros(len(data) + 1, int)
        if i is not None:
            for at in range(len(data) - length + 1):
                if first[data[at : at + length]] < i:
                    lost[at : at + length] = 1
        runs = int((np.diff(np.concatenate([[0], lost[:-1], [0]])) == 1).sum()) if len(data) else 0
        kept = bytes(b for b, x in zip(data, lost) if not x)
        out.append((i, len(data), int(lost.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df, length):
    rows = suffixes.without_passages(df, length).collect()
    out = []
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] == r["n_bytes"] - len(r["kept"])
        out.append((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
    return sorted(out, key=repr)


def passages(rng, n, docs, alphabet="abcdefghij éß\n"):
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30, 140))) for _ in range(n)]
    rows = []
    for i in range(docs):
        text = "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(rng.randrange(9)))
        rows.append((rng.randrange(docs * 2), text))
    return rows


def test_equals_plain(make_documents, hard_texts):
    rng = random.Random(3)
    rows = passages(rng, 12, 150) + [t for t in hard_texts if len(t[1] or "") < 1000]
    rows += [(900 + i, "ab" * 60) for i in range(3)] + [(950, "\x00" * 120), (951, "x" + "\x00" * 70)]
    df = make_documents(rows).repartition(5)
    assert found(df, 50) == plain(rows, 50)
    assert found(df, 37) == plain(rows, 37)


@pytest.mark.parametrize("parcel", [1, 60])
def test_small_pieces_parcels_and_hot_seeds(make_documents, monkeypatch, parcel):
    """Texts longer than a piece, copies in and across parcels, seeds that all share."""
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 300)
    monkeypatch.setattr(suffixes, "PARCEL_PIECES", parcel)
    monkeypatch.setattr(suffixes, "HOT_PIECES", 20)
    monkeypatch.setattr(suffixes, "HELD_STRINGS", 100 * parcel)
    rng = random.Random(parcel)
    common = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(200))) + common + t * rng.randrange(1, 4)) for i, t in passages(rng, 8, 60)]
    df = make_documents(rows).repartition(4)
    assert suffixes.judged_pieces(df, 50).where(f"exists(asked, a -> a.route >= {suffixes.HOT})").count() > 0
    assert found(df, 50) == plain(rows, 50)


def test_pieces_travel_in_few_bytes(make_documents):
    """Columns of a shard's pieces are as narrow as they can be: rows of four longs took 32 bytes a piece."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(4000))) for i in range(150)]
    packed = suffixes.folded_pieces(make_documents(rows).repartition(2), 50, 3).collect()
    pieces = sum(len(suffixes.wide(r["size"])) for r in packed)
    assert pieces > 30_000 and {r["shard"] for r in packed} == {0, 1, 2}
    assert sum(len(c) for r in packed for c in r if isinstance(c, (bytes, bytearray))) < 18 * pieces


def test_shards_judged_by_parts(make_documents, monkeypatch):
    """A shard that holds more than may be unpacked at once gives the same."""
    rng = random.Random(17)
    common = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, t + common + str(i % 9)) for i, t in passages(rng, 8, 80)]
    whole = found(make_documents(rows).repartition(3), 50)
    monkeypatch.setattr(suffixes, "JUDGED_PIECES", 40)
    assert found(make_documents(rows).repartition(3), 50) == whole == plain(rows, 50)
    packed = [r.asDict() for r in suffixes.folded_pieces(make_documents(rows), 50, 1).where("seeds is not null").collect()]
    parts = list(suffixes._slices(packed, 40))
    assert len(parts) > 5 and sum(len(p[0]) for p in parts) == sum(len(suffixes.wide(r["size"])) for r in packed)
    alike = [set(zip(p[0].tolist(), p[1].tolist())) for p in parts]
    assert len(set().union(*alike)) == sum(map(len, alike))


def test_narrow_columns_round_trip():
    for values in ([], [0], [255, 256], [2**63 - 1, 5], [-1, -(2**63), 7]):
        x = np.array(values, np.int64)
        assert suffixes.wide(suffixes.narrow(x)).view(np.int64).tolist() == values
        x.sort()
        assert np.cumsum(suffixes.wide(suffixes.narrow(suffixes._steps(x)))).view(np.int64).tolist() == x.tolist()


def test_ids_of_any_size(make_documents):
    text = "".join(random.Random(8).choice("abcdefgh ") for _ in range(300))
    rows = [(2**62, text), (-(2**63), "x" + text[:200]), (-1, text[100:]), (0, text + "y"), (2**63 - 1, text[50:90])]
    assert found(make_documents(rows).repartition(3), 50) == plain(rows, 50)


def test_families_over_many_batches(spark, make_documents, monkeypatch):
    """A seed whose pieces come in many batches is looked up in the merged levels."""
    rng = random.Random(9)
    common = "".join(rng.choice("abcdefgh ") for _ in range(70))
    rows = [(i, "".join(rng.choice("ab") for _ in range(12)) + common + "".join(rng.choice("ab") for _ in range(12))) for i in range(120)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert found(make_documents(rows).repartition(3), 50) == plain(rows, 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_levels_stay_logarithmic():
    family, rng, seen = suffixes.SuffixFamily(), np.random.default_rng(1), {}
    for doc in range(64):
        strings = np.unique(np.array([b"%06d" % x for x in rng.integers(0, 3000, 40)], "S6"))
        ids = np.full(len(strings), doc)
        assert family.least(strings, ids).tolist() == [seen.get(s, doc) for s in strings.tolist()]
        family.add(strings, ids)
        for s in strings.tolist():
            seen.setdefault(s, doc)
    assert len(family.levels) <= 7


def test_a_passage_of_the_corpus(spark, make_documents):
    """Copies lose all, near copies what they share, clean documents nothing."""
    base = " ".join(f"word{i * 7919 % 5000}" for i in range(400))
    near = base.replace("word77 ", "other ").replace(base[2000:2010], "##########")
    clean = " ".join(f"unlike{i * 31 % 9000}" for i in range(400))
    got = {r["doc_id"]: r for r in suffixes.without_passages(make_documents([(1, base), (2, clean), (3, base), (4, near)])).collect()}
    assert got[1]["n_removed"] == got[2]["n_removed"] == 0
    assert got[3]["n_removed"] == len(base) and bytes(got[3]["kept"]) == b""
    assert 0 < got[4]["n_bytes"] - got[4]["n_removed"] < 200


def test_empty_and_refused(make_documents):
    assert suffixes.without_passages(make_documents([])).count() == 0
    assert found(make_documents([(1, None), (None, "x" * 90)]), 50) == plain([(1, None), (None, "x" * 90)], 50)
    with pytest.raises(ValueError):
        suffixes.repeated_spans(make_documents([]), 20)


def test_the_query_covers_every_document(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    expected = plain([(r["doc_id"], r["text"]) for r in docs], 50)
    got = suffixes.op11_suffix_families(spark, SF_DIR).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == expected
