"""Base spans against Python's ``re`` on hand-made and random texts."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from nearfield.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text: str) -> list[tuple[int, int, int]]:
    spans = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                spans.append((m.start(), k, m.end()))
    return sorted(spans)


def sha(spans) -> str:
    return hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


HAND = [
    "a@b.c@d.e a@b.c_d@e.f x@y_z@w.com ..@a.b -@-.- a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3 0.0.0.00000",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 123", "+1 (988) 555-2485 +1-2 +12345678901 +1((((((2345678901", "é😀+49 30 1234567 é a.b@c.de",
    "1" * 20_000, "a" * 20_000 + "@", "+" * 5_000, "1 " * 10_000, "a.b@c.d " * 300, "",
    "call (415) 555-2671 now or mail joe [at] site [dot] org", "version 415 555 2671 order 415-555-2671",
]


def test_base_spans(make_documents):
    rng = random.Random(3)
    texts = HAND + ["".join(rng.choice("ab1234 .@+-()_é\n") for _ in range(rng.randrange(400))) for _ in range(300)]
    texts += ["".join(rng.choice("123456789 -+.") for _ in range(60)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9_001, None), (None, "a@b.cd"), (None, None), (0, texts[0])]
    found = pii.find(make_documents(rows))
    got = found.select("doc_id", F.filter("spans", lambda s: s["base"]).alias("base"), "spans").collect()
    assert len(got) == len(rows)
    want = dict(enumerate(map(plain, texts))) | {9_001: []}
    for row in got:
        base = [(s["start"], s["kind"], s["end"]) for s in row["base"]]
        if row["doc_id"] is not None:
            assert base == want[row["doc_id"]], texts[row["doc_id"]]
        assert set(base) <= {(s["start"], s["kind"], s["end"]) for s in row["spans"]}


def test_many_spans_of_one_text(make_documents):
    """Thousands of spans, and numbers that are none: places agree, in time that grows with
    their number. Spans of the wider patterns beside base ones stay apart from them."""
    rng = random.Random(8)
    some = ["a.b@c.de", "10.2.3.4", "4111 1111 1111 1111", "+1 (988) 555-2485", "é", "12,", "415-555-2671"]
    texts = [" x ".join(rng.choice(some) for _ in range(4_000)), "12, " * 100_000]
    rows = {r["doc_id"]: r["spans"] for r in pii.candidates(make_documents(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        base = [(s["start"], s["kind"], s["end"]) for s in rows[i] if s["base"]]
        assert base == plain(text)
    wide = [s for s in rows[0] if not s["base"]]
    assert [(s["start"], s["end"]) for s in wide] == [m.span() for m in re.finditer(r"415-555-2671", texts[0])]
    ends = sorted((s["start"], s["end"]) for s in rows[0])
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_query_columns(spark, tmp_path, make_documents):
    rows = [(i, t) for i, t in enumerate(HAND)] + [(50, None)]
    make_documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op2_weak_supervision(spark, str(tmp_path)).collect()}
    for i, text in enumerate(HAND):
        spans = plain(text)
        assert got[i]["base_sha256"] == sha(spans)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
    assert got[50]["spans"] == "" and got[50]["base_sha256"] == sha([])


def test_empty_table(make_documents):
    assert pii.find(make_documents([])).count() == 0


def test_reliabilities_find_the_better_labelers():
    """Votes drawn from known rates: beliefs follow the truth, a random labeler counts little."""
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.6
    votes = np.ones((4000, pii.LABELERS), int)
    for j, right in enumerate((0.95, 0.9, 0.85, 0.5, 0.8)):
        good = rng.random(4000) < right
        votes[:, j] = np.where(good == truth, 2, 0)
    code = (votes * 3 ** np.arange(pii.LABELERS)[::-1]).sum(1)
    belief = pii.reliabilities(np.zeros(4000, int), code, np.ones(4000))
    assert ((belief > 0.5) == truth).mean() > 0.93
