"""Mixing against a plain version that sorts."""

import hashlib
import random
import re

from nearfield.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshared(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    most = {n: 2.0 * sizes[n] for n in names}
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[n] for n in open_)
        over = {n for n in open_ if target[n] + left * weight[n] / total >= most[n]}
        if not over:
            for n in open_:
                target[n] += left * weight[n] / total
            break
        share = {n: left * weight[n] / total for n in open_}
        left = 0.0
        for n in open_:
            target[n] += share[n]
            if target[n] > most[n]:
                left += target[n] - most[n]
                target[n] = most[n]
        open_ = {n for n in open_ if target[n] < most[n]}
    return target


def rows_of(seed, n=400):
    rng = random.Random(seed)
    sources = ["b", "a", "é", "Z", "zz", None, "hot"]
    return [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))), rng.choice(sources) if rng.random() < 0.6 else "hot") for i in range(n)]


def test_targets_and_taken(make_documents):
    rows = rows_of(1) + [(1000, None, "a"), (1001, "", None), (2005, "x y", "b"), (2005, "x y", "b"), (None, "one two three", "hot")]
    got = mixing.mix(make_documents(rows)).collect()
    assert len(got) == len(rows)
    sizes, docs = {}, []
    for doc_id, text, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + n
        docs.append((doc_id, text, source, n))
    target = reshared(sizes)
    taken = {}
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    for doc_id, _, source, n in docs:
        r = by_id[doc_id].pop() if doc_id not in (2005, None) else by_id[doc_id][-1]
        if doc_id not in (2005, None):
            assert r["size"] == n and r["source_size"] == sizes[source] and abs(r["target"] - target[source]) < 1e-6
            taken[source] = taken.get(source, 0) + r["taken"]
    for source, n in taken.items():
        assert abs(n - target[source]) <= 30 + (20 if source in ("b", "hot") else 0)
    again = mixing.mix(make_documents(rows)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_hash_is_of_id_and_text(make_documents):
    df = make_documents([(1, "a"), (None, None)])
    got = {r["doc_id"]: r["h"] for r in mixing.sized(df).collect()}
    for doc_id, text in ((1, "a"), (None, None)):
        inner = hashlib.md5((text or "").encode()).hexdigest()
        digest = hashlib.md5(f"{'' if doc_id is None else doc_id}:{inner}".encode()).hexdigest()
        assert got[doc_id] == int(digest[:15], 16)


def test_stage_form(make_documents, hard_texts):
    rows = rows_of(2, 100) + hard_texts
    df = make_documents(rows)
    out = mixing.take(df)
    assert out.columns == df.columns
    words = sum(len(WORD.findall(r["text"] or "")) for r in out.collect())
    assert words == sum(r["taken"] for r in mixing.mix(df).collect())
    assert mixing.take(make_documents([])).count() == 0 == mixing.mix(make_documents([])).count()
