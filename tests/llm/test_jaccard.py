"""The Jaccard join against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from nearfield.llm import graph, jaccard


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            smallest[find(i)] = min(doc_id, smallest.get(find(i), doc_id))
    return sorted(((r[0], len(s), smallest.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(seed, groups=12, most=14):
    rng = random.Random(seed)
    rows, passage = [], " ".join(f"p{i}" for i in range(30))
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(2, 120))]
        for _ in range(rng.randrange(1, most)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            if rng.random() < 0.1:
                w = w[: rng.randrange(1, len(w) + 1)]
            text = " ".join(w)
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text + (" " + passage if g % 3 == 0 else "")))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (2, 70)])
def test_equals_all_pairs(make_documents, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard, "LONG", 3)
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 4)
    monkeypatch.setattr(jaccard, "VERIFY_ROWS", 3)
    rows = near_copies(width)
    got = jaccard.similarity_classes(make_documents(rows), width, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows, width, percent)


@pytest.mark.parametrize("width, percent", [(5, 80), (2, 40)])
def test_short_texts_need_not_share_more_than_they_must(make_documents, width, percent):
    words = [f"w{i}" for i in range(9)]
    rows = [(1, " ".join(words[:8])), (2, " ".join(words))]
    rows += [(10 + 2 * i + k, " ".join(f"g{i}x{j}" for j in range(n))) for i in range(20) for k, n in enumerate((i % 10 + 1, i % 10 + 2))]
    got = jaccard.similarity_classes(make_documents(rows), width, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows, width, percent)


def test_hard_texts_and_stage_form(make_documents, hard_texts):
    df = make_documents(hard_texts)
    got = jaccard.similarity_classes(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(hard_texts, 3, 90)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    want = Counter(r["component_id"] for r in jaccard.similarity_classes(df, 5, 80).where("node is not null").collect())
    ids = Counter(r["doc_id"] for r in kept.where("text is not null and trim(text) <> ''").collect())
    assert ids[5] == 1 and ids[11] == 1 and ids[12] == 0 and ids[None] == want[None]
    assert kept.where("text is null").count() == 2  # without words nothing is a copy


def test_empty_table(make_documents):
    empty = make_documents([])
    assert jaccard.similarity_classes(empty).count() == 0 == jaccard.one_of_each(empty).count()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1001 + i) for i in range(60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(61)}


def test_frequent_shingles_stay_within_their_bound(make_documents, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 10)
    monkeypatch.setattr(jaccard, "BAND", 0.999)
    rows = [(i, " ".join(f"a{j}" for j in range(i % 7, 60))) for i in range(80)]
    tokens, counts = jaccard.frequent(jaccard.sets(make_documents(rows), 3).cache())
    assert len(tokens) <= 10 and (np.diff(tokens.astype(object)) > 0).all() and (counts >= 8).all()
