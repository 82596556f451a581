"""Divergence of sources against sums over every term of every pair."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from nearfield.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def f(p, q):
    return (p - q) ** 2 // q


def plain(rows):
    in_documents, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        group = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups.add(group)
        counts[group].update(terms)
        in_documents.update((group[0], t) for t in set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (of, t), n in in_documents.items() if of == lang and n >= 3)
        mine = {g: [counts[g][t] for t in kept] for g in groups if g[0] == lang}
        p = {g: [1 + 10**9 * (c + 1) // (sum(column) + len(kept)) for c in column] for g, column in mine.items()}
        whole = [sum(c) for c in zip(*mine.values())]
        q = [1 + 10**9 * (c + 1) // (sum(whole) + len(kept)) for c in whole]
        for g in mine:
            pairs = [(other[1], sum(map(f, p[g], p[other]))) for other in mine if other != g]
            terms = [(t, f(a, b)) for t, c, a, b in zip(kept, mine[g], p[g], q) if c and a > b]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(*g, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < 200}
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    df = df.selectExpr("*", "1 as c", "2 as d", "3 as term", "4 as n", "5 as v", "6 as no", "7 as part", "8 as block", "9 as value")
    got = [tuple(r) for r in divergence.source_divergence(df.repartition(4)).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def sample(seed, n, words=300):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeÉß漢Z") for _ in range(rng.randrange(1, 6))) for _ in range(words)]
    text = lambda: "".join(rng.choice(pool[: rng.choice([3, 40, words])]) + rng.choice([" ", "\n", "1", "_", "-", "@", "\x7f"]) for _ in range(rng.randrange(60)))
    return [(text(), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", "z", None, ""])) for _ in range(n)]


def test_equals_plain(spark, hard_texts):
    rows = sample(1, 150) + [(t, "en", "hard") for _, t in hard_texts] + [("x y", "rare", "one"), (None, "rare", "two"), ("q", "alone", "s")]
    assert found(spark, rows) == plain(rows)


def test_blocks_and_partial_sums(spark, monkeypatch):
    """Many small blocks, counts sent in many parts, one source with most of the rows."""
    monkeypatch.setattr(divergence, "BLOCK_COUNTS", 60)
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    rows = sample(2, 80) + [(t, "en", "a") for t, *_ in sample(3, 120)]
    assert found(spark, rows) == plain(rows)


def test_only_the_strongest_terms(spark):
    rows = [(" ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)), "en", "s")] * 3 + [("other words here", "en", "t")] * 3
    got = found(spark, rows)
    assert got == plain(rows) and len([r for r in got if r[:3] == ("en", "s", "term")]) == 200


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, None, None), ("", "", "x")]) == plain([(None, None, None), ("", "", "x")])


@pytest.mark.parametrize("seed", range(3))
def test_pair_sums_of_runs(seed):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 3, (200, 4)) * rng.integers(0, 2, (200, 1))
    length = rng.integers(1, 5, 200)
    entry, no = np.nonzero(table)
    groups = {j: (int(rng.integers(1000, 10**13)), 900) for j in range(5)}
    columns = divergence.encoded(np.bincount(entry, minlength=200), no, table[entry, no], length)
    full = {j: (table[:, j] if j < 4 else np.zeros(200, int)).tolist() for j in range(5)}
    p = {j: [1 + 10**9 * (c + 1) // sum(groups[j]) for c in full[j]] for j in full}
    got = {(a, b): (value, terms) for a, b, value, terms in divergence.pair_sums(columns, groups, int(length.sum()))}
    expected = {(a, b): (sum(f(x, y) * n for x, y, n in zip(p[a], p[b], length.tolist())), int(length.sum())) for a in full for b in full if a != b}
    assert got == expected
