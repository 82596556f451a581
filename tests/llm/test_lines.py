"""Line dedup against a brute-force version."""

import random
import re

from nearfield.llm import lines


def brute(rows, least=lines.MIN_WORDS, near_from=lines.NEAR_WORDS):
    """(n_exact, n_near, text) per row: every line against every earlier one."""
    split = lambda s: [w for w in re.split(r"[\x20\x09-\x0D]+", s) if w]
    occurrences = []
    for i, (doc_id, text, *_) in enumerate(rows):
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            w = split(line)
            if w and len(w) >= least:
                occurrences.append(((doc_id if doc_id is not None else lines.LAST, no), i, no, w, text))
    out = []
    for i, (doc_id, text, *_) in enumerate(rows):
        exact, near = set(), set()
        for at, j, no, w, mine in occurrences:
            if j != i:
                continue
            earlier = [v for a, k, _, v, other in occurrences if a < at]
            if any(v == w for v in earlier):
                exact.add(no)
            elif any(max(len(v), len(w)) >= near_from and lines.one_edit(v, w) for v in earlier):
                near.add(no)
        pieces = [] if text is None else text.split("\n")
        kept = None if text is None else "\n".join(p for n, p in enumerate(pieces) if n not in exact | near)
        out.append((doc_id, len(pieces), len(exact), len(near), kept))
    return sorted(out, key=repr)


def found(documents, *limits):
    rows = lines.dedup_lines(documents, *limits).collect()
    return sorted(((r["doc_id"], r["_n_lines"], r["_n_exact"], r["_n_near"], r["text"]) for r in rows), key=repr)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(2, 16))] for _ in range(25)]
    rows = []
    for i in range(n):
        some = []
        for _ in range(rng.randrange(6)):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w) + 1)
                what = rng.randrange(4)
                if what == 0:
                    w.insert(at, rng.choice("xyz"))
                elif what == 1 and at < len(w):
                    w.pop(at)
                elif what == 2 and at < len(w):
                    w[at] = rng.choice("xyz")
            some.append((" " if rng.random() < 0.8 else "\t ").join(w))
        rows.append((i, "\n".join(some)))
    return rows


def test_equals_brute_force(make_documents):
    rows = random_rows(5) + [(1_000, None), (1_001, ""), (None, "a b c d e\n\nf")]
    assert found(make_documents(rows)) == brute(rows)


def test_hard_texts(make_documents, hard_texts):
    assert found(make_documents(hard_texts)) == brute(hard_texts)


def test_stage_form(make_documents):
    rows = [(1, "one two three four five"), (2, "one two three four five"), (3, ""), (4, None), (5, "x\none two three four five")]
    df = make_documents(rows)
    kept = {r["doc_id"]: r for r in lines.without_repeated_lines(df).collect()}
    assert sorted(kept) == [1, 3, 4, 5] and kept[5]["text"] == "x" and kept[5]["n_chars"] == 1
    assert lines.without_repeated_lines(df).columns == df.columns
    assert lines.without_repeated_lines(make_documents([])).count() == 0


def test_limits_equal_brute_force(make_documents):
    rows = random_rows(11, 40)
    for limits in ((1, 6), (2, 12), (7, 7)):
        assert found(make_documents(rows), *limits) == brute(rows, *limits), limits


def test_very_many_lines(make_documents):
    """One text of 30,000 lines, half of them repeated in it."""
    many = "\n".join(f"line number {i % 15_000} of this text" for i in range(30_000))
    row = lines.dedup_lines(make_documents([(1, many), (2, "a b c d e")])).where("doc_id = 1").first()
    assert (row["_n_lines"], row["_n_exact"], row["_n_near"]) == (30_000, 15_000, 0)
    assert row["text"] == "\n".join(many.split("\n")[:15_000])


def test_one_template(make_documents):
    """Thousands of lines that differ in one word share their keys; all but the first go."""
    rows = [(i, f"all of these lines are the same but for word{i} that stands in the middle") for i in range(3_000)]
    kept = lines.without_repeated_lines(make_documents(rows)).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_clashing_names(make_documents):
    rows = [(1, "one two three four five"), (2, "one two three four five\nsix"), (3, None)]
    names = ("_id", "_th", "_exact", "_near", "_n_lines", "_n_exact", "_N_NEAR", "__id")
    df = make_documents(rows, extra=False).selectExpr("*", *(f"'mine' as {name}" for name in names))
    kept = {r["doc_id"]: r for r in lines.without_repeated_lines(df).collect()}
    assert sorted(kept) == [1, 2, 3] and kept[2]["text"] == "six"
    assert all(r[name] == "mine" for r in kept.values() for name in names)
