"""Counts of the packed big integers against running every order over every document."""

import random
import re
from itertools import permutations

from nearfield.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """The filters each row fails, one by one."""
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    out = []
    for i, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            bad.add("C")
        if re.search(r"[#$%&*|]", text):
            bad.add("D")
        if i is not None and i > least[text]:
            bad.add("E")
        out.append(bad)
    return out


def plain(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    out, bad = {}, fails(rows)
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], b) for r, b in zip(rows, bad) if (r[2] or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order):
                lost = [(i, b) for i, b in left if f in b]
                gone = len([1 for _, b in mine if f in b]) - len(lost)
                left = [(i, b) for i, b in left if f not in b]
                share[f] += len(lost)
                out[part, "".join(order), step + 1] = [
                    len(left), len(lost), gone, sum(b == {f} for _, b in mine), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost), f,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = share[row[-1]]
    return out


def found(spark, rows, labels, extra=True):
    df = spark.createDataFrame([(r[0], r[1], r[2], "s") for r in rows], "doc_id long, text string, lang string, source string")
    of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    if extra:  # names that the operator uses itself
        df = df.selectExpr("*", "1 as part", "2 as mask", "3 as h1", "4 as n", "5 as good", "true as toxic", "7 as quality")
        of = of.selectExpr("*", "1 as good", "2 as lang", "3 as part", "4 as text")
    got = filter_audit.audit_filters(df, of).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got}, got


def sample(seed, n):
    rng = random.Random(seed)
    pool = []
    for _ in range(25):
        words = ["".join(rng.choice("abcDEé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.choice([3, 40, 400]))]
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 150, 199, 200, 201, 320])))
        pool.append(text + rng.choice(["", "", " #", " a|b"]) if rng.random() < 0.9 else text.lower())
    rows = [(rng.randrange(n), rng.choice(pool), rng.choice(["en", "de", None, ""])) for _ in range(n)]
    return rows + [(None, pool[0], "en"), (None, None, "en"), (1, None, "de"), (2, "", None), (2, "", None), (3, "A b " * 30_000, "fr")]


def test_equals_running_every_order(spark, hard_texts):
    rows = sample(4, 160) + [(i, t, "xx") for i, t in hard_texts]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 150, 2)] + [(4, None, None), (6, 1, 1), (6, 0, 0), (9999, 1, 1)]
    got, raw = found(spark, rows, labels)
    assert got == plain(rows, labels)
    assert len(raw) == len(got) == 600 * len({r[2] or "" for r in rows})


def test_a_text_that_most_rows_share(spark):
    rows = [(i, "the same text", "en" if i % 2 else "de") for i in range(400)] + [(i, f"text {i}", "en") for i in range(400, 500)]
    got, _ = found(spark, rows, [(0, 1, 0)])
    assert got == plain(rows, [(0, 1, 0)])
    assert got["de", "EABCD", 1][1] == 199 and got["en", "EABCD", 1][1] == 200


def test_no_documents_no_labels(spark):
    assert found(spark, [], [])[1] == []
    rows = [(1, "a", "en")]
    assert found(spark, rows, [])[0] == plain(rows, [])


def test_fields_never_overflow():
    """Every field of a sum holds its exact count, at the largest counts a field can take."""
    for n in (1, 2**31, 2**62):
        masks = list(range(32))
        rows = filter_audit.part_audit("p", masks, [True] * 32, [False] * 32, [n] * 32)
        for _, order, step, f, kept, removed, redundant, alone, good, toxic, share in rows:
            assert kept == n * 2 ** (5 - step) and removed == good == n * 2 ** (5 - step) and redundant == n * 16 - removed
            assert (alone, toxic) == (n, 0) and share == n * sum(24 * 2 ** (4 - i) for i in range(5))
