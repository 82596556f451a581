"""Repetition measures against a plain version."""

import random
import re

from nearfield.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            inside.update((i, i + 1, i + 2))
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_equals_plain(make_documents, hard_texts):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice(["a", "b", "cc", "é😀", "#", " ", " ", "\n", "\t", "|"]) for _ in range(rng.randrange(200)))) for i in range(120)]
    texts += [(200 + i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(50, 90)))) for i in range(60)]
    texts += [t for t in hard_texts if len(t[1] or "") < 60_000 and t[0] != 6]
    got = rules.quality_rules(make_documents(texts)).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r["doc_id"], *(r[c] for c in columns)) for r in got), key=repr) == sorted(((i, *plain(t)) for i, t in texts), key=repr)
    assert all(not (r["base_failed"] and r["kept"]) for r in got)


def test_verdicts(make_documents):
    clean = " ".join(f"w{i}" for i in range(200))
    copied = " ".join(f"w{i % 70}" for i in range(100)) + " " + " ".join(f"x{i}" for i in range(60))
    rows = [(1, clean), (2, copied), (3, clean + " ***" * 60), (4, "\n".join(["one two three four five six seven"] * 4) + "\n" + clean[:300])]
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(make_documents(rows)).collect()}
    assert got[1] and not got[2] and not got[3]
    assert rules.quality_rules(make_documents([])).count() == 0


def test_a_very_long_text():
    words = [f"w{i}" for i in range(300_000)] + ["a", "b", "c", "x", "a", "b", "c"]
    n, chars, _, _, repeat, failed, kept, *_ = rules.measure(" ".join(words).encode(), rules.Vocabulary())
    assert (n, repeat, failed, kept) == (300_007, 6, False, True)
