"""Attribution against a loop over tokens and sections."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearfield.llm import token_counts as tc
from nearfield.llm.tokens import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def loop(spans, sections, rule):
    counts, crossing, outside = [0.0] * len(sections), [0] * len(sections), 0
    for a, b in spans:
        common = [max(0, min(b, e) - max(a, s)) for s, e in sections]
        for i, n in enumerate(common):
            crossing[i] += 0 < n < b - a
            if rule == "share":
                counts[i] += n / (b - a)
        if rule == "largest" and any(common):
            counts[common.index(max(common))] += 1
        elif rule == "start":
            inside = [i for i, (s, e) in enumerate(sections) if s <= a < e]
            if inside:
                counts[inside[0]] += 1
            else:
                outside += 1
                continue
        if not any(common):
            outside += 1
    return counts, crossing, outside


@pytest.mark.parametrize("rule", tc.RULES)
def test_attribute(rule):
    rng = random.Random(2)
    for _ in range(200):
        at, spans = 0, []
        for _ in range(rng.randrange(30)):
            at += rng.randrange(2)
            spans.append((at, at + rng.randrange(1, 6)))
            at = spans[-1][1]
        cuts = sorted(rng.sample(range(at + 8), 6))
        sections = list(zip(cuts[::2], cuts[1::2]))
        got = tc.attribute(np.array(spans, int).reshape(-1, 2), np.array(cuts[::2]), np.array(cuts[1::2]), rule)
        want = loop(spans, sections, rule)
        assert np.allclose(got[0], want[0]) and got[1].tolist() == want[1] and got[2] == want[2]


def test_whole_texts(make_documents, hard_texts):
    df = make_documents(hard_texts).withColumn("sections", tc.layout_sections(F.coalesce("text", F.lit("")), 7))
    plain, seen = Tokenizer.from_file(PATH), 0
    whole: dict = {}
    for r in tc.token_counts(df, PATH).collect():
        assert r["outside"] == 0
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["n_tokens"]
        seen += r["n_crossing"]
    want: dict = {}
    for doc_id, text in hard_texts:
        want[doc_id] = want.get(doc_id, 0) + len(plain.encode(text or "", add_special_tokens=False).ids)
    assert whole == want and seen > 0


def test_without_sections_and_rules(make_documents):
    df = make_documents([(1, "a b c"), (2, None)]).withColumn("sections", F.expr("cast(null as array<struct<start: bigint, end: bigint>>)"))
    got = {r["doc_id"]: r for r in tc.token_counts(df, PATH).collect()}
    assert got[1]["section"] == -1 and got[1]["outside"] == 3 and got[2]["doc_tokens"] == 0
    assert tc.token_counts(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        tc.token_counts(df, PATH, "half")
