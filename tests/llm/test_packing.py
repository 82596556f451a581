"""Tokens against the tokenizer, packing as an exact round trip."""

import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from nearfield.llm import packing
from nearfield.llm.tokens import ChunkEncoder, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["á b", "x  y\tz\n\nq <|endoftext|> it's DON'T", "İstanbul ΣΑΣ", "", "e ́x", "a@b. c,. d., é. É, Word. ½ ① 12345 \x85\xa0 z", "ß. ŉ Ǆ क़ क़. ﬁn", None, "<|STARTOFTEXT|> HELLO"]


def test_ids_and_spans_equal_whole_encoding(hard_texts):
    texts = ODD + [t for _, t in hard_texts]
    column, plain = pa.array(texts), Tokenizer.from_file(PATH)
    known, spans = ChunkEncoder(PATH), ChunkEncoder(PATH, True)
    for _ in range(2):  # with an empty memo and with a full one
        for text, ids, (_, offsets) in zip(texts, known.ids(column), spans.offsets(column)):
            want = plain.encode(text or "", add_special_tokens=False)
            assert ids.tolist() == want.ids
            assert list(map(tuple, offsets.tolist())) == want.offsets


def test_any_letters_before_a_stop_equal_whole_encoding():
    rng = random.Random(11)
    letters = "aBéİıßǅﬁΣςÅ\u0345\u0307कि漢가ـ.,'-"
    texts = ["İ.", "Aİ.", "aİ, bİ.", "İİ.,"] + [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) + rng.choice([".", ",", ""]) for _ in range(6)) for _ in range(4000)]
    plain, known, spans = Tokenizer.from_file(PATH), ChunkEncoder(PATH), ChunkEncoder(PATH, True)
    column = pa.array(texts)
    for text, ids, (_, offsets) in zip(texts, known.ids(column), spans.offsets(column)):
        want = plain.encode(text, add_special_tokens=False)
        assert ids.tolist() == want.ids and list(map(tuple, offsets.tolist())) == want.offsets, text


def test_words_with_any_closing_marks_equal_whole_encoding():
    rng = random.Random(12)
    letters, marks = "abéİßςΣक\u0307", [".", ",", "!!", "%%%", "&", "<|", "|>", "=>", "'", ".'", "'s", "…", "\u0338"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) + "".join(rng.choice(marks) for _ in range(rng.randrange(4))) for _ in range(6000)]
    texts = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
    plain, known, spans = Tokenizer.from_file(PATH), ChunkEncoder(PATH), ChunkEncoder(PATH, True)
    column = pa.array(texts)
    for text, ids, (_, offsets) in zip(texts, known.ids(column), spans.offsets(column)):
        want = plain.encode(text, add_special_tokens=False)
        assert ids.tolist() == want.ids and list(map(tuple, offsets.tolist())) == want.offsets, text


def test_marks_after_a_word_need_no_whole_encoding():
    """Words and their closing marks are learned apart: each word once, each run of marks once."""

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.seen = tokenizer, []

        def encode_batch_fast(self, names, **options):
            self.seen += names
            return self.tokenizer.encode_batch_fast(names, **options)

    known = ChunkEncoder(PATH)
    known.tokenizer = counting = Counting(known.tokenizer)
    texts = [" ".join(f"{word}{mark}" for word in ("one", "deux", "étré", "fünf") for mark in ("!!", "%%%", ".", ",###", ""))]
    ids = next(known.ids(pa.array(texts)))
    assert ids.tolist() == counting.tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert sorted(counting.seen) == ["!!", "%%%", ",###", "."]


def check(rows, texts, capacity):
    plain = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in texts:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.append((doc_id, k, a, len(part), zlib.crc32(part.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(w[3] for w in want)


def test_pack_round_trip(make_documents, hard_texts, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)  # ranks over many hash parts
    texts = hard_texts + [(100 + i, "word " * (i % 37)) for i in range(150)]
    rows = packing.pack(make_documents(texts), PATH, 64).collect()
    bins, total = check(rows, texts, 64)
    assert bins <= total / 64 * 1.05 + 1


def test_empty_table(make_documents):
    assert packing.pack(make_documents([]), PATH).count() == 0


def test_two_fit_replaces_the_smallest():
    """6 + 3 leaves a gap of 1; 2 + 2 in the place of 3 closes it."""
    counts = np.zeros(11, int)
    counts[[6, 3, 2]] = 1, 1, 2
    assert packing.plan(counts, 10)[0] == ([6, 2, 2], 1)


def test_plan_packs_everything_close_to_the_bound():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.geometric(1 / 90, 20_000), 512)
    counts = np.bincount(lengths, minlength=513)
    plan = packing.plan(counts, 512)
    used = np.zeros(513, int)
    for pattern, times in plan:
        assert sum(pattern) <= 512
        np.add.at(used, pattern, times)
    assert (used == counts).all()
    assert sum(t for _, t in plan) <= -(-lengths.sum() // 512) * 1.005 + 1
