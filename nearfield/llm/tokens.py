"""Token ids and spans of whole texts, inside tasks.

The word-level tokenizer drops white space and never merges across it, so a text is cut at
blanks and line ends, every different piece is encoded once per task, and a text's ids
are looked up. Ids and spans equal those of encoding the whole text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Pieces remembered by a task before it starts anew, and pieces of texts held at a time.
MEMO_PIECES = 500_000
HELD_PIECES = 250_000
ENCODE_AT_ONCE = 4096

_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, spans: bool = False) -> ChunkEncoder:
    """The worker's encoder. It is loaded once; what it learns from texts goes with the task
    (``forget``), since workers live on and their memory is the executor's."""
    if (path, spans) not in _encoders:
        _encoders[path, spans] = ChunkEncoder(path, spans)
    return _encoders[path, spans]


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: printable ones for
    themselves, the others in order from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def is_plain(piece: str) -> bool:
    """A single lower-case word of Latin letters, which normalizing and cutting leave as
    it is, so that the model alone gives its ids."""
    if piece.isascii():
        return piece.isalpha() and piece.islower()
    return piece.isalpha() and max(piece) < "\u0180" and piece == piece.lower()


def stands_apart(word: str) -> bool:
    """Only letters, also as the tokenizer normalizes them, so that closing marks are no
    part of the word's last token. (A capital dotted I ends in a mark, which is not.)"""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


#: ASCII marks that make one run. An apostrophe may begin an ending such as 's.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def ending(piece: str) -> int:
    """Where the closing marks of a word begin; 0 if the piece is not a word and its marks."""
    word = piece.rstrip(MARKS)
    return len(word) if len(word) < len(piece) and stands_apart(word) else 0


class _Pieces(dict):
    """Numbers of pieces; new ones wait in ``new`` until they are encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        i = self[piece] = len(self)
        self.new.append(piece)
        return i


class ChunkEncoder:
    """Encodes texts by their remembered pieces. Only for tokenizers that lower-case and
    whose pieces between blanks are independent (``word_bpe_49k.json``)."""

    def __init__(self, path: str, spans: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.spans = spans
        self._clear()

    def _clear(self) -> None:
        self.memo = _Pieces()
        self.pool = np.zeros(1 << 16, np.uint32)
        self.pool_span = np.zeros((1 << 16, 2), np.int32) if self.spans else None
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.used = 0

    def forget(self) -> None:
        """Drop all pieces and give their memory back."""
        self._clear()
        pa.default_memory_pool().release_unused()

    def _store(self, which: np.ndarray, count: np.ndarray, ids: np.ndarray, offsets: np.ndarray | None) -> None:
        """Append the tokens of pieces to the pool."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            if self.spans:
                self.pool_span = np.concatenate([self.pool_span, np.zeros_like(self.pool_span)])
        while len(self.memo) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.count[which] = count
        self.first[which] = self.used + np.cumsum(count) - count
        self.pool[self.used : self.used + len(ids)] = ids
        if self.spans:
            self.pool_span[self.used : self.used + len(ids)] = offsets
        self.used += len(ids)

    def _learn(self) -> None:
        """Encode the waiting pieces. A word with closing marks is its word and those marks,
        which are separate in every text. Ids are laid end to end at once: lists of tokens
        kept by piece cost more than the model."""
        encode = self.tokenizer.encode_batch if self.spans else self.tokenizer.encode_batch_fast
        tokenize, memo, at = self.model.tokenize, self.memo, 0
        ended: list[int] = []
        while at < len(memo.new):
            names, numbers, plain_numbers, count, flat, offsets = [], [], [], [], [], []
            while at < len(memo.new) and len(names) + len(plain_numbers) < ENCODE_AT_ONCE:
                piece = memo.new[at]
                at += 1
                ascii_only = piece.isascii()
                if is_plain(piece) and (ascii_only or not self.spans):
                    tokens = tokenize(piece if ascii_only else piece.encode().decode("latin-1").translate(self.letters))
                    plain_numbers.append(memo[piece])
                    count.append(len(tokens))
                    flat += [t.id for t in tokens]
                    if self.spans:
                        offsets += [t.offsets for t in tokens]
                elif size := ending(piece):
                    ended += memo[piece], memo[piece[:size]], memo[piece[size:]], size
                else:
                    names.append(piece)
                    numbers.append(memo[piece])
            for found in encode(names, add_special_tokens=False) if names else []:
                ids = found.ids
                count.append(len(ids))
                flat += ids
                if self.spans:
                    offsets += found.offsets
            spans = np.array(offsets, np.int32).reshape(-1, 2) if self.spans else None
            self._store(np.array(plain_numbers + numbers, np.int64), np.array(count, np.int64), np.array(flat, np.uint32), spans)
        memo.new = []
        if ended:
            whole, word, mark, size = np.array(ended, np.int64).reshape(-1, 4).T
            pair = np.stack([word, mark], 1).ravel()
            count = self.count[pair]
            ends = np.cumsum(count)
            at = np.arange(int(ends[-1])) + np.repeat(self.first[pair] - (ends - count), count)
            spans = None
            if self.spans:
                shift = np.stack([np.zeros_like(size), size], 1).ravel()
                spans = self.pool_span[at] + np.repeat(shift, count)[:, None]
            self._store(whole, count.reshape(-1, 2).sum(1), self.pool[at], spans)

    def _looked_up(self, column: pa.Array) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Texts, the piece numbers of all of them, and how many pieces each has."""
        texts, which, sizes, held = [], [], [], 0
        for value in column:
            if len(self.memo) >= MEMO_PIECES and not texts:
                self._clear()
            text = value.as_py() or ""
            # A special token's string counts as written, so such a text keeps its case.
            low = text if "<|" in text else text.encode().lower().decode()
            cut = low.replace("\n", " ").split(" ")
            texts.append(text)
            which.append(np.fromiter(map(self.memo.__getitem__, cut), np.int64, len(cut)))
            sizes.append(len(cut))
            held += len(cut)
            if held >= HELD_PIECES:
                self._learn()
                yield texts, np.concatenate(which), np.array(sizes)
                texts, which, sizes, held = [], [], [], 0
        if texts:
            self._learn()
            yield texts, np.concatenate(which), np.array(sizes)

    def _gather(self, which: np.ndarray, sizes: np.ndarray):
        """Pool positions of all tokens, the tokens of each piece, and where texts end."""
        count = self.count[which]
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1])) + np.repeat(self.first[which] - (ends - count), count)
        return at, count, ends[np.cumsum(sizes) - 1]

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Token ids of each text; a null counts as empty."""
        for texts, which, sizes in self._looked_up(column):
            at, _, ends = self._gather(which, sizes)
            ids = self.pool[at]
            for start, end in zip([0, *ends[:-1]], ends):
                yield ids[start:end]

    def offsets(self, column: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
        """Each text with the (start, end) code points of its tokens."""
        for texts, which, sizes in self._looked_up(column):
            at, count, ends = self._gather(which, sizes)
            spans = self.pool_span[at]
            done, piece = 0, 0
            for text, n, end in zip(texts, sizes, ends):
                cut = text.replace("\n", " ").split(" ")
                width = np.fromiter(map(len, cut), np.int64, n) + 1
                starts = np.cumsum(width) - width
                yield text, spans[done:end] + np.repeat(starts, count[piece : piece + n])[:, None]
                done, piece = end, piece + n
