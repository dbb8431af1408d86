"""Token counts by rank-synchronous array merging.

A text becomes pre-tokens (by the tokenizer's own normalisation and split), and
the distinct pre-tokens of a batch become one ragged array of symbols. In each
round every sequence looks up the rank of all its neighbouring pairs, and merges
all occurrences of its own lowest-ranked pair, all sequences at once. Sequences
without a mergeable pair leave the array with their number of symbols. Counts of
blank-separated pieces stay in a bounded dictionary of the worker.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .session import small_batches

LIMIT = 2048
#: Pieces whose counts a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 400_000, 64
#: Symbols that are merged at a time.
ARRAY = 1 << 20


#: Capitals whose small letters the library knows and Python's tables don't yet.
_NEWER = {"\ua7cb": "\u0264", "\ua7dc": "\u019b"}


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for code points from 256 on
    in order of the byte.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class RankMerger:
    """Counts the symbols that are left of byte sequences when no pair can merge any more."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [x["content"] for x in model["added_tokens"]]
        model = model["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        assert len(set(merged.tolist())) == len(merged), "each symbol comes from one merge: all occurrences of a pair merge alike"
        # open-addressing hash table of pair -> rank
        self.bits = int(len(pairs) * 4).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, len(pairs), np.int32)
        self.none, self.merged = len(pairs), merged
        for rank, key in enumerate((left * self.size + right).tolist()):
            at = self._slot(key)
            while self.keys[at] >= 0:
                at = (at + 1) & (len(self.keys) - 1)
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        with np.errstate(over="ignore"):
            at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), self.none, np.int32)
        left_to_find = np.arange(len(key))
        while len(left_to_find):
            found = self.keys[at]
            hit = found == key[left_to_find]
            out[left_to_find[hit]] = self.ranks[at[hit]]
            on = ~hit & (found >= 0)
            left_to_find, at = left_to_find[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols of each word; words are not empty."""
        out = np.ones(len(words), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        many = np.flatnonzero(sizes > 1)
        begin = 0
        while begin < len(many):
            total = np.cumsum(sizes[many[begin:]])
            stop = begin + max(1, int(np.searchsorted(total, ARRAY, side="right")))
            part = many[begin:stop]
            out[part] = self._merge([words[k] for k in part], sizes[part])
            begin = stop
        return out

    def _merge(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done = np.empty(len(words), np.int64)
        # the rank of (symbol, next symbol); a word's last symbol has no next one
        ranks = np.full(len(symbols), self.none, np.int32)
        inside = word[:-1] == word[1:]
        ranks[:-1][inside] = self.rank(symbols[:-1][inside], symbols[1:][inside])
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(ranks, starts)
            over = least == self.none
            if over.any():
                done[word[starts[over]]] = lengths[over]
                stay = np.repeat(~over, lengths)
                symbols, word, ranks = symbols[stay], word[stay], ranks[stay]
                if not len(symbols):
                    break
                least, lengths = least[~over], lengths[~over]
            hit = ranks == np.repeat(least, lengths)
            # of overlapping occurrences (a a a), every second of the run from its start
            again = np.append(False, hit[:-1] & hit[1:])
            if again.any():
                at = np.arange(len(hit))
                first = np.maximum.accumulate(np.where(hit & ~again, at, 0))
                hit &= (at - first) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.merged[ranks[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            # the neighbour before may itself have been swallowed: then the one before that
            before = at[at > 1]
            changed[before[~stay[before - 1]] - 2] = True
            symbols, word, changed, ranks = symbols[stay], word[stay], changed[stay], ranks[stay]
            at = np.flatnonzero(changed)
            ranks[at] = self.none
            at = at[at + 1 < len(symbols)]
            at = at[word[at] == word[at + 1]]
            ranks[at] = self.rank(symbols[at], symbols[at + 1])
        return done


class TokenCounter:
    """The number of tokens of whole texts: normalise, split, merge, count."""

    #: Fixed values of the vocabulary file's normaliser and splitter.
    SPACE = regex.compile(r"\s+")
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str) -> None:
        self.merger = RankMerger(path)
        self.special = regex.compile("|".join(map(regex.escape, self.merger.special)))
        self.known: dict[str, int] = {}

    @staticmethod
    def _plain(text: str) -> list[str]:
        """Normalised text cut at blanks and line ends, which no pre-token crosses."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            for capital, small in _NEWER.items():
                text = text.replace(capital, small)
        return text.lower().replace("\n", " ").split(" ")

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """(special tokens, pieces of the rest) of a text."""
        if "<|" not in text:
            return 0, self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1, [w for p in parts for w in self._plain(p)]

    def _learn(self, pieces: list[str]) -> None:
        """Count the pre-tokens of new pieces, each distinct one once."""
        split = [self.SPLIT.findall(p) for p in pieces]
        words = list({w for s in split for w in s})
        counts = dict(zip(words, self.merger.counts([w.encode() for w in words]).tolist(), strict=True))
        self.known.update(zip(pieces, (sum(map(counts.__getitem__, s)) for s in split), strict=True))

    def __call__(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set().union(*(words for _, words in split)) - self.known.keys())
        self._learn(new)
        out = [special + sum(map(self.known.__getitem__, words)) for special, words in split]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return out


@lru_cache(1)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def _groups(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _count(path: str | None, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = _counter(path or public_tokenizers.path("word_bpe_49k.json"))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.array([c for g in _groups(texts) for c in counter(g)], np.int64)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.record_batch(
                [batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row, over whole texts.

    ``path`` is a byte-level BPE vocabulary with word ends (default: the public
    word vocabulary of 49,408 ids, found on each executor). No begin, end or added
    tokens are counted; a special token's string inside a text counts as that one
    token. A null text is an empty one and has no bytes and tokens. Repeated rows
    give repeated results, other columns are ignored, no rows give no rows.
    """
    small_batches(docs.sparkSession)
    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(
        _count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
