"""Pieces by vectorised merge rounds, and back again.

A text becomes words (a run of blanks and what follows it), the distinct new words
of a batch become one flat array of symbols. In each round every word looks for the
least rank among its neighbouring pairs, all leftmost occurrences of it merge at
once, and the array is compacted, until no pair is left. Characters without a piece
become the pieces of their bytes. Ids of words stay in a bounded dictionary of the
worker.

Equal texts may come from several pairs (``a bc``, ``ab c``), and a merged piece may
begin a pair of a better rank than its own. So the order matters: where an
occurrence makes a pair that is as good or better, the occurrences after it in its
word wait for the next round. This gives what merging one by one gives.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .session import small_batches

#: Words that a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 400_000, 64
#: Symbols that are merged at a time.
ARRAY = 1 << 20
#: From so many symbols on, a word's rounds look up the places of a rank instead of scanning the word.
SCANNED = 1 << 14
#: Fixed value: stands for a blank in pieces.
BLANK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceModel:
    """Encodes and decodes as the model file's library does: begin and end ids, no sampling."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as layout

        model = layout.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        rule, trainer = model.normalizer_spec, model.trainer_spec
        plain = rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces and not rule.precompiled_charsmap
        if not (plain and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix and kinds == {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError("only models with byte fallback, a blank before the text and no other normalisation are known")
        self.begin, self.end = trainer.bos_id, trainer.eos_id
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(not re.fullmatch(f"{BLANK}*[^{BLANK}]*", p) for p in self.ids) or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("pieces have to keep within words, and to consist of characters that are pieces")
        self.bytes = np.array([i for i, p in enumerate(model.pieces) if p.type == BYTE], np.int32)
        scores = np.array([p.score for p in model.pieces], np.float32)
        _, ranks = np.unique(-scores, return_inverse=True)
        self._pairs(ranks.astype(np.int32), len(model.pieces))
        # decoding
        names = [p.piece for p in model.pieces]
        self.is_byte = np.zeros(len(names), bool)
        self.is_byte[self.bytes] = True
        self.is_control = np.array([p.type == CONTROL for p in model.pieces])
        self.blank_first = np.array([p.type == NORMAL and p.piece.startswith(BLANK) for p in model.pieces])
        byte = dict(zip(self.bytes.tolist(), range(256), strict=True))
        unknown = model.trainer_spec.unk_surface.encode()
        self.surface = [
            bytes([byte[i]]) if i in byte else b"" if self.is_control[i] else unknown if p.type == UNKNOWN else names[i].replace(BLANK, " ").encode() for i, p in enumerate(model.pieces)
        ]

    def _pairs(self, ranks: np.ndarray, n: int) -> None:
        """The table of pairs that merge, the characters, and the neighbours that any piece has."""
        ids = self.ids
        pairs = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.n, self.none = n, np.int32(n)
        order = np.argsort(left * n + right)
        self.keys = np.append((left * n + right)[order], np.int64(1) << 62)
        self.rank_of = np.append(ranks[merged][order], self.none).astype(np.int32)
        self.merged_of = np.append(merged[order], -1).astype(np.int32)
        # pieces that stand in a longer piece, at one end of it, of a rank as good
        self.hasty = np.zeros(n, bool)
        for part in (left, right):
            self.hasty[part[ranks[merged] <= ranks[part]]] = True
        neighbours = {(ids[a], ids[b]) for p in ids for a, b in zip(p, p[1:], strict=False)}
        self.close = np.unique(np.array([a * n + b for a, b in neighbours], np.int64))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of each pair; rank ``none`` where they don't merge."""
        key = left.astype(np.int64) * self.n + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.rank_of[at], self.none), self.merged_of[at]

    # -- encoding ----------------------------------------------------------

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, word of each, whether it starts a stretch that no piece crosses)."""
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        unique, at = np.unique(points, return_inverse=True)
        known = [self.ids.get(chr(c), -1) for c in unique.tolist()]
        table = np.array(known, np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols = table[at]
        if (table < 0).any():  # characters without a piece: their bytes
            sizes = np.array([1 if k >= 0 else len(chr(c).encode()) for k, c in zip(known, unique.tolist(), strict=True)])
            odd = np.flatnonzero(table < 0)
            spelt = {int(u): self.bytes[list(chr(int(unique[u])).encode())] for u in odd}
            n = sizes[at]
            ends = np.cumsum(n)
            out = np.repeat(symbols, n)
            for u, b in spelt.items():
                places = (ends - n)[at == u]
                for k, piece in enumerate(b.tolist()):
                    out[places + k] = piece
            symbols, word = out, np.repeat(word, n)
        start = np.ones(len(symbols), bool)
        key = symbols[:-1] * self.n + symbols[1:]
        at = np.minimum(np.searchsorted(self.close, key), len(self.close) - 1)
        start[1:] = (word[1:] != word[:-1]) | (self.close[at] != key)
        return symbols.astype(np.int32), word, start

    def _waiting(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray, after: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Which of the occurrences ``at`` have to wait.

        ``owner`` tells the word of each symbol, ``after`` where the symbol behind the
        pair stands (or -1). An occurrence sees those before it merged, those behind not.
        """
        wait = np.zeros(len(at), bool)
        several = owner[at[1:]] == owner[at[:-1]] if len(at) > 1 else np.zeros(0, bool)
        look = self.hasty[made] & np.append(several, False)  # the last of a word holds up none
        k = np.flatnonzero(look)
        if not len(k):
            return wait
        better = np.zeros(len(k), bool)
        behind = after[k]
        has = behind >= 0
        better[has] = self.find(made[k][has], symbols[behind[has]])[0] <= ranks[k][has]
        before = at[k] - 1
        has = (before >= 0) & (owner[np.maximum(before, 0)] == owner[at[k]])
        joined = (k > 0) & (after[np.maximum(k - 1, 0)] == at[k])
        left = np.where(joined, made[np.maximum(k - 1, 0)], symbols[np.maximum(before, 0)])
        better[has] |= self.find(left[has], made[k][has])[0] <= ranks[k][has]
        stops = np.zeros(len(at) + 1, np.int64)
        stops[k[better] + 1] = 1
        stops = np.cumsum(stops)[:-1]  # stops before each occurrence
        first = np.flatnonzero(np.append(True, owner[at[1:]] != owner[at[:-1]]))
        return stops > np.repeat(stops[first], np.diff(np.append(first, len(at))))

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words when nothing merges any more, and the word of each."""
        out, of = [], []
        ranks, made = np.full(len(symbols), self.none, np.int32), np.zeros(len(symbols), np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        ranks[inside], made[inside] = self.find(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(ranks, starts)
            over = least == self.none
            if over.any():
                gone = np.repeat(over, lengths)
                out.append(symbols[gone])
                of.append(word[gone])
                symbols, word, ranks, made = symbols[~gone], word[~gone], ranks[~gone], made[~gone]
                if not len(symbols):
                    break
                least, lengths = least[~over], lengths[~over]
            hit = ranks == np.repeat(least, lengths)
            at = np.flatnonzero(hit)
            at = at[leftmost(at[1:] == at[:-1] + 1)]
            after = np.where((at + 2 < len(word)) & (word[np.minimum(at + 2, len(word) - 1)] == word[at]), at + 2, -1)
            at = at[~self._waiting(symbols, word, at, after, ranks[at], made[at])]
            symbols[at] = made[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            before = at[at > 0] - 1
            changed[np.where(stay[before], before, before - 1)] = True  # the one before may itself be swallowed
            symbols, word, changed, ranks, made = symbols[stay], word[stay], changed[stay], ranks[stay], made[stay]
            at = np.flatnonzero(changed)
            ranks[at] = self.none
            at = at[at + 1 < len(symbols)]
            at = at[word[at] == word[at + 1]]
            ranks[at], made[at] = self.find(symbols[at], symbols[at + 1])
        symbols, word = np.concatenate(out), np.concatenate(of)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _long(self, symbols: np.ndarray) -> np.ndarray:
        """The same rounds for one long word; the places of each rank are kept instead of sought."""
        n = len(symbols)
        symbols, one = symbols.copy(), np.zeros(n, np.int8)
        following = np.append(np.arange(1, n), -1)
        leading = np.arange(-1, n - 1)
        ranks, made = np.full(n, self.none, np.int32), np.zeros(n, np.int32)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[ranks[at] < self.none]
            at = at[np.argsort(ranks[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(ranks[at])) + 1):
                if len(part):
                    rank = int(ranks[part[0]])
                    if rank not in places:
                        heapq.heappush(queue, rank)
                    places.setdefault(rank, []).append(part)

        ranks[:-1], made[:-1] = self.find(symbols[:-1], symbols[1:])
        put(np.arange(n))
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[ranks[at] == rank]
            if not len(at):
                continue
            at = at[leftmost(following[at[:-1]] == at[1:])]
            # the symbols around each occurrence, side by side, for the rule of who waits
            second = following[at]
            after = following[second]
            row = np.stack([np.where(leading[at] >= 0, symbols[leading[at]], -1), symbols[at], symbols[second], np.where(after >= 0, symbols[after], -1)])
            wait = self._waiting_long(row, at, leading, after, ranks[at], made[at]) if len(at) > 1 else np.zeros(1, bool)
            if wait.any():
                places[rank] = [at[wait]]
                heapq.heappush(queue, rank)
                at = at[~wait]
                second, after = second[~wait], after[~wait]
            symbols[at] = made[at]
            ranks[second] = self.none
            one[second] = 1
            following[at] = after
            leading[after[after >= 0]] = at[after >= 0]
            changed = np.unique(np.concatenate([at, leading[at][leading[at] >= 0]]))
            ranks[changed] = self.none
            changed = changed[following[changed] >= 0]
            ranks[changed], made[changed] = self.find(symbols[changed], symbols[following[changed]])
            put(changed)
        return symbols[one == 0]

    def _waiting_long(self, row: np.ndarray, at: np.ndarray, leading: np.ndarray, after: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> np.ndarray:
        """As ``_waiting``, for occurrences of one word whose symbols are linked."""
        joined = np.append(False, after[:-1] == at[1:])
        left = np.where(joined, np.append(-1, made[:-1]), row[0])
        better = np.zeros(len(at), bool)
        for a, b in ((left, made), (made, row[3])):
            has = (a >= 0) & (b >= 0) & self.hasty[made]
            better[has] |= self.find(a[has], b[has])[0] <= ranks[has]
        return np.append(False, np.cumsum(better)[:-1] > 0)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word (with its blanks as ``BLANK``), as little-endian 32-bit integers."""
        out: list[bytes] = []
        begin = 0
        while begin < len(words):
            stop, size = begin, 0
            while stop < len(words) and (size < ARRAY or stop == begin):
                size += len(words[stop])
                stop += 1
            symbols, word, start = self.symbols(words[begin:stop])
            if len(symbols):
                stretch = np.cumsum(start) - 1
                bounds = np.append(np.flatnonzero(start), len(symbols))
                long = np.flatnonzero(np.diff(bounds) > SCANNED)
                owner = word[bounds[:-1]]  # the word of each stretch
                parts, of = [], []
                short = np.ones(len(symbols), bool)
                for s in long.tolist():
                    short[bounds[s] : bounds[s + 1]] = False
                    parts.append(self._long(symbols[bounds[s] : bounds[s + 1]]))
                    of.append(np.full(len(parts[-1]), s))
                if short.any():
                    a, b = self._rounds(symbols[short], stretch[short])
                    parts.append(a)
                    of.append(b)
                ids, of = np.concatenate(parts), np.concatenate(of)
                order = np.argsort(of, kind="stable")
                ids, of = ids[order].astype("<u4"), owner[of[order]]
                cuts = np.searchsorted(of, np.arange(stop - begin + 1)) * 4
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            else:
                out += [b""] * (stop - begin)
            begin = stop
        return out

    # -- decoding ----------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids vanish, one blank before the text goes, bytes that aren't UTF-8 become U+FFFD each."""
        spelt = [self.surface[i] for i in ids.tolist()]
        plain = np.flatnonzero(~self.is_control[ids])
        if len(plain) and self.blank_first[ids[plain[0]]]:
            spelt[plain[0]] = spelt[plain[0]][1:]
        if not self.is_control[ids[1:-1]].any():  # one between bytes ends their run
            try:
                return b"".join(spelt).decode()
            except UnicodeDecodeError:
                pass
        return self._mended(ids, spelt)

    def _mended(self, ids: np.ndarray, spelt: list[bytes]) -> str:
        out, run = [], b""
        for byte, part in zip(self.is_byte[ids].tolist(), spelt, strict=True):
            if byte:
                run += part
                continue
            out += [_characters(run), part.decode()]
            run = b""
        return "".join([*out, _characters(run)])


def leftmost(touching: np.ndarray) -> np.ndarray:
    """Of occurrences of which some overlap with the one before, every second one of each run from its start."""
    again = np.append(False, touching)
    at = np.arange(len(again))
    first = np.maximum.accumulate(np.where(again, 0, at))
    return (at - first) % 2 == 0


def _characters(raw: bytes) -> str:
    """UTF-8, every byte that belongs to no character as U+FFFD."""
    out = []
    while raw:
        try:
            return "".join([*out, raw.decode()])
        except UnicodeDecodeError as e:
            out += [raw[: e.start].decode(), "\ufffd"]
            raw = raw[e.start + 1 :]
    return "".join(out)


class PieceCoder:
    """Whole texts to ids, by words that are remembered, and back."""

    #: A run of blanks and what follows, or what follows a line end.
    WORDS = re.compile(" +[^ \n]*|\n[^ \n]*")

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.known: dict[str, bytes] = {}
        # a line end without a piece of two characters or more ends a word
        self.lines = not any("\n" in p and len(p) > 1 for p in self.model.ids)
        self.ends = tuple(np.array([i], "<u4").tobytes() for i in (self.model.begin, self.model.end))

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + text.replace(BLANK, " ")
        if not self.lines:
            return re.findall(" +[^ ]*", text)
        return self.WORDS.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set().union(*split) - self.known.keys())
        self.known.update(zip(new, self.model.encode_words([w.replace(" ", BLANK) for w in new]), strict=True))
        begin, end = self.ends
        out = [b"".join([begin, *map(self.known.__getitem__, words), end]) for words in split]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return out

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4"))


@lru_cache(1)
def _coder(path: str) -> PieceCoder:
    return PieceCoder(path)


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


def _path(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("piece_bpe_32k.model")


def _round_trip(path: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(_path(path))
        for batch in batches:
            keys, done = batch.column(0), 0
            for group in _groups([t or "" for t in batch.column(1).to_pylist()]):
                ids = coder.encode(group)
                texts = [coder.decode(i) for i in ids]
                yield pa.record_batch([keys.slice(done, len(group)), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
                done += len(group)

    return run


def encode_and_decode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, ids, decoded`` of each row, over whole texts.

    ``ids`` are little-endian unsigned 32-bit integers with the begin and end id,
    ``decoded`` is the text that they give. ``path`` is a model file (default: the
    public one of 32,000 pieces, found on each executor). A null text is an empty one:
    it has the begin and end id and decodes to an empty text. Strings of special pieces
    inside a text are ordinary text. Repeated rows give repeated results, other columns
    are ignored, no rows give no rows.
    """
    small_batches(docs.sparkSession)
    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(_round_trip(path), "doc_id long, ids binary, decoded string")
