"""Benchmark decontamination by spaced seeds.

An overlap is a stretch of tokens with enough equal ones, whatever the others are. A
seed is a fixed mask of token positions: those between its marks are ignored, so that
a changed token there does no harm. The masks of an item's size are chosen so that
every overlap, wherever its changed tokens are, has a place where all marks of one of
them fall on equal tokens; no overlap is without a common seed. Seeds of test items,
hashed, are an index that every task gets in blocks of bounded size, and are joined
with the hashes of the training texts there. Around a hit, text and item are compared
token by token on the hit's diagonal, and of the stretches with a share of ``SHARE``
equal tokens the one with most of them is the overlap. Texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, WordHasher, alphanumeric, chunks, ngrams, string_buffers
from .session import materialize, small_batches

#: Equal tokens that an overlap needs (``SHARE`` of all that an item has, if that is fewer), and the share of equal ones.
OVERLAP, SHARE = 13, 0.8
#: Fixed values. Masks by the least number of tokens that an item has: "1" is a token that
#: has to be equal, "0" one that is ignored. With fewer tokens the whole text is the seed.
MASKS = {
    5: ("1111", "11101", "11011", "10111"),
    10: ("111011", "11010011", "11111"),
    15: ("1111011", "1100010111", "101100111", "111111"),
    16: ("1111011", "1110100011", "10101111"),
}
#: Bytes of benchmark text in a block.
BLOCK = 16 << 20
_BITS = 22
#: Hits, and tokens on their diagonals, that are held at a time.
HITS, HELD = 1 << 20, 1 << 22


def needed(n: int) -> int:
    """Equal tokens that an overlap with an item of ``n`` tokens needs."""
    return min(OVERLAP, math.ceil(SHARE * n - 1e-9))


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The places of the marks of each mask for an item of ``n`` tokens."""
    family = MASKS[max(k for k in MASKS if k <= n)]
    return tuple(tuple(i for i, c in enumerate(mask) if c == "1") for mask in family)


@dataclass
class SeedIndex:
    """Seeds of a block of items: per mask, sorted hashes with item and position, and a bitmap of them; short items by all their tokens."""

    ids: list
    tokens: np.ndarray
    rows: np.ndarray
    needs: np.ndarray
    masks: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]
    bitmaps: list[np.ndarray]
    short: dict[tuple[int, ...], int]


def build_index(ids: list, texts: pa.Array) -> SeedIndex:
    raw, offsets = string_buffers(texts)
    off = offsets - offsets[0]
    tokens, rows = WordHasher(alphanumeric())(raw[offsets[0] : offsets[-1]], off)
    length = np.diff(rows)
    sizes, which = np.unique(length, return_inverse=True)
    needs = np.array([needed(n) for n in sizes.tolist()], np.int64)[which]
    least = np.array([max((k for k in MASKS if k <= n), default=0) for n in sizes.tolist()], np.int64)[which]
    short = {tuple(tokens[rows[i] : rows[i + 1]].tolist()): i for i in np.flatnonzero((least == 0) & (length > 0)).tolist()}
    masks = sorted({(m, k) for k in np.unique(least).tolist() if k for m in masks_of(k)})
    masks = [(m, np.isin(least, [k for x, k in masks if x == m])) for m in dict.fromkeys(x for x, _ in masks)]
    out, maps = [], []
    for mask, fits in masks:
        item, where = [], []
        for i in np.flatnonzero(fits).tolist():
            a, b = int(rows[i]), int(rows[i + 1]) - mask[-1]
            where.append(np.arange(a, b))
            item.append(np.full(b - a, i))
        if not where:
            continue
        where, item = np.concatenate(where), np.concatenate(item)
        h = ngrams(tokens, mask)[where]
        order = np.argsort(h, kind="stable")
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[h >> U64(64 - _BITS)] = True
        out.append((mask, h[order], item[order], where[order]))
        maps.append(bitmap)
    return SeedIndex(ids, tokens, rows, needs, out, maps, short)


def _best(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal tokens) of the stretch with most equal tokens among those of ``SHARE``.

    Of several, the one with fewest others, then the last.
    """
    total = np.append(0, np.cumsum(np.where(equal, 1 - SHARE, -SHARE)))
    count = np.append(0, np.cumsum(equal))
    # the farthest end of each start: the last place from which on the total still reaches the start's
    reach = np.maximum.accumulate(total[::-1])
    end = len(equal) - np.searchsorted(reach, total - 1e-6)
    # changed tokens at the end count for nothing
    last = np.append(0, np.maximum.accumulate(np.where(equal, np.arange(1, len(equal) + 1), 0)))
    start = np.arange(len(total))
    end = np.maximum(last[end], start)
    same = count[end] - count[start]
    k = np.lexsort((start, start - end, same))[-1]
    return int(start[k]), int(end[k]), int(same[k])


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ..`` for each k, ``n[k]`` of them."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _pieces(n: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of rows whose ``n`` sum to ``limit`` or little more; a row is never cut."""
    part = (np.cumsum(n) - 1) // limit
    cut = np.flatnonzero(np.diff(part)) + 1
    for s, e in zip(np.append(0, cut).tolist(), np.append(cut, len(n)).tolist(), strict=True):
        if e > s:
            yield slice(s, e)


def overlaps(index: SeedIndex, h: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, equal tokens, first token, end token) of each row and item that overlap; the best each."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    if index.short:
        size = np.diff(rows)
        for r in np.flatnonzero((size > 0) & (size < min(MASKS))).tolist():
            i = index.short.get(tuple(h[rows[r] : rows[r + 1]].tolist()))
            if i is not None:
                found[r, i] = (int(size[r]), 0, int(size[r]))
    for (mask, keys, item, where), bitmap in zip(index.masks, index.bitmaps, strict=True):
        grams = ngrams(h, mask)
        at = np.flatnonzero(bitmap[grams >> U64(64 - _BITS)])
        row = np.searchsorted(rows, at, side="right") - 1
        at, row = (x[at + mask[-1] < rows[row + 1]] for x in (at, row))
        left, right = np.searchsorted(keys, grams[at]), np.searchsorted(keys, grams[at], side="right")
        some = np.flatnonzero(right > left)
        for piece in _pieces((right - left)[some], HITS):
            k = some[piece]
            n = right[k] - left[k]
            entry = _ragged(left[k], n)
            hits = np.stack([np.repeat(row[k], n), item[entry], np.repeat(at[k], n) - where[entry]])
            _confirm(index, h, rows, np.unique(hits, axis=1), found)
    return [(*k, *v) for k, v in sorted(found.items())]


def _confirm(index: SeedIndex, h: np.ndarray, rows: np.ndarray, hits: np.ndarray, found: dict) -> None:
    """The best overlap of each row and item, over the diagonals (row, item, shift)."""
    row, item, shift = hits
    s, e = np.maximum(rows[row], index.rows[item] + shift), np.minimum(rows[row + 1], index.rows[item + 1] + shift)
    for piece in _pieces(e - s, HELD):
        n = (e - s)[piece]
        at = _ragged(s[piece], n)
        equal = h[at] == index.tokens[at - np.repeat(shift[piece], n)]
        begin = np.cumsum(n) - n
        # a diagonal with too few equal tokens in all has no stretch with enough
        for k in np.flatnonzero(np.add.reduceat(equal, begin, dtype=np.int64) >= index.needs[item[piece]]).tolist():
            j = piece.start + k
            start, end, same = _best(equal[begin[k] : begin[k] + n[k]])
            if same >= index.needs[item[j]]:
                own = int(s[j] - rows[row[j]])
                pair, best = (int(row[j]), int(item[j])), (same, own + start, own + end)
                if best > found.get(pair, (0, 0, 0)):
                    found[pair] = best


def _blocks(benchmark: DataFrame, block: int) -> Iterator[tuple[SeedIndex, bool]]:
    """Indexes of bounded size, one after another, by hash of the text, and whether there are several.

    A text that many items have is indexed once; a block is as large as ``block`` says
    or as the longest item.
    """
    items = benchmark.select(F.xxhash64("text").alias("same"), "text").filter("text is not null").dropDuplicates(["same"])
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block))
    for k in range(blocks):
        part = items.filter(F.pmod("same", F.lit(blocks)) == k).toArrow()
        if part.num_rows:
            yield build_index(part["same"].to_pylist(), part["text"].combine_chunks()), blocks > 1


def _scan(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, index = WordHasher(alphanumeric()), shared.value
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            out = []
            for i, _, data, off in chunks(raw, offsets):
                out += [(i + r, *x) for r, *x in overlaps(index, *words(data, off))]
            if out:
                row, item, same, start, end = zip(*out, strict=True)
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(row)), pa.array([index.ids[k] for k in item], pa.int64()), pa.array(same), pa.array(start), pa.array(end)],
                    names=["doc_id", "same", "equal_tokens", "first_token", "end_token"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, equal_tokens, first_token, end_token``: one row per document and item that overlap.

    Tokens are runs of ASCII letters and digits and of bytes beyond ASCII, with A-Z
    lowered. An overlap has ``OVERLAP`` equal tokens (or ``SHARE`` of the item's, if that
    is fewer) and at least ``SHARE`` of its tokens equal; of several, the one with most
    equal tokens, then the last. An item of under five tokens overlaps with texts that
    consist of just these. Null and empty texts and items overlap with nothing; repeated
    rows, items included, repeat their results; other columns are ignored. No rows give
    no rows. A benchmark of several blocks takes a scan of the texts for each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, same long, equal_tokens long, first_token long, end_token long"
    out = spark.createDataFrame([], schema)
    for index, several in _blocks(benchmark, block):
        shared = spark.sparkContext.broadcast(index)
        found = rows.mapInArrow(_scan(shared), schema)
        if not several:
            out = found
            break
        out = out.unionByName(materialize(found, "overlaps"))
        shared.destroy()
    items = benchmark.select(F.xxhash64("text").alias("same"), F.col("item_id").cast("long").alias("item_id"))
    return out.join(items, "same").select("doc_id", "item_id", "equal_tokens", "first_token", "end_token")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without those that overlap with an item, with all their columns.

    Null and empty texts stay. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for index, several in _blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words = WordHasher(alphanumeric())
            for batch in batches:
                raw, offsets = string_buffers(batch.column(at))
                clean = np.ones(batch.num_rows, bool)
                for i, _, data, off in chunks(raw, offsets):
                    clean[[i + r for r, *_ in overlaps(shared.value, *words(data, off))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if several:
            docs = materialize(docs, "clean-texts")
            shared.destroy()
    return docs
