"""Line dedup: one line of each group of equal or nearly equal lines stays.

1. Every line that isn't blank gets a 128-bit key of its words (A-Z lowered, white
   space as one blank); lines of one key are equal, and are one node from here on.
2. Fuzzy lines: MinHash over shingles of ``SHINGLE`` characters. Lines of ``FEW``
   distinct ones or more have ``BANDS`` bands of ``ROWS`` values, by one permutation with
   densified bins. Where bins are as many as shingles these values aren't independent:
   lines of fewer have as many bands of ``FEW_ROWS`` values by permutations of their own.
   Lines little longer have both, so that no pair falls between. Bands' rows are dealt by
   ranges of (bucket, node), cut by a sample so that a bucket of any size is spread,
   and travel as arrays. In a bucket of up to ``SMALL`` lines all pairs are candidates;
   in a larger one, or one that a cut runs through, each line and its predecessors.
3. Pairs are confirmed by the exact Jaccard similarity of their shingle sets.
4. Components of confirmed pairs by alternating stars. In larger buckets all pairs
   that these don't join yet are compared then, exactly and in blocks that split a
   bucket over tasks (``regions``). No pair that shares a band is left out.
5. Of all lines of a component the one of the least document stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import connected_components
from .kernels import U64, chunks, mix, string_buffers
from .regions import joined, mixed_regions, region_links
from .session import fresh, materialize, partitions, small_batches

SHINGLE = 8
BANDS, ROWS = 10, 3
#: A power of two; the bands take BANDS * ROWS of them.
BINS = 32
PERCENT = 75
#: Distinct shingles from which on bins do, those under which permutations are taken (a like line has FEW / 0.75 at most), and values of a band then.
FEW, MOST_FEW, FEW_ROWS = 64, 86, 2
#: Places of a line that are looked at to see that it has MOST_FEW distinct shingles.
PROBED = 128
#: Lines of a bucket that are compared at once, and predecessors that each line of a larger one meets first.
SMALL, WINDOW = 16, 2
#: Rows of the sample for each part of the order.
DRAWN = 50
#: Lines whose bands a task holds before it hands them on.
HELD = 1 << 16

#: Bytes of text that are looked at together, so that arrays stay in a core's cache.
CHUNK = 1 << 17

#: A-Z as small letters; white space as blanks, with and without the ends of lines.
_NORMAL = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACED = bytes(10 if b == 10 else n for b, n in enumerate(_NORMAL))


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each line, in order; a text without line end is one line."""
    ends_of_lines = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    counts = np.searchsorted(ends_of_lines, offsets[1:]) - np.searchsorted(ends_of_lines, offsets[:-1]) + 1
    first = np.cumsum(counts) - counts
    starts, ends = np.empty(counts.sum(), np.int64), np.empty(counts.sum(), np.int64)
    inner = np.ones(len(starts), bool)
    inner[first] = False
    starts[first], starts[inner] = offsets[:-1], ends_of_lines + 1
    inner[:] = True
    inner[first + counts - 1] = False
    ends[first + counts - 1], ends[inner] = offsets[1:], ends_of_lines
    return starts, ends, np.repeat(np.arange(n), counts)


_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93)
#: The low bytes of a word, for 0 to 8 of them.
_LOW = np.append((U64(1) << (U64(8) * np.arange(8, dtype=U64))) - U64(1), U64(0xFFFFFFFFFFFFFFFF))


def _span_keys(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each span of bytes that isn't empty, eight bytes at a time."""
    words = (ends - starts + 7) >> 3
    first = np.cumsum(words) - words
    place = np.arange(words.sum()) - np.repeat(first, words)
    padded = text + bytes(8)
    x = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))[np.repeat(starts, words) + 8 * place]
    x[first + words - 1] &= _LOW[ends - starts - 8 * (words - 1)]
    place = place.astype(U64)
    length = (ends - starts).astype(U64) * _C3
    with np.errstate(over="ignore"):
        return np.stack([np.add.reduceat(mix(x + place * _C1), first) + mix(length), np.add.reduceat(mix(x ^ (place + U64(1)) * _C2), first) + length], axis=1)


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of the words of each line; both are 0 if it has none."""
    text = data.tobytes().translate(_SPACED)
    d = np.frombuffer(text, np.uint8)
    blank = d == 32
    filled = np.flatnonzero(ends > starts)
    # lines with more than single blanks between words are put right one by one
    odd = np.zeros(len(starts), bool)
    odd[filled] = blank[starts[filled]] | blank[ends[filled] - 1]
    twice = np.flatnonzero(blank[:-1] & blank[1:])
    odd[np.searchsorted(starts, twice, "right") - 1] = True
    out = np.zeros((len(starts), 2), U64)
    plain = filled[~odd[filled]]
    if len(plain):
        out[plain] = _span_keys(text, starts[plain], ends[plain])
    odd = filled[odd[filled]]
    fixed = [b" ".join(text[a:b].split()) for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
    size = np.array([len(f) for f in fixed], np.int64)
    some = np.flatnonzero(size)
    if len(some):
        last = np.cumsum(size)
        out[odd[some]] = _span_keys(b"".join(fixed), (last - size)[some], last[some])
    return out


def shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a hash of the shingle from each place on, where lines start and end among the places).

    Places are UTF-16 units of the text, normalised. A line's shingles are those that
    start ``SHINGLE`` - 1 places before its end at the latest; what the others say means nothing.
    """
    text = data.tobytes().translate(_NORMAL)
    if text.isascii():
        units = np.frombuffer(text, np.uint8)
    else:
        units = np.frombuffer(text.decode("utf-8").encode("utf-16-le"), np.uint16)
        # a character has a unit for its first byte, one of four bytes another
        inner, large = np.flatnonzero((data & 0xC0) == 0x80), np.flatnonzero(data >= 0xF0)
        starts, ends = (x - np.searchsorted(inner, x) + np.searchsorted(large, x) for x in (starts, ends))
    n = len(units)
    padded = np.zeros(n + 2 * SHINGLE, np.uint16)
    padded[:n] = units
    four = np.empty(n + 4, U64)
    for k in range(4):
        four[k::4] = np.frombuffer(padded, U64, len(four[k::4]), 2 * k)
    with np.errstate(over="ignore"):
        x = four[:n] * U64(0x9FB21C651E98DF25)
        four *= U64(0xD6E8FEB86659FD93)
        x += four[4:]
        x ^= x >> U64(32)
        x *= U64(0x81DADEF4BC2DD44D)
        x ^= x >> U64(29)
    return x, starts, ends


def shingle_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each line."""
    x, starts, ends = shingles(data, starts, ends)
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        s = np.sort(x[a : max(a, b - SHINGLE + 1)])
        if len(s) > 1:
            s = s[np.append(True, s[1:] != s[:-1])]
        out.append(s)
    return out


def bins(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, made: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(``BINS`` MinHash values of each line by one permutation, how many shingles it has); lines follow each other."""
    h, starts, ends = made or shingles(data, starts, ends)
    none = np.uint32(0xFFFFFFFF)
    value = h.astype(np.uint32) >> np.uint32(1)
    # what starts too near to a line's end, or is its end
    late = (ends[:, None] - np.arange(SHINGLE)).ravel()
    value[late[(late >= 0) & (late < len(value)) & (late >= np.repeat(starts, SHINGLE))]] = none
    line = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(h))))
    out = np.full(len(starts) * BINS, none)
    line *= np.int32(BINS)
    line += (h >> U64(59)).view(np.int64).astype(np.int32)
    np.minimum.at(out, line, value)
    out = out.reshape(-1, BINS)
    # an empty bin takes the value of the next full one, marked by the distance
    places = np.where(out != none, np.arange(BINS, dtype=np.int8), np.int8(3 * BINS))
    places = np.hstack([places, np.where(places < BINS, places + np.int8(BINS), places)])
    source = np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    distance = (source - np.arange(BINS, dtype=np.int8)).astype(U64)
    with np.errstate(over="ignore"):
        values = mix(np.take_along_axis(out, (source % np.int8(BINS)).astype(np.int64), axis=1).astype(U64) + distance * U64(0xD6E8FEB86659FD93))
    return values, np.maximum(ends - starts - SHINGLE + 1, 0)


def buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, made: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the bucket of each line in each band, how many shingles it has); ``made``: its shingles, if they are known."""
    values, size = bins(data, starts, ends, made)
    # a band's values are BANDS bins apart: an empty bin has its value from the next full one
    values = values[:, : ROWS * BANDS].reshape(-1, ROWS, BANDS)
    with np.errstate(over="ignore"):
        return mix(values[:, 0] * U64(3) + mix(values[:, 1] * U64(5) + mix(values[:, 2])) + np.arange(BANDS, dtype=U64)).view(np.int64), size


def distinct_counts(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many distinct shingles each line has, exact for lines of under ``MOST_FEW``; at least that many else.

    Hashes are told apart by half of their bits, which is as good for lines of equal sets.
    """
    x = x.astype(np.uint32)
    places = np.maximum(ends - starts - SHINGLE + 1, 0)
    out = np.minimum(places, 1)
    some = np.flatnonzero(places > 1)
    for begin in range(0, len(some), 4096):
        part = some[begin : begin + 4096]
        n = np.minimum(places[part], PROBED)
        at = np.arange(PROBED)
        probed = x[np.minimum(starts[part, None] + at * (places[part, None] // n[:, None]), len(x) - 1)]
        # further places repeat the first
        probed = np.where(at < n[:, None], probed, probed[:, :1])
        probed.sort(axis=1)
        out[part] = 1 + np.count_nonzero(probed[:, 1:] != probed[:, :-1], axis=1)
    for k in np.flatnonzero((places > PROBED) & (out < MOST_FEW)).tolist():
        out[k] = len(np.unique(x[starts[k] : starts[k] + places[k]]))
    return out


_SEEDS = np.array([0x9E3779B9 * (2 * k + 1) & 0xFFFFFFFF for k in range(BANDS * FEW_ROWS)], np.uint32)


def few_buckets(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bucket in each band of lines that have a shingle, by a permutation for each value."""
    places = ends - starts - SHINGLE + 1
    first = np.cumsum(places) - places
    own = (x[np.repeat(starts - first, places) + np.arange(places.sum())] >> U64(32)).astype(np.uint32)
    values = np.empty((len(starts), BANDS * FEW_ROWS), U64)
    with np.errstate(over="ignore"):
        for k, seed in enumerate(_SEEDS):
            v = (own ^ seed) * np.uint32(0x85EBCA6B)
            v ^= v >> np.uint32(15)
            v *= np.uint32(0xC2B2AE35)
            values[:, k] = np.minimum.reduceat(v, first)
        both = mix(values[:, :BANDS] * U64(3) + mix(values[:, BANDS:] + U64(7)))
        return mix(both + np.arange(BANDS, 2 * BANDS, dtype=U64)).view(np.int64)


def band_rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lines, their buckets) by bins and by permutations of their own; lines follow each other."""
    x, begin, stop = shingles(data, starts, ends)
    n = distinct_counts(x, begin, stop)
    few = np.flatnonzero((n > 0) & (n < MOST_FEW))
    out = [(many := np.flatnonzero(n >= FEW), buckets(data, starts, ends, (x, begin, stop))[0][many])]
    if len(few):
        out.append((few, few_buckets(x, begin[few], stop[few])))
    return out


def _prepare(at: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with their text packed, the keys of their lines (0 for a blank one) and a hash of the text."""
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw, offsets = string_buffers(batch.column(at))
            null = batch.column(at).is_null().to_pylist()
            packed, keys, whole = [], [], []
            for i, j, data, off in chunks(raw, offsets, CHUNK):
                starts, ends, row = line_spans(data, off)
                both = line_keys(data, starts, ends)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                with np.errstate(over="ignore"):
                    whole.append(np.add.reduceat(mix(both[:, 0] + (np.arange(len(both)) - cut[row]).astype(U64)), cut[:-1]))
                for k in range(j - i):
                    packed.append(None if null[i + k] else pack.compress(data[off[k] : off[k + 1]].tobytes()))
                    keys.append(both[cut[k] : cut[k + 1]].tobytes())
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            whole = np.concatenate(whole).view(np.int64) if whole else np.zeros(0, np.int64)
            yield pa.record_batch([*columns, pa.array(packed, pa.binary()), pa.array(keys, pa.binary()), pa.array(whole)], names=names)

    return run


def _each_line(batch: pa.RecordBatch) -> np.ndarray:
    """``k1, k2, doc_id, whole, pos, row`` of each line that isn't blank; columns: line_keys, doc_id, whole, row."""
    keys = batch.column(0).to_pylist()
    n = np.array([len(k) // 16 for k in keys], np.int64)
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    row = np.repeat(np.arange(len(keys)), n)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    keep = np.flatnonzero(both.any(axis=1))
    # a document without number comes before all others
    doc = batch.column(1).fill_null(-(1 << 63)).to_numpy()
    row = row[keep]
    return np.stack([both[keep, 0], both[keep, 1], doc[row], batch.column(2).to_numpy()[row], pos[keep], batch.column(3).to_numpy()[row]], axis=1)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line that isn't blank."""
    for batch in batches:
        lines = _each_line(batch)
        yield pa.record_batch([pa.array(lines[:, c]) for c in (0, 1, 4, 5)], names=["k1", "k2", "pos", "row"])


def _least(lines: np.ndarray) -> np.ndarray:
    """The least line of each key, and in a last column how many lines have it."""
    lines = lines[np.lexsort(lines[:, 5::-1].T)]
    first = np.flatnonzero(np.append(True, (lines[1:, :2] != lines[:-1, :2]).any(axis=1))) if len(lines) else np.zeros(0, np.int64)
    out = lines[first]
    out[:, 6] = np.add.reduceat(lines[:, 6], first) if len(first) else 0
    return out


def _by_key(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least lines of this task's keys, as arrays, by part."""
        held, n = [], 0

        def out() -> pa.RecordBatch:
            lines = _least(np.concatenate(held))
            part = ((lines[:, 0].view(U64) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            pieces = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
            return pa.record_batch([pa.array([part[p[0]] for p in pieces], pa.int32()), pa.array([lines[p].tobytes() for p in pieces], pa.binary())], names=["part", "lines"])

        for batch in batches:
            lines = _each_line(batch)
            if len(lines):
                held.append(np.hstack([lines, np.ones((len(lines), 1), np.int64)]))
                n += len(lines)
            if n >= 2 * HELD:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return run


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [x for b in batches for x in b.column(1).to_pylist()]
    lines = _least(np.frombuffer(b"".join(held), np.int64).reshape(-1, 7))
    yield pa.record_batch([pa.array(lines[:, c]) for c in range(7)], names=["k1", "k2", "doc_id", "whole", "pos", "row", "n"])


def _unpacked(packed: list[bytes | None], unpack: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    texts = [b"" if x is None else unpack.decompress(x) for x in packed]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def part_of(bounds: tuple[np.ndarray, np.ndarray], first: np.ndarray, node: np.ndarray) -> np.ndarray:
    """How many bounds (sorted pairs) each row (first, node) is not below."""
    low, high = np.searchsorted(bounds[0], first, "left"), np.searchsorted(bounds[0], first, "right")
    part = low.copy()
    cut = np.flatnonzero(low < high)
    # a bucket that fills whole parts is several bounds, told apart by the node
    for k in range(int((high - low)[cut].max()) if len(cut) else 0):
        rows = cut[low[cut] + k < high[cut]]
        part[rows] += node[rows] >= bounds[1][low[rows] + k]
    return part.astype(np.int32)


def _bands(shared=None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets and nodes of the bands of this task's distinct lines, as arrays, by part."""
        unpack = zstandard.ZstdDecompressor()
        bounds = shared.value if shared else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        held, n = ([], []), 0  # of either kind of bands

        def out() -> pa.RecordBatch:
            firsts, nodes = [], []
            for kind in held:
                if kind:
                    node, bucket = (np.concatenate(x) for x in zip(*kind, strict=True))
                    node, some = np.unique(node, return_index=True)
                    firsts.append(bucket[some].T.ravel())
                    nodes.append(np.tile(node, BANDS))
            first, node = np.concatenate(firsts), np.concatenate(nodes)
            part = part_of(bounds, first, node)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            pieces = np.split(order, cut)
            return pa.record_batch(
                [pa.array([part[p[0]] for p in pieces], pa.int32()), *(pa.array([v[p].tobytes() for p in pieces], pa.binary()) for v in (first, node))], names=["part", "firsts", "nodes"]
            )

        for batch in batches:
            raw, offsets = _unpacked(batch.column(0).to_pylist(), unpack)
            keys = batch.column(1).to_pylist()
            for i, j, data, off in chunks(raw, offsets, CHUNK):
                k1 = np.frombuffer(b"".join(keys[i:j]), np.int64).reshape(-1, 2)[:, 0]
                starts, ends, _ = line_spans(data, off)
                for kind, (lines, bucket) in zip(held, band_rows(data, starts, ends), strict=False):
                    some = k1[lines] != 0
                    if some.any():
                        kind.append((k1[lines[some]], bucket[some]))
                        n += int(np.count_nonzero(some))
                if n >= HELD:
                    yield out()
                    held, n = ([], []), 0
        if n:
            yield out()

    return run


def _bounds(rows: DataFrame, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Where to cut the order of all bands' rows: quantiles of a sample of texts.

    The sample grows with the number of parts, not with the table; it decides how even
    the parts are and nothing else.
    """
    parts = partitions(rows.sparkSession)
    share = min(1.0, DRAWN * parts / max(1, lines * BANDS))
    drawn = rows.sample(share, 17).select("packed", "line_keys").mapInArrow(_bands(), "part int, firsts binary, nodes binary").toArrow()
    pairs = [np.frombuffer(b"".join(drawn[c].to_pylist()), np.int64) for c in ("firsts", "nodes")]
    order = np.lexsort(pairs[::-1])
    at = order[np.linspace(0, len(order) - 1, parts + 1).astype(int)[1:-1]] if len(order) else order
    return tuple(x[at] for x in pairs)


def _candidates(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates (a, b) of a part's buckets, and the rows (first, a) of those that aren't all pairs here."""
        schema = pa.schema([("first", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
        held = [(b.column(1).to_pylist(), b.column(2).to_pylist()) for b in batches]
        first, node = (np.frombuffer(b"".join(x for h in held for x in h[c]), np.int64) for c in range(2))
        del held
        order = np.lexsort((node, first))
        first, node = first[order], node[order]
        if not len(first):
            return
        once = np.append(True, (np.diff(first) != 0) | (np.diff(node) != 0))
        first, node = first[once], node[once]
        bucket = np.cumsum(np.append(0, np.diff(first) != 0))
        size = np.bincount(bucket)[bucket]
        crowded = (size > SMALL) | np.isin(first, shared.value[0])
        crowd = np.flatnonzero(crowded)
        if len(crowd):
            yield pa.record_batch([pa.array(first[crowd]), pa.array(node[crowd]), pa.nulls(len(crowd), pa.int64())], schema=schema)
        a, b = [], []
        i = np.flatnonzero((size > 1) | crowded)
        for k in range(1, SMALL):
            i = i[i >= k]
            i = i[bucket[i] == bucket[i - k]]
            if k == WINDOW + 1:
                i = i[~crowded[i]]
            if not len(i):
                break
            a.append(node[i - k])
            b.append(node[i])
        if a:
            # nodes rise within a bucket
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            yield pa.record_batch([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return run


def _texts_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked-for lines of each text."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        nodes, lines = [], []
        for packed, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts = unpack.decompress(packed).split(b"\n")
            nodes += [a["node"] for a in asked]
            lines += [parts[a["pos"]] for a in asked]
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(lines, pa.binary())], names=["node", "line"])


def _sets(lines: pa.Array) -> list[np.ndarray]:
    """The shingle set of each line."""
    raw, offsets = string_buffers(lines)
    return [s for _, _, data, off in chunks(raw, offsets, CHUNK) for s in shingle_sets(data, off[:-1], off[1:])]


def _verify(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per pivot: its own line first, then its candidates'; the confirmed pairs."""
        pivot, own = None, None
        for batch in batches:
            a, b = [], []
            for p, node, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _sets(batch.column(2)), strict=True):
                if p == node:
                    pivot, own = p, s
                    continue
                assert pivot == p, "a pivot's own line comes first"
                small, large = (s, own) if len(s) < len(own) else (own, s)
                if 100 * len(small) < percent * len(large):
                    continue
                both = np.count_nonzero(large.take(large.searchsorted(small), mode="clip") == small)
                if 100 * both >= percent * (len(s) + len(own) - both):
                    a.append(p)
                    b.append(node)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose lines' shingle sets are that similar; ``texts`` has node and line."""
    ship = pairs.select(F.col("b").alias("node"), F.col("a").alias("pivot")).unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("pivot")).distinct())
    return (
        ship.join(texts.hint("shuffle_hash"), "node")
        .repartition("pivot")
        .withColumn("later", F.col("node") != F.col("pivot"))
        .sortWithinPartitions("pivot", "later")
        .select("pivot", "node", "line")
        .mapInArrow(_verify(percent), "a long, b long")
    )


def _apply(at: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts without their removed lines; columns: others, packed, line_keys, removed."""
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            others, (packed, keys, removed) = batch.columns[:-3], (c.to_pylist() for c in batch.columns[-3:])
            texts, lines, gone, left = [], [], [], []
            for x, k, r in zip(packed, keys, removed, strict=True):
                text = None if x is None else unpack.decompress(x)
                if r:
                    r = set(r)
                    text = b"\n".join(p for i, p in enumerate(text.split(b"\n")) if i not in r)
                texts.append(text)
                counted = np.frombuffer(k, np.int64).reshape(-1, 2).any(axis=1)
                lines.append(0 if x is None else len(counted))
                gone.append(len(r or ()))
                left.append(int(np.count_nonzero(counted)) - gone[-1])
            columns = list(others)
            columns.insert(at, pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.record_batch([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.int64())], names=names)

    return run


def _deduped(docs: DataFrame, text: str, key: str, percent: int, counts: tuple[str, str, str]) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text)
    others = [f for f in docs.schema if f.name != text]
    # own columns by names that the table doesn't have
    packed, line_keys, whole, row, removed = fresh(docs.columns, "packed", "line_keys", "whole", "row", "removed")
    names = [f.name for f in others]
    prepared = T.StructType([*others, T.StructField(row, T.LongType()), T.StructField(packed, T.BinaryType()), T.StructField(line_keys, T.BinaryType()), T.StructField(whole, T.LongType())])
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    # packed texts and keys are as small as they get
    rows = materialize(numbered.mapInArrow(_prepare(at, prepared.names), prepared), "packed-texts", "uncompressed")
    own = rows.select(F.col(packed).alias("packed"), F.col(line_keys).alias("line_keys"), F.col(key).cast("long").alias("doc_id"), F.col(whole).alias("whole"), F.col(row).alias("row"))
    keyed = own.select("line_keys", "doc_id", "whole", "row")
    dealt = keyed.mapInArrow(_by_key(partitions(spark)), "part int, lines binary").repartitionById(partitions(spark), "part")
    equal = materialize(dealt.mapInArrow(_equal, "k1 long, k2 long, doc_id long, whole long, pos long, row long, n long"), "equal-lines")

    shared = spark.sparkContext.broadcast(_bounds(own, equal.count()))
    banded = own.select("packed", "line_keys").mapInArrow(_bands(shared), "part int, firsts binary, nodes binary")
    found = materialize(banded.repartitionById(partitions(spark), "part").mapInArrow(_candidates(shared), "first long, a long, b long"), "candidates")
    pairs = materialize(found.filter("b is not null").select("a", "b").distinct(), "line-pairs")
    crowded = found.filter("b is null").select(F.col("first").alias("region"), F.col("a").alias("node"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("k1")).unionByName(crowded.select(F.col("node").alias("k1"))).distinct()
    # a node is a line, the least one should two of different words have its key
    nodes = materialize(equal.join(nodes.hint("shuffle_hash"), "k1").groupBy("k1").agg(F.min(F.struct("doc_id", "whole", "pos", "row", "k2", "n")).alias("x")).select("k1", "x.*"), "candidate-nodes")
    asked = nodes.groupBy("row").agg(F.collect_set(F.struct("pos", F.col("k1").alias("node"))).alias("asked"))
    texts = materialize(own.select("row", "packed").join(asked.hint("shuffle_hash"), "row").select("packed", "asked").mapInArrow(_texts_of_lines, "node long, line binary"), "candidate-lines")
    links = materialize(confirm(pairs, texts, percent), "line-links")
    components = connected_components(links)
    weighed = texts.select("node", F.col("line").alias("payload"), F.octet_length("line").alias("weight"))
    regions = mixed_regions(crowded.join(weighed.select("node", "weight"), "node"), components)
    more = materialize(region_links(regions, weighed, _sets, percent), "region-links")
    components = joined(components, more)
    # what stays: per component of fuzzy lines, else per key; lines that stand alone need no row
    kept = F.struct("doc_id", "whole", "pos", "row").alias("kept")
    fuzzy = nodes.join(components.withColumnRenamed("node", "k1"), "k1").select("k1", "k2", kept, "component")
    best = fuzzy.groupBy("component").agg(F.min("kept").alias("stays"))
    fuzzy = materialize(fuzzy.join(best, "component").select("k1", "k2", "stays.row", "stays.pos"), "fuzzy-lines")
    repeated = equal.filter("n > 1").join(fuzzy.select("k1", "k2"), ["k1", "k2"], "left_anti").select("k1", "k2", "row", "pos")
    stays = fuzzy.unionByName(repeated).select("k1", "k2", F.col("row").alias("stays_row"), F.col("pos").alias("stays_pos"))
    gone = (
        keyed.mapInArrow(_lines, "k1 long, k2 long, pos long, row long")
        .join(stays.hint("shuffle_hash"), ["k1", "k2"])
        .filter("row <> stays_row or pos <> stays_pos")
        .groupBy(F.col("row").alias(row))
        .agg(F.collect_set("pos").alias(removed))
    )
    out = T.StructType([*docs.schema, *(T.StructField(n, T.LongType()) for n in counts)])
    return rows.join(gone.hint("shuffle_hash"), row, "left").select(*names, packed, line_keys, removed).mapInArrow(_apply(at, out.names), out)


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``docs`` with the text of each row rid of repeated lines, and three counts.

    ``n_lines`` is the number of lines before, ``n_removed`` that of removed ones,
    ``n_left`` that of lines left that aren't blank. Of each component of equal or
    nearly equal lines the one of least (doc_id, hash of the text, line number) stays,
    within a document too; a null doc_id comes first. A null text stays null (no line),
    an empty one stays empty (one line); blank lines always stay. Each row is a text of
    its own: of repeated rows one keeps its lines. Lines that share none of ten bands
    aren't compared: of pairs at exactly 75 percent 4 in 1,000, or 3 in 10,000 where a
    line has under 64 distinct shingles; equal sets always share them. Other columns are
    carried along, whatever their names; only ``n_lines``, ``n_removed`` and ``n_left``
    are replaced where the table has them. No rows give no rows.
    """
    counts = ("n_lines", "n_removed", "n_left")
    return _deduped(docs.drop(*counts), text, key, percent, counts)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines; ``n_chars``, if there, follows the text.

    A document that lost lines and has none but blank ones left holds nothing of its
    own and goes. Null and empty texts stay.
    """
    gone, left, lines = fresh(docs.columns, "n_removed", "n_left", "n_lines")
    out = _deduped(docs, "text", "doc_id", PERCENT, (lines, gone, left)).filter((F.col(gone) == 0) | (F.col(left) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
