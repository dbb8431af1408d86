"""Periodic runs of words by a scan of all lags.

A run is a stretch of words with a smallest period q, long enough to hold the period
``exponent`` times, that no neighbouring word extends. A text's words become an array
of ids, which is compared with itself shifted by every lag q up to n / exponent. A true
stretch of lag q that is long enough covers ``exponent`` multiples of q, so all lags are
first compared at their multiples, in vectorised passes; where these are equal, a few
more places that such a stretch covers are compared. The lags that are left are compared
whole, and true stretches are run-length coded. No run can be missed, and the work is
about n log n, but for lags of which nearly all places are equal.

Long texts are dealt out as (document, range of lags) rows of about ``WORK`` comparisons
over the cluster; their runs, fewer than words, meet again by document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import small_batches

#: Bytes from which on a text's lags are dealt out, and comparisons of each range of them.
LONG, WORK = 1 << 16, 1 << 17
#: Comparisons of a vectorised pass.
BLOCK = 1 << 20
#: Where, in periods after a multiple, further words are compared before a lag is scanned whole.
PLACES = (0.5, 0.34, 1.5, 0.25, 1.75, 0.75, 1.25, 0.125, 0.9, 0.66, 1.4, 1.9)
_RUNS = "runs array<struct<start:long,length:long,period:long>>"
Run = tuple[int, int, int]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal ids for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, count()), np.int32, len(words))


def lag_ranges(n: int, exponent: int, work: int) -> list[tuple[int, int]]:
    """Ranges (first, last) that hold all lags up to n / exponent, of about ``work`` comparisons each."""
    most = n // exponent
    parts = math.ceil(n * math.log(most + 1) / work)
    cuts = sorted({int((most + 1) ** (k / parts)) for k in range(1, parts)} | {most}) if most else []
    return [(a + 1, b) for a, b in zip([0, *cuts], cuts, strict=False)]


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of true stretches."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).view(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def _candidates(ids: np.ndarray, first: int, last: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, multiple of it) where a run of that lag may stand, by lag."""
    n, lags, places = len(ids), [], []
    a = first
    while a <= last:
        b = min(last, int(a * math.exp(min(30.0, BLOCK / n))))  # lags of BLOCK comparisons together, one at least
        q = np.arange(a, b + 1)
        several = (n - 1) // q - exponent + 2
        q = np.repeat(q, several)
        x = (np.arange(len(q)) - np.repeat(np.cumsum(several) - several, several)) * q
        for step in range(1, exponent):
            keep = ids[x] == ids[x + step * q]
            q, x = q[keep], x[keep]
        for part in PLACES:
            if part <= exponent - 2:
                at = x + (q * part).astype(np.int64)
                keep = ids[at] == ids[at + q]
                q, x = q[keep], x[keep]
        lags.append(q)
        places.append(x)
        a = b + 1
    return np.concatenate(lags), np.concatenate(places)


def scan(ids: np.ndarray, first: int, last: int, exponent: int, least: int) -> list[Run]:
    """(start, length, period) of all runs with a period from ``first`` to ``last``."""
    n, runs = len(ids), []
    last = min(last, n // exponent)
    if first > last:
        return runs
    lags, places = _candidates(ids, first, last, exponent)
    lag, begin = np.unique(lags, return_index=True)
    # reach[x]: the furthest end of a run found so far that begins at x or before
    reach = np.zeros(n, np.int64)
    for q, x in zip(lag.tolist(), np.split(places, begin[1:]), strict=False):
        # Where a run of a smaller period p covers all these words, it shares p + q words with
        # this lag's stretch, which then has a period that divides both and is no run of its own.
        if (reach[x] > x + (exponent - 1) * q).all():
            continue
        start, length = _stretches(ids[:-q] == ids[q:])
        enough = length >= max(least - q, (exponent - 1) * q)
        ends = np.zeros(n, np.int64)
        for s, size in zip(start[enough].tolist(), (length[enough] + q).tolist(), strict=True):
            ends[s] = s + size
            # a smaller period divides this one
            if not any(np.array_equal(ids[s : s + q - q // p], ids[s + q // p : s + q]) for p in _primes(q)):
                runs.append((s, size, q))
        if enough.any():
            reach = np.maximum(reach, np.maximum.accumulate(ends))
    return runs


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words, joined by one blank, without those that a run repeats after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for s, size, q in runs:
        change[s + q] += 1
        change[s + size] -= 1
    return b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def _words(texts: pa.Array) -> list[list[bytes]]:
    """The words of each text: runs of anything but blanks and the control characters 9 to 13."""
    return [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]


def _arrays(all_runs: list[list[Run]]) -> pa.Array:
    flat = np.array([r for runs in all_runs for r in runs], np.int64).reshape(-1, 3)
    values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(np.cumsum([0] + [len(r) for r in all_runs]).astype(np.int32), values)


def _found(keys: pa.Array, words: list[list[bytes]], all_runs: list[list[Run]]) -> pa.RecordBatch:
    all_runs = [sorted(r, key=lambda r: (r[0], r[2])) for r in all_runs]
    left = pa.array([collapse(w, r) for w, r in zip(words, all_runs, strict=True)], pa.binary()).cast(pa.string())
    return pa.record_batch([keys, _arrays(all_runs), left], names=["doc_id", "runs", "collapsed"])


def _whole(exponent: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _words(batch.column(1))
            yield _found(batch.column(0), words, [scan(word_ids(w), 1, len(w), exponent, least) for w in words])

    return run


def _deal(exponent: int, work: int) -> Callable:
    """Each text once for every range of its lags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                for a, b in lag_ranges(len(_words(row.column(2))[0]), exponent, work):
                    yield pa.record_batch([*row.columns, pa.array([a]), pa.array([b])], names=["doc_id", "digest", "text", "first", "last"])

    return run


def _range(exponent: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = zip(_words(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            yield pa.record_batch([batch.column(0), batch.column(1), _arrays([scan(word_ids(w), a, b, exponent, least) for w, a, b in spans])], names=["doc_id", "digest", "runs"])

    return run


def _together() -> Callable:
    """Each text with the runs of all its ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[(r["start"], r["length"], r["period"]) for r in rs or ()] for rs in batch.column(2).to_pylist()]
            yield _found(batch.column(0), _words(batch.column(1)), runs)

    return run


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, text: str = "text", key: str = "doc_id", long: int = LONG, work: int = WORK) -> DataFrame:
    """``doc_id, runs, collapsed`` of each row, over whole texts.

    ``runs`` are (start, length, period), by start and period: stretches of words with a
    smallest period, of ``least`` words and ``exponent`` periods or more, as long as the
    period holds. ``collapsed`` is the text without the words that a run repeats after
    its first period, joined by one blank. A null, empty or blank text has no runs and
    collapses to an empty text; a null key stays null; repeated rows give repeated
    results; other columns are ignored; no rows give no rows. Texts of ``long`` bytes and
    more are dealt out by lags; this never changes a result.
    """
    if exponent < 3 or least < 1:
        raise ValueError("a run holds its period three times at least")
    small_batches(docs.sparkSession)
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    is_long = F.coalesce(F.octet_length("text") >= long, F.lit(False))
    done = rows.where(~is_long).mapInArrow(_whole(exponent, least), f"doc_id long, {_RUNS}, collapsed string")
    large = rows.where(is_long).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    dealt = large.mapInArrow(_deal(exponent, work), "doc_id long, digest binary, text string, first long, last long").repartition("doc_id", "digest", "first")
    found = dealt.mapInArrow(_range(exponent, least), f"doc_id long, digest binary, {_RUNS}").groupBy("doc_id", "digest")
    found = found.agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs")).withColumnsRenamed({"doc_id": "of", "digest": "its"})
    joined = large.join(found, large["doc_id"].eqNullSafe(found["of"]) & (large["digest"] == found["its"]), "left")
    return done.unionByName(joined.select("doc_id", "text", "runs").mapInArrow(_together(), f"doc_id long, {_RUNS}, collapsed string"))
