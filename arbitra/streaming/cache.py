"""A bounded cache of accepted answers, as keyed state of a stream.

Keys are dealt to shards by hash, and a shard is the state: its entries in the order of
use, ``bound`` of them at most, each good for ``ttl_ms``. A request that finds its key is
served and counts as a use; one that doesn't enters its own answer if that was accepted,
and the least recently used entry goes where there is no room. So state never holds more
than shards times ``bound`` answers, whatever the stream holds, and a shard's requests of
a micro-batch, however many, are sorted in runs and served one by one. A shard that isn't used
for as long as its entries are good is forgotten by a timer.
"""

from __future__ import annotations

import heapq
import json
import tempfile
from collections import OrderedDict
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests of a shard that are sorted at once, that are read of a sorted run at once, and that are told at once.
RUN, PIECE, TOLD = 1 << 19, 1 << 10, 1 << 13
_ASKED = pa.schema([("at_ms", pa.int64()), ("seq", pa.int64()), ("cache_key", pa.string()), ("answer", pa.string()), ("accepted", pa.bool_())])
SERVED = "seq long, cache_key string, hit boolean, answer string, evicted string"


class Entries:
    """What a shard holds: key to (answer, time it entered), least recently used first."""

    def __init__(self, bound: int, ttl_ms: int | None, held: str | None = None) -> None:
        self.bound, self.ttl = bound, ttl_ms
        self.items: OrderedDict[str, tuple[str | None, int]] = OrderedDict((k, (a, t)) for k, a, t in json.loads(held or "[]"))

    def told(self) -> str:
        return json.dumps([[k, a, t] for k, (a, t) in self.items.items()])

    def serve(self, key: str | None, now: int, answer: str | None, accepted: bool) -> tuple[bool, str | None, str | None]:
        """(hit, answer, key that had to go) of a request. A null key is never held."""
        found = self.items.get(key)
        if found and self.ttl is not None and now - found[1] >= self.ttl:
            del self.items[key]
            found = None
        if found:
            self.items.move_to_end(key)
            return True, found[0], None
        gone = None
        if accepted and key is not None:
            self.items[key] = (answer, now)
            if len(self.items) > self.bound:
                gone, _ = self.items.popitem(last=False)
        return False, answer, gone


def _in_order(batches: Iterator[pd.DataFrame], run: int = RUN) -> Iterator[tuple]:
    """(at_ms, seq, cache_key, answer, accepted) of a shard's requests by time, then number.

    A shard may hold all of a micro-batch. What comes is sorted ``run`` rows at a time;
    where there are more, the sorted runs wait in temporary files and are merged.
    """
    with tempfile.TemporaryFile() as file:
        held, rows, runs = [], 0, []

        def put() -> pa.Table:
            nonlocal held, rows
            table = pa.Table.from_batches(held, _ASKED).sort_by([("at_ms", "ascending"), ("seq", "ascending")])
            held, rows = [], 0
            return table

        for frame in batches:
            held.append(pa.RecordBatch.from_pandas(frame, _ASKED, preserve_index=False))
            rows += len(frame)
            if rows >= run:
                runs.append([])
                for piece in put().combine_chunks().to_batches(PIECE):
                    data = piece.serialize()
                    runs[-1].append((file.tell(), data.size))
                    file.write(data)

        def told(pieces: list[tuple[int, int]]) -> Iterator[tuple]:
            for at, size in pieces:
                file.seek(at)
                yield from _rows(pa.ipc.read_record_batch(file.read(size), _ASKED))

        last = (row for piece in put().to_batches(PIECE) for row in _rows(piece))
        yield from heapq.merge(*map(told, runs), last, key=itemgetter(0, 1)) if runs else last


def _rows(piece: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in piece.columns), strict=True)


def _shard(bound: int, ttl_ms: int | None) -> Callable:
    names = ["seq", "cache_key", "hit", "answer", "evicted"]

    def run(shard: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        entries = Entries(bound, ttl_ms, state.get[0] if state.exists else None)
        out, now = [], 0
        for now, seq, key, answer, accepted in _in_order(batches):
            hit, told, gone = entries.serve(key, now, answer, accepted)
            out.append((seq, key, hit, told, gone))
            if len(out) == TOLD:
                yield pd.DataFrame(out, columns=names)
                out = []
        state.update((entries.told(),))
        if ttl_ms is not None:
            state.setTimeoutTimestamp(max(now, state.getCurrentWatermarkMs()) + ttl_ms + 1)
        yield pd.DataFrame(out, columns=names)

    return run


def cached_answers(requests: DataFrame, bound: int = 1024, shards: int = 64, ttl_ms: int | None = None) -> DataFrame:
    """``seq, cache_key, hit, answer, evicted`` of each request of a stream.

    Requests have seq, cache_key, at_ms, answer and accepted; those of a shard are served
    by time, then number, within a micro-batch, and micro-batches one after the other.
    With ``ttl_ms`` the stream needs a watermark. Other columns are ignored; an answer or
    a key may be null; a null ``accepted`` is none.
    """
    if bound < 1 or shards < 1 or (ttl_ms is not None and ttl_ms < 1):
        raise ValueError("bound, shards and time to live are positive")
    shard = F.pmod(F.xxhash64("cache_key"), F.lit(shards)).alias("shard")
    kept = [F.col(c).cast(kind) for c, kind in (("seq", "long"), ("cache_key", "string"), ("at_ms", "long"), ("answer", "string"))]
    time = [c for c in requests.columns if c == "ts"]
    rows = requests.select(shard, *kept, *time, F.coalesce("accepted", F.lit(False)).alias("accepted"))
    timer = GroupStateTimeout.EventTimeTimeout if ttl_ms is not None else GroupStateTimeout.NoTimeout
    return rows.groupBy("shard").applyInPandasWithState(_shard(bound, ttl_ms), SERVED, "held string", "append", timer)
