"""The stream's cache against an ordered dictionary per shard, over restarts, bounds and times to live."""

from __future__ import annotations

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from arbitra.streaming import flows
from arbitra.streaming.cache import cached_answers

SCHEMA = "seq long, cache_key string, at_ms long, answer string, accepted boolean"


def requests(n, keys, seed=3):
    r = random.Random(seed)
    return [(i, None if i % 41 == 40 else f"k{min(r.randint(0, keys), r.randint(0, keys))}", 10**9 + 1000 * i, None if i % 17 == 3 else f"a{i}", None if i % 13 == 5 else r.random() < 0.7) for i in range(n)]


def brute(rows, shard_of, bound, ttl):
    caches: dict = {}
    for seq, key, now, answer, accepted in rows:
        cache = caches.setdefault(shard_of[key], OrderedDict())
        if key in cache and ttl and now - cache[key][1] >= ttl:
            cache.pop(key)
        gone = None
        if key in cache:
            cache.move_to_end(key)
            yield seq, key, True, cache[key][0], None
            continue
        if accepted and key is not None:
            cache[key] = (answer, now)
            if len(cache) > bound:
                gone = cache.popitem(last=False)[0]
        yield seq, key, False, answer, gone


@pytest.mark.parametrize(("bound", "shards", "ttl"), [(3, 2, None), (1, 1, None), (4, 3, 60_000)])
def test_equals_replay(spark, tmp_path, bound, shards, ttl):
    rows = requests(400, 25)
    schema = SCHEMA + ", ts timestamp, hit string"
    parts = [rows[:150], rows[150:160], rows[160:]]
    for n, part in enumerate(parts):  # each part is what comes before a restart
        df = spark.createDataFrame(part, SCHEMA).withColumns({"ts": F.timestamp_millis("at_ms"), "hit": F.lit("clash")})
        df.repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 second")
        flows.once(cached_answers(stream, bound, shards, ttl), f"{tmp_path}/cp").format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("seq", "cache_key", "hit", "answer", "evicted").collect()))
    shard_of = {r["cache_key"]: r["s"] for r in spark.createDataFrame(rows, SCHEMA).select("cache_key", F.pmod(F.xxhash64("cache_key"), F.lit(shards)).alias("s")).distinct().collect()}
    want = list(brute(rows, shard_of, bound, ttl))
    assert got == want
    assert 20 < sum(x[2] for x in want) < 380 and sum(x[4] is not None for x in want) > 10


def test_bounds(spark):
    stream = spark.readStream.format("rate").load()
    for bad in ({"bound": 0}, {"shards": 0}, {"ttl_ms": 0}):
        with pytest.raises(ValueError):
            cached_answers(stream, **bad)


def test_long_shards(tmp_path):
    """A shard of many requests is sorted in runs, and is never held whole."""
    import tracemalloc

    import pandas as pd

    from arbitra.streaming import cache

    n = 700_000
    frames = (pd.DataFrame({"seq": range(k, n, 70), "cache_key": [None if i % 9 == 0 else f"k{i % 50}" for i in range(k, n, 70)], "at_ms": [i // 3 for i in range(k, n, 70)], "answer": [f"a{i}" for i in range(k, n, 70)], "accepted": [i % 4 != 0 for i in range(k, n, 70)]}) for k in reversed(range(70)))

    class State:
        exists = hasTimedOut = False

        def update(self, held):
            self.held = held

    state, at, entries = State(), 0, cache.Entries(7, None)
    tracemalloc.start()
    for told in cache._shard(7, None)((0,), frames, state):
        for seq, key, hit, answer, gone in told.itertuples(index=False):
            assert seq == at and (hit, answer, gone) == entries.serve(key, at // 3, f"a{at}", at % 4 != 0)
            at += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == n and state.held == (entries.told(),) and peak < 60e6


def test_order_of_runs():
    import pandas as pd

    from arbitra.streaming import cache

    rows = [(at, seq, key, answer, bool(accepted)) for seq, key, at, answer, accepted in requests(500, 20)]
    rows = [(at // 7000, *rest) for at, *rest in rows]
    shuffled = random.Random(1).sample(rows, len(rows))
    names = ["at_ms", "seq", "cache_key", "answer", "accepted"]
    for run in (1, 7, 10_000):
        frames = (pd.DataFrame(shuffled[i : i + 11], columns=names) for i in range(0, 500, 11))
        assert list(cache._in_order(frames, run)) == sorted(rows, key=lambda x: x[:2])
