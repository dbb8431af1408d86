"""Against a scan of every lag word by word, and the query against its rule told again."""

from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow.parquet as pq
import pytest

from arbitra.llm.periodic import collapse, lag_ranges, periodic_runs, scan, word_ids
from arbitra.llm.queries import op11_periodic_runs

SF = "/root/testdata/sf0.001"


def brute(words, exponent, least):
    """Every lag compared whole; a stretch counts if no smaller period holds in it."""
    _, ids = np.unique(np.array(words), return_inverse=True) if len(words) else (None, np.zeros(0, int))
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        same = ids[:-q] == ids[q:]
        i = 0
        while i < n - q:
            if not same[i]:
                i += 1
                continue
            j = i
            while j < n - q and same[j]:
                j += 1
            part = ids[i : j + q]
            if len(part) >= max(least, exponent * q) and not any((part[:-p] == part[p:]).all() for p in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(r):
    words = []
    for _ in range(r.randint(0, 5)):
        words += [bytes([97 + r.randint(0, r.choice([0, 1, 2, 5]))]) for _ in range(r.randint(1, 8))] * r.randint(1, 7)
    return words


def test_equals_brute_force():
    r = random.Random(5)
    for _ in range(1500):
        words, exponent, least = repetitive(r), r.choice([3, 4, 4, 5]), r.choice([1, 6, 9])
        want = brute(words, exponent, least)
        assert sorted(scan(word_ids(words), 1, len(words), exponent, least), key=lambda x: (x[0], x[2])) == want
        parts = [x for a, b in lag_ranges(len(words), exponent, r.choice([5, 20, 100])) for x in scan(word_ids(words), a, b, exponent, least)]
        assert sorted(set(parts), key=lambda x: (x[0], x[2])) == want and len(parts) == len(want)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 7, 100, 5000])
def test_ranges_hold_every_lag_once(n):
    for work in (1, 50, 10_000):
        lags = [q for a, b in lag_ranges(n, 4, work) for q in range(a, b + 1)]
        assert lags == list(range(1, n // 4 + 1))


def test_collapse():
    assert collapse(b"a b a b a b a b c".split(), [(0, 8, 2)]) == b"a b c"
    assert collapse(b"x x x x x x y y y y y y".split(), [(0, 6, 1), (6, 6, 1)]) == b"x y"


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(None, "go " * 9), (70, "a b " * 20_000), (71, "same\x00 " * 3 + "é\u3000é " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = []
    for key, text in rows:
        words = (text or "").encode().split()
        runs = brute(words, 4, 6) if len(words) < 2000 else sorted(scan(word_ids(words), 1, len(words), 4, 6), key=lambda x: (x[0], x[2]))
        want.append((key, runs, collapse(words, runs).decode()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for settings in ({}, {"long": 0, "work": 500}):
        got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs, **settings).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert (70, [(0, 40_000, 2)], "a b") in want
    assert periodic_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, exponent=2)


def expected(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute(words, 4, 6)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    s, size, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    told = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), s, size, q, 1000 * size // q if runs else None, sha256(told.encode()).hexdigest(), sha256(left).hexdigest())


def test_query(spark):
    got = sorted(map(tuple, op11_periodic_runs(spark, SF).collect()))
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    small = {d["doc_id"]: d["text"] for d in docs if len(d["text"] or "") < 6000}
    assert len(got) == len(docs) and len(small) > 150
    assert [r for r in got if r[0] in small] == sorted(expected(*d) for d in small.items())
    assert sum(r[1] > 0 for r in got) > 5
