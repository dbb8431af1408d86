"""Against brute force over full shingle sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from conftest import LOREM, SCHEMA, prose

from arbitra.llm import near_dedup
from arbitra.llm.graph import connected_components
from arbitra.llm.near_dedup import drop_near_duplicates, near_duplicates, neighbours


def shingles(text):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c < "\x80" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_odd(odd, none):
    df = near_duplicates(odd)
    assert df.count() == odd.count()
    assert got(df) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert near_duplicates(none).count() == 0
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 6 or doc_id = 7").count() == 0


def test_random_edits(spark):
    r = random.Random(8)
    rows = []
    for base in range(12):
        words = prose(100 + base, 120).split()
        for _ in range(8):
            w = list(words)
            for _ in range(r.choice([0, 1, 2, 3, 4, 8])):
                w[r.randrange(len(w))] = r.choice(LOREM) + "ly"
            rows.append(" ".join(w))
    # a passage that many share without being alike
    rows += [prose(7, 40) + " " + prose(500 + i, 150) for i in range(60)]
    r.shuffle(rows)
    data = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, "en", "s", len(t), "") for i, t in data], SCHEMA)
    assert got(near_duplicates(df)) == brute(data)


def test_one_large_group(spark):
    r = random.Random(3)
    words = prose(55, 100).split()
    data = []
    for i in range(400):
        w = list(words)
        w[r.randrange(100)] = f"w{i}"
        data.append((i, " ".join(w)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t), "") for i, t in data], SCHEMA)
    assert got(near_duplicates(df)) == brute(data)


ROWS = "first long, deep long, rest binary, node long, prints binary"


def test_neighbours_cross_partitions(spark):
    """All rows of one region: each meets its predecessor wherever the order is cut."""
    n = 300
    prints = bytes(60)
    rows = spark.createDataFrame([(1, 1, i.to_bytes(4, "big"), i, prints) for i in range(n)], ROWS)
    pairs, crowded = neighbours(rows, 3)
    assert {(i, i + 1) for i in range(n - 1)} <= {(r["a"], r["b"]) for r in pairs.collect()}
    assert {(r["region"], r["node"]) for r in crowded.collect()} == {(1, i) for i in range(n)}


def test_crowded_regions_only(spark):
    """A region of two inside a part has its one pair looked at and needs no more."""
    rows = spark.createDataFrame([(i // 2, i // 2, i.to_bytes(4, "big"), i, bytes(60)) for i in range(400)] + [(7, 7, bytes(4), 1000, bytes(60))], ROWS)
    crowded = {}
    for r in neighbours(rows, 3)[1].collect():
        crowded.setdefault(r["region"], set()).add(r["node"])
    assert crowded[7] == {14, 15, 1000}
    assert len(crowded) <= 1 + 2 * 4


def test_repeated_ids(spark):
    """Two texts of one doc_id are texts of their own; of exact repeats one row stays."""
    a, b = prose(41, 60), prose(42, 60)
    rows = [(5, a), (5, b), (7, a), (7, a), (3, b), (9, prose(43, 60)), (9, prose(43, 60)), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, "en", "s", k, "") for k, (i, t) in enumerate(rows)], SCHEMA)
    found = sorted(((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_duplicates(df).collect()))
    assert found == [(0, 0, True)] * 2 + [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (7, 5, False), (9, 9, True), (9, 9, True)]
    left = sorted((r["doc_id"] or 0, r["text"] == a, r["text"] == b) for r in drop_near_duplicates(df).collect())
    assert left == [(0, True, False)] * 2 + [(3, False, True), (5, True, False), (9, False, False)]


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, prose(1, 50), 1, 2), (2, prose(1, 50), 3, 4)], "doc_id long, text string, doc long, Whole long")
    assert [r.asDict() for r in drop_near_duplicates(rows).collect()] == [{"doc_id": 1, "text": prose(1, 50), "doc": 1, "Whole": 2}]


def test_dense_background(spark, monkeypatch):
    """Texts that share most of a form, compared with one neighbour each at first."""
    r = random.Random(12)
    form = prose(600, 75)
    data = []
    for i in range(200):
        own = prose(700 + i // 2, 25).split()
        if i % 2:
            own[r.randrange(12, 25)] = "changed"
        data.append((i, form + " " + " ".join(own)))
    r.shuffle(data)
    monkeypatch.setattr(near_dedup, "neighbours", lambda rows: neighbours(rows, 1))
    df = spark.createDataFrame([(i, t, "en", "s", len(t), "") for i, t in data], SCHEMA)
    want = brute(data)
    assert 90 < sum(not x[2] for x in want.values()) < 110
    assert got(near_duplicates(df)) == want


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    r = np.random.default_rng(1)
    edges = {"chain": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 300)], "random": r.integers(0, 400, (300, 2)).tolist(), "none": []}[shape]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    df = spark.createDataFrame([tuple(map(int, e)) for e in edges] + [tuple(map(int, e)) for e in edges[:5]], "a long, b long")
    rows = {x["node"]: x["component"] for x in connected_components(df).collect()}
    alone = {x for x in root if all(x not in e or e[0] == e[1] for e in edges)}
    assert rows == {x: find(x) for x in root if x not in alone}
