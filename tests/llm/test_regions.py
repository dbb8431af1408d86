"""The inverted index against set intersections."""

from __future__ import annotations

import numpy as np

from arbitra.llm import regions


def test_similar_pairs(monkeypatch):
    r = np.random.default_rng(1)
    for _ in range(150):
        for name, most in (("MANY", 40), ("COLUMNS", 20), ("COUNTED", 5000)):
            monkeypatch.setattr(regions, name, int(r.integers(1, most)))
        n = int(r.integers(1, 60))
        key, core = np.sort(r.integers(0, 4, n)), r.integers(0, 50, 30)
        sets = [np.unique(np.concatenate([core[r.random(30) < 0.9], r.integers(0, 500, int(r.integers(0, 8)))]) if r.random() < 0.9 else core[:0]).astype(np.uint64) for _ in range(n)]
        got = {(int(i), int(j)) for x in regions.similar_pairs(key, sets, 75) for i, j in zip(*x, strict=True)}
        want = set()
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if key[i] == key[j] and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    want.add((i, j))
        assert got == want


def test_blocks(spark, monkeypatch):
    """Two nodes far apart in a region are linked in whichever blocks they are; what is joined already isn't."""

    def sets_of(payload):
        return [np.frombuffer(x, np.uint64) for x in payload.to_pylist()]

    r = np.random.default_rng(4)
    sets = [np.sort(r.integers(0, 1 << 60, 20)).astype(np.uint64) for _ in range(300)]
    sets[290] = sets[3]
    payloads = spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in enumerate(sets)], "node long, weight long, payload binary")
    rows = spark.createDataFrame([(1 + (i > 295), i, len(s)) for i, s in enumerate(sets)] + [(9, 3, 20), (9, 290, 20)], "region long, node long, weight long")
    for block in (1000, 1 << 20):
        monkeypatch.setattr(regions, "BLOCK", block)
        none = spark.createDataFrame([], "node long, component long")
        found = regions.region_links(regions.mixed_regions(rows, none), payloads, sets_of, 75)
        assert [tuple(x) for x in found.collect()] == [(3, 290)]
        joined = spark.createDataFrame([(3, 3), (290, 3)], "node long, component long")
        assert regions.region_links(regions.mixed_regions(rows, joined), payloads, sets_of, 75).count() == 0


def test_joined_labels(spark):
    components = spark.createDataFrame([(2, 1), (1, 1), (5, 4), (4, 4), (9, 8), (8, 8)], "node long, component long")
    links = spark.createDataFrame([(1, 4), (3, 4), (6, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in regions.joined(components, links).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 5: 1, 3: 1, 8: 8, 9: 8, 6: 6, 7: 6}
