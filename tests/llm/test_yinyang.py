"""Against assigning every vector to every centroid; the query's SQL does it once more."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbitra.llm.yinyang import cluster_vectors, first_assignment, group_centroids, integer_vectors, next_assignment, squared, start_vectors


def brute(v, c, rounds):
    c = c.copy()
    for k in range(rounds + 1):
        d = ((v[:, None, :] - c[None]) ** 2).sum(2)
        cluster = d.argmin(1)
        if k < rounds:
            for j in range(len(c)):
                if (cluster == j).any():
                    c[j] = v[cluster == j].sum(0) // (cluster == j).sum()
    return cluster, d.min(1), c


@pytest.mark.parametrize("scale", [2, 20, 500, 1 << 23])
def test_bounds_rule_nothing_out(scale):
    r = np.random.default_rng(scale)
    saved = []
    for _ in range(15):
        n, d, k = r.integers(1, 400), r.integers(1, 9), r.integers(1, 30)
        v = r.integers(-scale, scale + 1, (n, d))
        v = np.concatenate([v, v[: n // 3]])  # ties and repeated rows
        c = v[:k].copy()
        group = group_centroids(c, int(r.integers(1, 12)))
        cluster, bounds = first_assignment(v, c, group)
        for _ in range(5):
            assert (cluster == ((v[:, None, :] - c[None]) ** 2).sum(2).argmin(1)).all()
            new = c.copy()
            for j in np.unique(cluster):
                new[j] = v[cluster == j].sum(0) // (cluster == j).sum()
            cluster, bounds, computed = next_assignment(v, cluster, bounds, c, new, group)
            saved.append(computed / (len(v) * len(c)))
            c = new
        exact = np.sqrt(((v[:, None, :] - c[None]) ** 2).sum(2).astype(float))
        assert (bounds[:, 0] >= exact[np.arange(len(v)), cluster]).all()
        exact[np.arange(len(v)), cluster] = np.inf
        for g in range(group.max() + 1):
            assert (bounds[:, g + 1] <= exact[:, group == g].min(1)).all()
    assert np.mean(saved) < 0.6


def test_squared_is_exact():
    r = np.random.default_rng(1)
    for scale in (5, 1 << 21, 1 << 26):
        v, c = r.integers(-scale, scale + 1, (50, 64)), r.integers(-scale, scale + 1, (7, 64))
        assert (squared(v, c) == ((v[:, None, :] - c[None]) ** 2).sum(2)).all()


def test_groups_hold_all_centroids():
    c = np.random.default_rng(2).integers(-9, 9, (40, 8))
    group = group_centroids(c)
    assert len(group) == 40 and set(group.tolist()) == set(range(group.max() + 1)) and group.max() < 4
    assert group_centroids(c[:1]).tolist() == [0] and group_centroids(np.zeros((25, 3), int)).max() == 0


SCHEMA = "vec_id long, embedding array<float>, cluster string, label int"


def test_odd_rows(spark):
    r = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in r.normal(size=4)], "c", 1) for k in range(300)]
    rows += rows[:40] + [(k, [0.5, 0.5, 0.5, 0.5], "hot", 2) for k in range(400, 550)]
    bad = [(900, None, "", 0), (901, [], "", 0), (902, [1.0, 2.0, 3.0], "", 0), (903, [1.0, None, 2.0, 3.0], "", 0), (904, [1.0, float("nan"), 2.0, 3.0], "", 0), (905, [float("inf"), 1.0, 1.0, 1.0], "", 0)]
    keyless = [(None, [0.1, -0.2, 0.3, 0.4], None, None)]
    table = spark.createDataFrame(rows + bad + keyless, SCHEMA).repartition(5)
    vectors = integer_vectors(table, 4, 256)
    start = start_vectors(vectors, F.col("vec_id"), 12, 4)
    good = rows + keyless
    v = np.floor(np.array([x[1] for x in good], np.float32).astype(float) * 256).astype(int)
    ids = [x[0] for x in good]
    first = sorted((i is None, i or 0, v[k].astype("<i8").tobytes()) for k, i in enumerate(ids))[:12]
    assert start.tolist() == [np.frombuffer(x[2], np.int64).tolist() for x in first]
    found, centroids = cluster_vectors(vectors, start, 4, per_group=3)
    cluster, distance, want = brute(v, start, 4)
    assert centroids.tolist() == want.tolist()
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, found.collect()), key=order) == sorted(zip(ids, cluster.tolist(), distance.tolist(), strict=True), key=order)


def test_no_rows_and_few(spark):
    none = integer_vectors(spark.createDataFrame([], SCHEMA), 4, 256)
    assert cluster_vectors(none, start_vectors(none, F.col("vec_id"), 3, 4), 2)[0].count() == 0
    one = integer_vectors(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], "", 0)], SCHEMA), 4, 256)
    found, _ = cluster_vectors(one, start_vectors(one, F.col("vec_id"), 3, 4), 2)
    assert list(map(tuple, found.collect())) == [(1, 0, 0)]


def test_too_large(spark):
    big = spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], "", 0)], SCHEMA)
    with pytest.raises(Exception, match="distances wouldn't be exact"):
        integer_vectors(big, 4, 256).count()
