"""Centroid clustering by Yinyang grouping, in exact integers.

Centroids are clustered into groups once. Each vector carries its cluster, an upper
bound of the distance to its centroid and one lower bound per group for the distances to
that group's other centroids. When centroids have moved, a vector whose least lower bound
is above its upper bound keeps its cluster (global filter); of the others only groups
whose lower bound isn't above are scanned, exactly (group filter).

Vectors are integers, and so are squared distances and means (floors), so that results
don't depend on how rows are dealt. Bounds are floats, rounded away from the exact value;
equal distances are never ruled out. One round is one pass over the vectors and their
bounds, written to the shared folder, and one sum per cluster and component, added up in
each task first. Only centroids and sums of clusters, whose number is a parameter, ever
reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import materialize

#: Vectors of a cluster share a group of about so many centroids.
PER_GROUP = 10
#: Components above this can't be squared and summed in 64 bits.
LARGEST = 1 << 26
#: Below this, products and their sums are exact in floats.
EXACT = 1 << 22
_STATE = "vec_id long, vector binary, cluster int, bounds binary"


def integer_vectors(rows: DataFrame, size: int, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, vector``: floors of ``scale`` times each component, as 64-bit integers in one binary.

    Rows whose vector is null, has another number of components or one that is null or
    not finite are left out. A component that is too large for exact distances is an error.
    """
    fit = (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = rows.where(F.coalesce(fit, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scaled = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False) * scale)
            if len(scaled) and np.abs(scaled).max() > LARGEST:
                raise OverflowError(f"a component is beyond {LARGEST} after scaling: distances wouldn't be exact")
            yield pa.record_batch([batch.column(0), _pack(scaled.astype(np.int64).reshape(-1, size))], names=["vec_id", "vector"])

    return kept.mapInArrow(run, "vec_id long, vector binary")


def _pack(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binaries."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.itemsize * matrix.shape[1]
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())])


def _unpack(column: pa.Array, kind: type, width: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(-1, width)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All squared distances, exact."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        product = (v @ c.T).astype(np.int64)
        return (vectors**2).sum(1)[:, None] - 2 * product + (centroids**2).sum(1)[None, :]
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def roots(exact: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of integers, never below (or above) the exact value."""
    x = np.sqrt(exact.astype(np.float64))  # off by one unit in the last place of either step
    return above(above(x)) if up else below(below(x))


def group_centroids(centroids: np.ndarray, per_group: int = PER_GROUP, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: nearest of as many seeds, spread over the centroids' order, after some rounds of means."""
    k = len(centroids)
    n = max(1, -(-k // per_group))
    seeds = centroids[np.arange(n) * k // n].astype(np.float64)
    for _ in range(rounds):
        group = ((centroids[:, None, :] - seeds[None]) ** 2).sum(2).argmin(1)
        seeds = np.stack([centroids[group == g].mean(0) if (group == g).any() else seeds[g] for g in range(n)])
    _, group = np.unique(group, return_inverse=True)
    return group


def first_assignment(vectors: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, bounds) of each vector: the upper bound, then one lower bound per group."""
    exact = squared(vectors, centroids)
    cluster = exact.argmin(1)  # the first of equal ones
    rows = np.arange(len(vectors))
    bounds = np.full((len(vectors), group.max() + 2), np.inf)
    bounds[:, 0] = roots(exact[rows, cluster], True)
    far = exact.astype(np.float64)
    far[rows, cluster] = np.inf
    for g in range(group.max() + 1):
        bounds[:, g + 1] = below(below(np.sqrt(far[:, group == g].min(1))))
    return cluster, bounds


def next_assignment(vectors: np.ndarray, cluster: np.ndarray, bounds: np.ndarray, old: np.ndarray, new: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, bounds, distances computed) after centroids went from ``old`` to ``new``."""
    groups = group.max() + 1
    moved = roots(((new - old) ** 2).sum(1), True)
    moved[(new == old).all(1)] = 0.0
    cluster, bounds = cluster.copy(), bounds.copy()
    bounds[:, 0] = above(bounds[:, 0] + moved[cluster])
    for g in range(groups):
        bounds[:, g + 1] = below(bounds[:, g + 1] - moved[group == g].max())
    # the global filter, with the bound as it is and with the exact distance
    rows = np.flatnonzero(bounds[:, 1:].min(1) <= bounds[:, 0])
    own = ((vectors[rows] - new[cluster[rows]]) ** 2).sum(1)
    computed = len(rows)
    bounds[rows, 0] = roots(own, True)
    still = bounds[rows, 1:].min(1) <= bounds[rows, 0]
    rows, own = rows[still], own[still]
    if not len(rows):
        return cluster, bounds, computed
    was, best, best_exact = cluster[rows], cluster[rows], own.copy()
    exact: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(groups):
        scan = np.flatnonzero(bounds[rows, g + 1] <= bounds[rows, 0])
        if not len(scan):
            continue
        members = np.flatnonzero(group == g)
        d = squared(vectors[rows[scan]], new[members])
        computed += d.size
        exact.append((scan, members, d))
        at = d.argmin(1)
        least, named = d[np.arange(len(scan)), at], members[at]
        better = (least < best_exact[scan]) | ((least == best_exact[scan]) & (named < best[scan]))
        best[scan[better]], best_exact[scan[better]] = named[better], least[better]
    # a group that was scanned: the exact distance of its nearest centroid other than the vector's own
    for scan, members, d in exact:
        far = np.where(members[None, :] == best[scan][:, None], np.inf, d.astype(np.float64))
        bounds[rows[scan], group[members[0]] + 1] = below(below(np.sqrt(far.min(1))))
    # the one left behind counts among its group's others, whether that was scanned or not
    left = np.flatnonzero(best != was)
    at = (rows[left], group[was[left]] + 1)
    bounds[at] = np.minimum(bounds[at], roots(own[left], False))
    cluster[rows] = best
    bounds[rows, 0] = roots(best_exact, True)
    return cluster, bounds, computed


def _assign_first(centroids: np.ndarray, group: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                vectors = _unpack(batch.column(1), np.int64, centroids.shape[1])
                cluster, bounds = first_assignment(vectors, centroids, group)
                yield pa.record_batch([*batch.columns, pa.array(cluster.astype(np.int32)), _pack(bounds)], names=["vec_id", "vector", "cluster", "bounds"])

    return run


def _assign_next(old: np.ndarray, new: np.ndarray, group: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                vectors = _unpack(batch.column(1), np.int64, new.shape[1])
                bounds = _unpack(batch.column(3), np.float64, group.max() + 2)
                cluster, bounds, _ = next_assignment(vectors, batch.column(2).to_numpy(), bounds, old, new, group)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), _pack(bounds)], names=["vec_id", "vector", "cluster", "bounds"])

    return run


def _sums(size: int, k: int) -> Callable:
    """Number and sum of the vectors of each cluster, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            vectors = _unpack(batch.column(0), np.int64, size)
            cluster = batch.column(1).to_numpy()
            order = np.argsort(cluster, kind="stable")
            named, begin = np.unique(cluster[order], return_index=True)
            if len(named):
                total[named] += np.add.reduceat(vectors[order], begin, axis=0)
                number += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(number)
        if len(some):
            yield pa.record_batch(
                [pa.array(np.repeat(some, size)), pa.array(np.tile(np.arange(size), len(some))), pa.array(np.repeat(number[some], size)), pa.array(total[some].ravel())],
                names=["cluster", "component", "number", "total"],
            )

    return run


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; an empty cluster keeps its centroid."""
    k, size = centroids.shape
    sums = state.select("vector", "cluster").mapInArrow(_sums(size, k), "cluster long, component long, number long, total long")
    out = centroids.copy()
    # as many rows as clusters have components
    for r in sums.groupBy("cluster", "component").agg(F.sum("number").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["cluster"], r["component"]] = int(r["total"]) // r["n"]
    return out


def _distances(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _unpack(batch.column(1), np.int64, centroids.shape[1])
            cluster = batch.column(2).to_numpy()
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(((vectors - centroids[cluster]) ** 2).sum(1))], names=["vec_id", "cluster", "distance"])

    return run


def start_vectors(vectors: DataFrame, order: Column, k: int, size: int) -> np.ndarray:
    """The first ``k`` vectors by ``order``; equal ones by their bytes, a null one comes last."""
    first = vectors.select("vector", order.alias("at")).orderBy(F.col("at").asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return np.frombuffer(b"".join(bytes(r["vector"]) for r in first), np.int64).reshape(-1, size)


def cluster_vectors(vectors: DataFrame, start: np.ndarray, rounds: int, per_group: int = PER_GROUP) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, cluster, distance`` of each row, final centroids) after ``rounds`` of assigning and averaging.

    ``vectors`` come from ``integer_vectors``, ``start`` has the first centroid of each
    cluster. Every row goes to its nearest centroid, the smaller number among equals; then
    every cluster that isn't empty takes the floor of its mean. At the end rows are
    assigned once more. Repeated rows count as often as they occur, a null key is kept,
    no rows give no rows. ``distance`` is squared.
    """
    spark = vectors.sparkSession
    if not len(start):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), start
    centroids, group = start, group_centroids(start, per_group)
    state = materialize(vectors.mapInArrow(_assign_first(centroids, group), _STATE), "clusters")
    for _ in range(rounds):
        before, centroids = centroids, _means(state, centroids)
        state = materialize(state.mapInArrow(_assign_next(before, centroids, group), _STATE), "clusters")
    return state.select("vec_id", "vector", "cluster").mapInArrow(_distances(centroids), "vec_id long, cluster int, distance long"), centroids
