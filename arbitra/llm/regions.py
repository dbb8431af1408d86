"""All links inside the regions of a candidate search, however large a region is.

A region is a set of nodes that a search puts together: documents that share the
first values of a signature, lines of one band's bucket. Those whose nodes confirmed
links join already have nothing to add. The others are split in blocks of bounded
size, each two blocks meet in a task of their own, and there the sets of all nodes
are intersected exactly by an inverted index. A task hands on the links that join
nodes anew, so its output is never longer than its input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .session import materialize

#: Set members of a block, as told by ``weight``.
BLOCK = 1 << 18
#: Members that are indexed at a time in a task, and entries of the index that are counted at a time.
HELD, COUNTED = 1 << 19, 1 << 20
#: In keys of so many rows, members that one in ``COMMON`` rows has are counted by matrix products, ``COLUMNS`` at a time.
MANY, COMMON, COLUMNS = 16, 4, 1024

#: The sorted distinct members of the set of each payload.
Sets = Callable[[pa.Array], list[np.ndarray]]


def mixed_regions(rows: DataFrame, components: DataFrame) -> DataFrame:
    """``rows(region, node, weight)`` of regions whose nodes ``components(node, component)`` doesn't join, with ``label`` and ``blocks``."""
    labelled = rows.join(components, "node", "left").select("region", "node", "weight", F.coalesce("component", "node").alias("label"))
    labelled = materialize(labelled, "regions")
    mixed = (
        labelled.groupBy("region")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"), F.sum("weight").alias("weight"))
        .filter("least <> most")
        .select("region", F.ceil(F.col("weight") / BLOCK).cast("int").alias("blocks"))
    )
    return labelled.select("region", "node", "label").join(mixed, "region")


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ..`` for each k, ``n[k]`` of them."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def similar_pairs(key: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), j < i, of rows of one key (keys rise) whose sets have that similarity, in the order of i."""
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    if not len(row):
        return
    members = np.concatenate(sets)
    order = np.argsort(members, kind="stable")
    members, rows = members[order], row[order]
    new = np.append(True, (members[1:] != members[:-1]) | (key[rows[1:]] != key[rows[:-1]]))
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]
    # of each member of each row: where its earlier rows stand in the index, and how many there are
    begin_of, earlier = np.empty_like(begin), np.empty_like(begin)
    begin_of[order], earlier[order] = begin, np.arange(len(begin)) - begin
    ends, starts = np.cumsum(size), np.cumsum(size) - size
    first_of_key = np.searchsorted(key, key)
    rows_of_key = np.searchsorted(key, key, "right") - first_of_key
    frequent = np.bincount(np.cumsum(new) - 1)
    common = np.flatnonzero((frequent >= rows_of_key[rows[new]] / COMMON) & (rows_of_key[rows[new]] >= MANY))
    dense = _dense(first_of_key, rows, np.flatnonzero(new), frequent, common)
    earlier[order[_ragged(np.flatnonzero(new)[common], frequent[common])]] = 0
    cost = np.append(0, np.cumsum(earlier))[ends]
    x = 0
    while x < len(sets):
        before = cost[x - 1] if x else 0
        y = max(x + 1, int(np.searchsorted(cost, before + COUNTED, "right")))
        base = int(first_of_key[x])
        if matrix := dense.get(base):
            y = min(y, base + int(rows_of_key[x]), x + max(1, COUNTED // int(rows_of_key[x])))
        elif dense:
            y = min([y, *(k for k in dense if k > x)])
        e, width = slice(starts[x], ends[y - 1]), y - base
        n = earlier[e]
        code = (np.repeat(row[e], n) - x) * width + rows[_ragged(begin_of[e], n)] - base
        if matrix:
            both = np.zeros((y - x, width), np.float32)
            for m in matrix:
                both += m[x - base : y - base] @ m[:width].T
            both = both.ravel().astype(np.int64)
            if len(code):
                more = np.bincount(code)
                both[: len(more)] += more
            code = np.flatnonzero((both > 0) & (np.tile(np.arange(width), y - x) < np.repeat(np.arange(x, y) - base, width)))
            both = both[code]
        elif (y - x) * width <= 4 * len(code):
            both = np.bincount(code)
            code = np.flatnonzero(both)
            both = both[code]
        else:
            code, both = np.unique(code, return_counts=True)
        i, j = x + code // width, base + code % width
        keep = 100 * both >= percent * (size[i] + size[j] - both)
        yield i[keep], j[keep]
        x = y


def _dense(first_of_key: np.ndarray, rows: np.ndarray, begin: np.ndarray, frequent: np.ndarray, common: np.ndarray) -> dict[int, list[np.ndarray]]:
    """By the first row of a key: which of its rows have which common members, in pieces of some columns."""
    out: dict[int, list[np.ndarray]] = {}
    base = first_of_key[rows[begin[common]]]
    for key in np.unique(base).tolist():
        some = common[base == key]
        width = int(np.searchsorted(first_of_key, key, "right")) - key
        for c in range(0, len(some), COLUMNS):
            piece = some[c : c + COLUMNS]
            m = np.zeros((width, len(piece)), np.float32)
            m[rows[_ragged(begin[piece], frequent[piece])] - key, np.repeat(np.arange(len(piece)), frequent[piece])] = 1
            out.setdefault(key, []).append(m)
    return out


def _links(sets_of: Sets, percent: int) -> Callable:
    def links(rows: pa.Table) -> pa.RecordBatch:
        region, low, high, block, label = (rows[c].to_numpy() for c in ("region", "low", "high", "block", "label"))
        key = np.cumsum(np.append(0, (np.diff(region) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)))
        label, a, b = label.copy(), [], []
        for i, j in similar_pairs(key, sets_of(rows["payload"].combine_chunks()), percent):
            some = np.flatnonzero((label[i] != label[j]) & ((low[i] == high[i]) | (block[i] != block[j])))
            for p, q in zip(i[some].tolist(), j[some].tolist(), strict=True):
                x, y = sorted((label[p], label[q]))
                if x != y:
                    a.append(x)
                    b.append(y)
                    label[label == y] = x
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of labels, of each (region, low, high), whose rows come together."""
        held, members = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, z = (batch.column(c).to_numpy() for c in range(3))
            cut = np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(z) != 0)) + 1
            if held and [held[-1].column(c)[-1].as_py() for c in range(3)] != [int(v[0]) for v in (x, y, z)]:
                cut = np.append(0, cut)
            weight = np.cumsum(batch.column("weight").to_numpy())
            done = 0
            # whole keys, as many as there is room for
            for c in cut.tolist():
                more = int(weight[c - 1]) if c else 0
                if members + more - (int(weight[done - 1]) if done else 0) >= HELD:
                    held.append(batch.slice(done, c - done))
                    yield links(pa.Table.from_batches(held))
                    held, members, done = [], 0, c
            held.append(batch.slice(done))
            members += int(weight[-1]) - (int(weight[done - 1]) if done else 0)
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def region_links(rows: DataFrame, payloads: DataFrame, sets_of: Sets, percent: int) -> DataFrame:
    """Links (a < b) between the labels of each region of :func:`mixed_regions`; ``payloads`` has node, weight and payload of each.

    They join all labels that a pair of similar nodes joins, and no others.
    """
    met = (
        rows.join(payloads, "node")
        .withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "label", "weight", "payload")
        .repartition("region", "low", "high")
        .sortWithinPartitions("region", "low", "high")
    )
    return met.mapInArrow(_links(sets_of, percent), "a long, b long").distinct()


def joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components(node, component)`` after their labels have been linked further."""
    more = connected_components(links)
    both = components.join(more.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
    known = both.select("node", F.coalesce("least", "component").alias("component"))
    # labels that were nodes without a link so far
    fresh = more.join(components.select("node"), "node", "left_anti")
    return known.unionByName(fresh.select("node", "component"))
