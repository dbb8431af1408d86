"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Every text becomes its set of distinct five-word shingles and ``TREES`` short
   MinHash signatures of ``DEPTH`` values. Texts with equal sets are one class
   from here on, so thousands of exact copies weigh as much as one text.
2. Per tree, all classes are put in one order by their signature (range
   partitions, which split any hot region evenly). Classes next to each other
   share the longest prefixes: each looks back over its ``window`` predecessors
   that share a prefix with it. In a sparse region one common value is prefix
   enough; in a dense one only deeper prefixes stand within the window. The ends
   of partitions are joined to the starts of the next in a step of their own.
3. A predecessor is a candidate unless the rest of the signature rules it out,
   or both seem to be joined already by near-certain candidates of the same window.
4. Candidates are confirmed on the full sets, and confirmed links become
   components by alternating stars.
5. Where rows share ``FULL`` values, one value doesn't leave it at that: the full
   sets of all that confirmed links don't join yet are compared there, exactly and
   in blocks that split a region of any size over tasks (``regions``). Of pairs at
   75 percent, all but 1 in 20,000 share so many values in one of the trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .kernels import U64, WordHasher, binary_rows, chunks, mix, shingle_sets, space_separated, stream, string_buffers
from .regions import joined, mixed_regions, region_links
from .session import fresh, materialize, partitions, small_batches

SHINGLE = 5
TREES, DEPTH = 12, 5
WINDOW = 10
#: Of the 60 signature values, the share that must agree: a pair of similarity
#: 0.75 falls below this 4.5 standard deviations under its mean.
PLAUSIBLE = 0.5
#: From this share on, a pair may stand for the links that it makes redundant.
CERTAIN = 0.9

#: Values of a tree's signature that make a region in which all pairs are compared.
FULL = 2

_XOR = stream(11, TREES * DEPTH)
_TIMES = stream(12, TREES * DEPTH) | U64(1)


def minhash(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``TREES * DEPTH`` values for each row of the ragged sets; no row may be empty."""
    out = np.empty((len(offsets) - 1, TREES * DEPTH), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(TREES * DEPTH):
            least = np.minimum.reduceat((x ^ _XOR[k]) * _TIMES[k], offsets[:-1])
            out[:, k] = mix(least) >> U64(32)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, pack = WordHasher(space_separated()), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        raw, offsets = string_buffers(batch.column(1))
        for i, j, data, off in chunks(raw, offsets):
            h, rows = words(data, off)
            x, sets = shingle_sets(h, rows, SHINGLE)
            n = np.diff(sets)
            full = np.flatnonzero(n)
            sig = np.zeros((j - i, TREES * DEPTH), np.uint32)
            k1, k2 = np.zeros(j - i, U64), np.zeros(j - i, U64)
            if len(full):
                begin = sets[:-1][full]
                sig[full] = minhash(x, np.append(begin, len(x)))
                with np.errstate(over="ignore"):
                    k1[full] = np.add.reduceat(mix(x), begin)
                    k2[full] = np.bitwise_xor.reduceat(mix(x + U64(0x51ED27)), begin)
            packed = [pack.compress(data[off[k] : off[k + 1]].tobytes()) for k in range(j - i)]
            yield pa.record_batch(
                [*(batch.column(c).slice(i, j - i) for c in (0, 2, 3)), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), binary_rows(sig), pa.array(packed, pa.binary())],
                names=["doc_id", "row", "whole", "n_shingles", "k1", "k2", "sig", "packed"],
            )


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_rows
        node = batch.column(0).to_numpy()
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, TREES, DEPTH)
        prints = binary_rows((sig.reshape(n, -1) & 255).astype(np.uint8))
        for t in range(TREES):
            first = (np.int64(t) << 32) + sig[:, t, 0].astype(np.int64)
            with np.errstate(over="ignore"):
                deep = first.view(U64)
                for k in range(1, FULL):
                    deep = mix(deep) + sig[:, t, k]
            yield pa.record_batch(
                [pa.array(first), pa.array(deep.view(np.int64)), binary_rows(sig[:, t, 1:].astype(">u4")), pa.array(node), prints], names=["first", "deep", "rest", "node", "prints"]
            )


def _agree(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Estimated similarity; one byte of each value agrees by chance in 1 of 256."""
    same = (prints[i] == prints[j]).mean(axis=1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _look_back(first: np.ndarray, node: np.ndarray, prints: np.ndarray, new: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of rows ``new``.. with their predecessors, in signature order."""
    n = len(first)
    close, certain = [], []
    for k in range(1, min(window, n - 1) + 1):
        i = np.arange(max(new, k), n)
        i = i[first[i] == first[i - k]]
        if len(i):
            s = _agree(prints, i, i - k)
            keep = s >= PLAUSIBLE
            close.append(np.stack([i[keep], i[keep] - k, s[keep] >= CERTAIN], axis=1).astype(np.int64))
    if not close:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # nearest first; what near-certain nearer candidates join already is left out
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j, sure in np.concatenate(close).tolist():
        p, q = find(i), find(j)
        if p != q:
            certain.append((i, j))
            if sure:
                root[max(p, q)] = min(p, q)
    at = np.array(certain, np.int64).reshape(-1, 2)
    return node[at[:, 0]], node[at[:, 1]]


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), len(rows[0]))


def _runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the run of equal values, its length) of each row."""
    run = np.cumsum(np.append(0, np.diff(first) != 0))[: len(first)]
    return run, np.bincount(run)[run] if len(run) else run


def _neighbours(window: int) -> Callable:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("end", pa.int32()), ("at", pa.int32()), ("first", pa.int64()), ("prints", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates inside a part of the order, the rows at its start (end=0) and end (end=1), and those of crowded regions (no b, no part).

        A region at an end of the part counts as crowded, since it may go on in the next.
        """
        part, seen, first, deep, node, prints = None, 0, None, None, None, None
        # the region that the part starts with; whether the last region's rows have been given
        begin, given = None, False

        def ends(rows: slice, end: int) -> pa.RecordBatch:
            m = len(first[rows])
            return pa.record_batch(
                [pa.array(node[rows]), pa.nulls(m, pa.int64()), pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, end, np.int32)), pa.array(np.arange(m, dtype=np.int32)), pa.array(first[rows]), binary_rows(prints[rows])],
                schema=schema,
            )

        def crowd(rows: np.ndarray) -> pa.RecordBatch:
            m = len(rows)
            return pa.record_batch([pa.array(node[rows]), pa.nulls(m, pa.int64()), *(pa.nulls(m, pa.int32()) for _ in range(3)), pa.array(deep[rows]), pa.nulls(m, pa.binary())], schema=schema)

        def close() -> Iterator[pa.RecordBatch]:
            yield ends(slice(-window, None), 1)
            if not given:
                yield crowd(np.flatnonzero(deep == deep[-1]))

        for batch in batches:
            if not batch.num_rows:
                continue
            parts, firsts, deeps, nodes = (batch.column(c).to_numpy() for c in range(4))
            more = _matrix(batch.column(4).to_pylist())
            cut = np.flatnonzero(np.diff(parts)) + 1
            for s, e in zip(np.append(0, cut), np.append(cut, len(parts)), strict=True):
                if parts[s] != part:
                    if seen:
                        yield from close()
                    part, seen, first, deep, node, prints = int(parts[s]), 0, firsts[:0], deeps[:0], nodes[:0], more[:0]
                    begin, given = deeps[s], False
                old = len(first)
                first, deep, node, prints = (np.concatenate([x, y[s:e]]) for x, y in ((first, firsts), (deep, deeps), (node, nodes), (prints, more)))
                # a row that comes again counts once
                once = np.append(True, (np.diff(deep) != 0) | (np.diff(node) != 0))
                first, deep, node, prints = first[once], deep[once], node[once], prints[once]
                if len(first) == old:
                    continue
                if seen < window:
                    yield ends(slice(old, old + window - seen), 0)
                seen += len(first) - old
                # near-certain candidates may have hidden a pair in any region of three rows
                run, size = _runs(deep)
                full = (size >= 3) | (deep == begin)
                fresh = np.arange(len(first)) >= old
                if old and not given:
                    fresh |= run == run[old - 1]
                if (full & fresh).any():
                    yield crowd(np.flatnonzero(full & fresh))
                given = bool(full[-1])
                a, b = _look_back(first, node, prints, old, window)
                k = len(a)
                yield pa.record_batch(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *(pa.nulls(k, pa.int32()) for _ in range(3)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], schema=schema
                )
                first, deep, node, prints = first[-window - 1 :], deep[-window - 1 :], node[-window - 1 :], prints[-window - 1 :]
        if seen:
            yield from close()

    return run


def _across(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates over the borders: each border's rows come together, in order."""
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        border, end = rows["border"].to_numpy(), rows["end"].to_numpy()
        first, node = rows["first"].to_numpy(), rows["a"].to_numpy()
        prints = _matrix(rows["prints"].to_pylist())
        cut = np.flatnonzero(np.diff(border)) + 1
        for s, e in zip(np.append(0, cut), np.append(cut, len(border)), strict=True):
            new = int((end[s:e] == 1).sum())
            if 0 < new < e - s:
                a, b = _look_back(first[s:e], node[s:e], prints[s:e], new, window)
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def neighbours(rows: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a < b) of ``rows(first, deep, rest, node, prints)`` that stand close in the order
    of (first, rest, node), and the rows ``region, node`` of all deep regions in which there may be more.

    Rows with equal ``first`` can be candidates, those with equal ``deep`` (and therefore
    equal ``first``) are a region, ``prints`` (of one width) rule out the implausible.
    """
    order = ["first", "rest", "node"]
    n = partitions(rows.sparkSession)
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ordered = ordered.select("part", "first", "deep", "node", "prints")
    found = materialize(ordered.mapInArrow(_neighbours(window), "a long, b long, part int, end int, at int, first long, prints binary"), "neighbours")
    ends = found.filter("part is not null")
    # parts that have rows, numbered in order: one row per part
    numbered = ends.select("part").distinct().withColumn("no", F.row_number().over(Window.orderBy("part")))
    ends = ends.join(numbered, "part").withColumn("border", F.expr("no + if(end = 1, 1, 0)")).select("border", "end", "at", "a", "first", "prints")
    across = (
        ends.repartition("border")
        .sortWithinPartitions("border", F.col("end").desc(), "at")
        .mapInArrow(_across(window), "a long, b long")
    )
    pairs = found.filter("part is null and b is not null").select("a", "b").unionByName(across).filter("a <> b").distinct()
    return pairs, found.filter("part is null and b is null").select(F.col("first").alias("region"), F.col("a").alias("node")).distinct()


def _verify(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per pivot: its own text first, then its candidates' texts; the confirmed links."""
        words, unpack = WordHasher(space_separated()), zstandard.ZstdDecompressor()
        pivot, own = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            pivots, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [unpack.decompress(x) for x in batch.column(2).to_pylist()]
            offsets = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(x) for x in texts], out=offsets[1:])
            raw = np.frombuffer(b"".join(texts), np.uint8)
            a, b = [], []
            for i, j, data, off in chunks(raw, offsets):
                x, sets = shingle_sets(*words(data, off), SHINGLE)
                for k in range(i, j):
                    s = x[sets[k - i] : sets[k - i + 1]]
                    if pivots[k] == nodes[k]:
                        pivot, own = pivots[k], s.copy()
                        continue
                    assert pivot == pivots[k], "a pivot's own text comes first"
                    small, large = (s, own) if len(s) < len(own) else (own, s)
                    if 100 * len(small) < least * len(large):
                        continue
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    if 100 * both >= least * (len(s) + len(own) - both):
                        a.append(pivot)
                        b.append(nodes[k])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _sets(payload: pa.Array) -> list[np.ndarray]:
    """The shingle set of each packed text."""
    words, unpack, out = WordHasher(space_separated()), zstandard.ZstdDecompressor(), []
    for packed in payload.to_pylist():
        data = np.frombuffer(unpack.decompress(packed), np.uint8)
        out.append(shingle_sets(*words(data, np.array([0, len(data)])), SHINGLE)[0])
    return out


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) whose texts' full sets are that similar; ``texts`` has node and payload."""
    ship = pairs.select(F.col("b").alias("node"), F.col("a").alias("pivot")).unionByName(
        pairs.select(F.col("a").alias("node"), F.col("a").alias("pivot")).distinct()
    )
    return (
        ship.hint("merge")
        .join(texts.select("node", "payload"), "node")
        .repartition("pivot")
        .withColumn("later", F.col("node") != F.col("pivot"))
        .sortWithinPartitions("pivot", "later")
        .select("pivot", "node", "payload")
        .mapInArrow(_verify(percent), "a long, b long")
    )


def _grouped(docs: DataFrame, text: str, key: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, row, whole, n_shingles, k1, k2`` of each row, and ``n_shingles, k1, k2, group, component_id`` of each class."""
    small_batches(docs.sparkSession)
    signed = materialize(
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("whole")).mapInArrow(
            _signatures, "doc_id long, row long, whole long, n_shingles long, k1 long, k2 long, sig binary, packed binary"
        ),
        "signatures",
    )
    # a class goes by one of its rows: a doc_id may have several texts
    classes = materialize(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "k1", "k2", "sig").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc")), "classes"
    )
    rows = classes.select("node", "sig").mapInArrow(_tree_rows, "first long, deep long, rest binary, node long, prints binary")
    near, crowded = neighbours(rows)
    pairs = materialize(near, "pairs")
    # the texts that anything is asked of are few: they are looked up once
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowded.select("node")).distinct()
    texts = signed.select(F.col("row").alias("node"), F.col("packed").alias("payload"), F.col("n_shingles").alias("weight"))
    texts = materialize(texts.join(asked.hint("shuffle_hash"), "node"), "candidate-texts")
    links = materialize(confirm(pairs, texts, percent), "links")
    components = connected_components(links)
    regions = mixed_regions(crowded.join(classes.select("node", F.col("n_shingles").alias("weight")), "node"), components)
    more = materialize(region_links(regions, texts, _sets, percent), "region-links")
    components = joined(components, more)
    labelled = classes.join(components, "node", "left").select("n_shingles", "k1", "k2", "doc", F.coalesce("component", "node").alias("group"))
    least = labelled.groupBy("group").agg(F.min("doc").alias("component_id"))
    return signed, labelled.join(least, "group").select("n_shingles", "k1", "k2", "group", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Words are runs of anything but ASCII white space, with A-Z lowered. Texts
    whose shingle sets have ``100 * intersection >= percent * union`` are linked;
    components are over all links. ``component_id`` is the least doc_id of the
    component, ``kept`` is true for that document. A null or wordless text has
    ``n_shingles`` 0, is its own component and is kept. Rows that repeat a doc_id
    with another set are texts of their own, linked or not like any two; a row without
    doc_id is linked with nothing, has no component_id and is kept. ``docs`` may have
    any other columns, which are ignored. No rows give no rows.
    """
    signed, classes = _grouped(docs, text, key, percent)
    return (
        signed.select("doc_id", "n_shingles", "k1", "k2")
        .join(classes, ["n_shingles", "k1", "k2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of near duplicates in ``docs``, and all rows without words or doc_id, with all their columns.

    The row that stays is that of least (doc_id, hash of the text); of rows that repeat
    both it is any one. No rows give no rows.
    """
    signed, classes = _grouped(docs, "text", "doc_id", 75)
    keyed = signed.select("doc_id", "whole", "n_shingles", "k1", "k2").join(classes.select("n_shingles", "k1", "k2", "group"), ["n_shingles", "k1", "k2"])
    texts = materialize(keyed.filter("doc_id is not null").groupBy("group", "doc_id", "whole").agg(F.count("*").alias("n")), "texts-of-groups")
    stays = texts.groupBy("group").agg(F.min(F.struct("doc_id", "whole")).alias("stays"))
    doc, whole = fresh(docs.columns, "doc", "whole")
    gone = texts.join(stays, "group").filter("doc_id <> stays.doc_id or whole <> stays.whole").select(F.col("doc_id").alias(doc), F.col("whole").alias(whole))
    again = texts.join(stays, "group").filter("n > 1 and doc_id = stays.doc_id and whole = stays.whole").select(F.col("doc_id").alias(doc), F.col("whole").alias(whole))
    hashed = docs.withColumn(whole, F.xxhash64("text")).withColumn(doc, F.col("doc_id").cast("long"))
    left = hashed.join(gone, [doc, whole], "left_anti")
    if not again.isEmpty():
        once = left.join(again, [doc, whole], "left_semi").dropDuplicates([doc, whole])
        left = left.join(again, [doc, whole], "left_anti").unionByName(once)
    return left.select(*docs.columns)
