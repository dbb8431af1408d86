"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated scores.

* Tokens are runs of letters and digits, or of other visible ASCII characters. A
  token, and likewise a shape (kind, case, length, and whether the token repeats
  one just before), has a fixed sparse ternary index vector from its hash. A token's
  context vector is the integer sum of the index vectors of the tokens and shapes
  around it, in a bounded sample of labelled documents; sums are exact, so they
  don't depend on partitions.
* A document is the mean of its tokens' context vectors (none for rare tokens) and
  the mean of its shapes' index vectors. The network (tanh, then logistic)
  is trained in numpy on the sample; a temperature found on a part kept out of
  training calibrates its probabilities.
* Only the sums of ``VOCABULARY`` tokens at most (from each task of the sample), and
  ``SAMPLE`` pooled documents at most, ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, WordHasher, alphanumeric, binary_rows, chunks, mix, string_buffers
from .session import materialize, small_batches

#: Labelled documents that vectors, network and temperature are fitted on, at most.
SAMPLE = 6000
#: Tokens with a vector of their own, at most, and the least count of one in the sample.
VOCABULARY, LEAST = 20_000, 5
DIMENSIONS, ONES, REACH, HIDDEN = 96, 8, 2, 24
#: Tokens whose vectors are in memory at a time.
BLOCK = 1 << 13
#: Parts of the sample, and slices of its tokens' sums that the driver adds up one by one.
PARTS, SLICES = 8, 8
THRESHOLD = 0.7
HELD_OUT = 2


class Tokens(WordHasher):
    """Runs of one class of bytes, with the shape of each."""

    def __init__(self) -> None:
        kinds = alphanumeric().astype(np.uint8)
        kinds[33:127][kinds[33:127] == 0] = 2
        super().__init__(kinds > 0, lower=False)
        self.kinds = kinds
        bits = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 4 digit, 8 beyond ASCII, 16 other
        for a, b, v in ((97, 123, 1), (65, 91, 2), (48, 58, 4), (128, 256, 8)):
            bits[a:b] = v
        bits[kinds == 2] = 16
        self.bits = bits

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.kinds[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = k[1:] != k[:-1]
        edge[offsets] = True
        at = np.flatnonzero(edge)
        inside = k[at[:-1]] > 0
        return at[:-1][inside], at[1:][inside]

    def shapes(self, h: np.ndarray, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Hashes for kind, case of the first and the other characters, length up to 8, and repetition."""
        starts, ends = self.spans(data, offsets)
        b = self.bits[data]
        rest = np.bitwise_or.reduceat(np.append(b, 0), np.stack([starts, ends], axis=1).ravel())[::2]
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        again = np.zeros(len(h), bool)
        for d in range(1, min(2, len(h) - 1) + 1):
            again[d:] |= (h[d:] == h[:-d]) & (row[d:] == row[:-d])
        shape = (b[starts].astype(U64) * U64(64) + rest.astype(U64)) * U64(16) + np.minimum(ends - starts, 8).astype(U64)
        return shape * U64(2) + again.astype(U64) + U64(1 << 40)


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vector of each hash."""
    with np.errstate(over="ignore"):
        r = np.stack([mix(h + U64(k * 7919 + 1)) for k in range(ONES)], axis=1)
    return (r % U64(DIMENSIONS)).astype(np.int64), np.where(r >> U64(63), 1, -1).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk, each distinct token and its count."""
    tokens = Tokens()
    for batch in batches:
        raw, offsets = string_buffers(batch.column(1))
        for _, _, data, off in chunks(raw, offsets):
            ids, n = np.unique(tokens(data, off)[0], return_counts=True)
            yield pa.record_batch([pa.array(ids.view(np.int64)), pa.array(n)], names=["token", "n"])


def _contexts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task, the context sums of the vocabulary's tokens."""
        tokens, vocabulary = Tokens(), shared.value
        sums = np.zeros(len(vocabulary) * DIMENSIONS, np.int32)
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for _, _, data, off in chunks(raw, offsets, 1 << 17):
                h, rows = tokens(data, off)
                if not len(h):
                    continue
                shape = tokens.shapes(h, rows, data, off)
                row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known = vocabulary[at] == h
                for items in (h, shape):
                    places, signs = index_vectors(items)
                    for d in range(1, min(REACH, len(h) - 1) + 1):
                        for target, near in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
                            use = known[target] & (row[target] == row[near])
                            np.add.at(sums, (at[target][use, None] * DIMENSIONS + places[near][use]).ravel(), signs[near][use].ravel().astype(np.int32))
        sums = sums.reshape(-1, DIMENSIONS)
        full = np.flatnonzero(sums.any(axis=1))
        for k in range(0, len(full), 1000):
            some = full[k : k + 1000]
            yield pa.record_batch([pa.array(vocabulary[some].view(np.int64)), binary_rows(sums[some])], names=["token", "sums"])

    return run


@dataclass
class Pooler:
    """Per text, the mean of its tokens' vectors and of its shapes' index vectors, under a linear map."""

    ids: np.ndarray  # sorted
    vectors: np.ndarray  # one more than ids: the last stands for what isn't there
    shapes: np.ndarray  # what each place of a shape's index vector adds

    def __call__(self, tokens: Tokens, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        h, rows = tokens(data, offsets)
        out = np.zeros((len(rows) - 1, self.vectors.shape[1]))
        if len(h):
            at = np.full(len(h), len(self.ids))
            if len(self.ids):
                found = np.minimum(np.searchsorted(self.ids, h), len(self.ids) - 1)
                at = np.where(self.ids[found] == h, found, at)
            kinds, kind = np.unique(tokens.shapes(h, rows, data, offsets), return_inverse=True)
            places, signs = index_vectors(kinds)
            of_kind = (self.shapes[places] * signs[:, :, None]).sum(1)
            row = np.repeat(np.arange(len(out)), np.diff(rows))
            # a bounded number of tokens at a time, however long a text is
            for k in range(0, len(h), BLOCK):
                part = slice(k, k + BLOCK)
                starts = np.flatnonzero(np.append(True, row[part][1:] != row[part][:-1]))
                out[row[part][starts]] += np.add.reduceat(self.vectors[at[part]] + of_kind[kind[part]], starts, axis=0)
            out /= np.maximum(np.diff(rows), 1)[:, None]
        return out


@dataclass
class QualityModel:
    pooler: Pooler  # its vectors are mapped to the hidden layer's inputs already
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float
    learned: bool

    def scores(self, tokens: Tokens, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hidden = np.tanh(self.pooler(tokens, data, offsets) + self.bias)
        return 1 / (1 + np.exp(-(hidden @ self.out + self.out_bias) / self.temperature))


def _train(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Full-batch Adam on the logistic loss with weight decay."""
    rng = np.random.default_rng(20)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, 401):
        hidden = np.tanh(x @ p[0] + p[1])
        d = (1 / (1 + np.exp(-(hidden @ p[2] + p[3]))) - y) / len(y)
        back = d[:, None] * p[2] * (1 - hidden**2)
        for k, g in enumerate((x.T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The grid's temperature of least negative log-likelihood."""
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.logaddexp(0, np.where(y > 0, -logits, logits) / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _remainder(key) -> F.Column:
    return F.crc32(F.col(key).cast("string")) % 4


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on at most ``sample`` documents whose crc32(doc_id) mod 4 isn't 2.

    The sample is the labelled documents of least hash. Of several labels of one
    document the least counts; labels other than 0 and 1 count for nothing. With no
    usable label, or one class only, the model gives every text the same score:
    (n1 + 1) / (n + 2), and ``learned`` is false. Of several texts of one doc_id the one of
    least vector is learnt from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (_remainder("doc_id") != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
        .toPandas()
        .set_index("doc_id")["quality"]
    )
    empty = Pooler(np.zeros(0, U64), np.zeros((1, HIDDEN)), np.zeros((DIMENSIONS, HIDDEN)))
    prior = (int(chosen.sum()) + 1) / (len(chosen) + 2)
    flat = QualityModel(empty, np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))), 1.0, False)
    if chosen.nunique() < 2:
        return flat
    ids = spark.createDataFrame([(int(k),) for k in chosen.index], "doc_id long")
    # few parts, however many the scan has: each makes a row per token for the driver below
    texts = materialize(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").repartition(PARTS), "quality-sample")
    vocabulary = (
        texts.mapInArrow(_counts, "token long, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= LEAST)
        .orderBy(F.col("n").desc(), "token")
        .limit(VOCABULARY)
        .toArrow()["token"]
        .to_numpy()
        .view(U64)
    )
    if not len(vocabulary):
        return flat
    vocabulary = np.sort(vocabulary)
    vectors = np.zeros((len(vocabulary), DIMENSIONS))
    # one row per token and task of the bounded sample, a slice at a time
    contexts = materialize(texts.mapInArrow(_contexts(spark.sparkContext.broadcast(vocabulary)), "token long, sums binary"), "quality-contexts")
    for k in range(SLICES):
        part = contexts.filter(F.pmod("token", F.lit(SLICES)) == k).toArrow()
        at = np.searchsorted(vocabulary, part["token"].to_numpy().view(U64))
        np.add.at(vectors, at, np.frombuffer(b"".join(part["sums"].to_pylist()), np.int32).reshape(-1, DIMENSIONS))
        del part
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    wide = np.zeros((len(vocabulary) + 1, 2 * DIMENSIONS))
    wide[:-1, :DIMENSIONS] = vectors
    del vectors
    pooler = Pooler(vocabulary, wide, np.hstack([np.zeros((DIMENSIONS, DIMENSIONS)), np.eye(DIMENSIONS)]))
    shared = spark.sparkContext.broadcast(pooler)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Tokens()
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for i, j, data, off in chunks(raw, offsets):
                yield pa.record_batch([batch.column(0).slice(i, j - i), binary_rows(shared.value(cut, data, off))], names=["doc_id", "x"])

    pooled = texts.mapInArrow(pool, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")
    keys = pooled["doc_id"].to_numpy()
    y = chosen.loc[keys].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return flat
    x = np.frombuffer(b"".join(pooled["x"].to_pylist()), np.float64).reshape(len(keys), -1)
    center, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - center) / scale
    with np.errstate(over="ignore"):
        aside = mix(keys.astype(np.int64).view(U64) + U64(99)) % U64(5) == 0
    if len(set(y[~aside].tolist())) < 2 or not aside.any():
        aside[:] = False
    w, b, out, out_bias = _train(z[~aside], y[~aside])
    check = aside if aside.any() else ~aside
    t = _temperature(np.tanh(z[check] @ w + b) @ out + out_bias, y[check])
    first = w / scale[:, None]
    return QualityModel(Pooler(pooler.ids, pooler.vectors @ first, pooler.shapes @ first), b - center @ first, out, out_bias, t, True)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``, over its whole text.

    A null or empty text gets the score of no tokens at all. Scores are rounded to
    9 digits. Repeated rows give repeated results, no rows none; other columns are ignored,
    and a row without doc_id is not held out.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Tokens()
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for i, j, data, off in chunks(raw, offsets):
                s = np.round(shared.value.scores(cut, data, off), 9)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(_remainder("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns; all of them if nothing could be learned.

    Null and empty texts have the score of no tokens. Repeated rows go or stay alike; no rows give no rows.
    """
    model = fit_quality(docs, labels)
    if not model.learned:
        return docs
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Tokens()
        for batch in batches:
            raw, offsets = string_buffers(batch.column(at))
            good = [shared.value.scores(cut, data, off) >= THRESHOLD for _, _, data, off in chunks(raw, offsets)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)
