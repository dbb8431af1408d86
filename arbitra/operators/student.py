"""Typed heads on a shared encoder: distributed training, a versioned artefact, batch inference.

A text is the mean of the embeddings of its hashed words, whole; one hidden layer is
shared, and each task has a head of its own: two logits for a boolean, one per candidate
for a choice, a value and a width for a score. Heads are bound to a task's id, version
and candidates.

Training is synchronous: in each step every task of the cluster adds up the gradient of
its rows, blocks of the gradient are summed across tasks, and the driver, which only ever
sees arrays of the model's size, moves the parameters. All sums are of integers: weights
and activations lie on a grid of 1 / ``GRID``, so that products and sums are exact in 64
bits and the result is the same however rows are dealt.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import Task
from ..sources.shared import written

#: Steps of the grid in one, and texts whose products are summed before they leave floats, in which sums below 2^53 are exact.
GRID, ROWS = 1 << 14, 1 << 9
#: Counters of a block of texts, and rows of one text that are packed together.
CELLS, ASKS = 1 << 20, 16
#: Texts whose words are hashed side by side, and the bytes of a word up to which they are.
TEXTS, LONG = 32, 64
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (_CRC >> 1)
#: Parts of the gradient that are summed apart.
BLOCKS = 8
_LARGEST = 16 * GRID

Arrays = dict[str, np.ndarray]


@dataclass(frozen=True)
class Config:
    """Size of the model and of its training."""

    vocabulary: int = 4096
    hidden: int = 24
    steps: int = 30
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 7

    def __post_init__(self) -> None:
        if min(self.vocabulary, self.hidden, self.steps) < 1 or self.rate <= 0:
            raise ValueError("sizes, steps and rate are positive")


@dataclass(frozen=True)
class Head:
    task_id: str
    version: int
    kind: str
    candidates: tuple[str, ...] = ()

    @classmethod
    def of(cls, task: Task) -> Head:
        """The head of a catalog's task."""
        return cls(task.task_id, task.version, task.output_type, tuple(task.candidates))

    @property
    def width(self) -> int:
        return len(self.candidates) if self.kind == "choice" else 2


def _on_grid(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x * GRID), -_LARGEST, _LARGEST).astype(np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An exact product of integers, by floats that hold it."""
    return (a.astype(np.float64, copy=False) @ b.astype(np.float64, copy=False)).astype(np.int64)


def word_counts(text: str | None, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words, how often each occurs) of a whole text, small and large letters alike."""
    ids = np.fromiter((zlib.crc32(w.encode()) % vocabulary for w in (text or "").lower().split()), np.int64)
    return np.unique(ids, return_counts=True)


def _crc32(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of many words of ``data`` side by side, the next byte of all that have one at a time; words beyond ``LONG`` bytes one by one."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    many = int(np.searchsorted(-length, -LONG))
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(length[many]) if many < len(order) else 0):
        own = slice(many, int(np.searchsorted(-length, -k)))
        crc[own] = _CRC[(crc[own] ^ data[begin[own] + k]) & 0xFF] ^ (crc[own] >> 8)
    crc = ~crc
    crc[:many] = [zlib.crc32(data[b : b + n]) for b, n in zip(begin[:many].tolist(), length[:many].tolist(), strict=True)]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def words_of(texts: list[str | None], vocabulary: int) -> Iterator[bytes]:
    """:func:`word_counts` of each text as bytes: hashed words, then counts, in 32 bits."""
    step = max(1, min(TEXTS, CELLS // vocabulary))
    for at in range(0, len(texts), step):
        parts = [" ".join((text or "").lower().split()).encode() for text in texts[at : at + step]]
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        end = np.flatnonzero(data == 32)
        begin = np.append(0, end[:-1] + 1)
        own = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]) - 1, end)
        some = end > begin
        ids = _crc32(data, begin[some], (end - begin)[some]) % vocabulary
        counts = np.bincount(own[some] * vocabulary + ids, minlength=len(parts) * vocabulary).reshape(len(parts), vocabulary)
        for row in counts:
            found = np.flatnonzero(row)
            yield np.concatenate([found, row[found]]).astype(np.int32).tobytes()


def counted(df: DataFrame, vocabulary: int, text: str = "text") -> DataFrame:
    """``df`` with ``words`` in place of ``text``: whole texts, counted for a model of this vocabulary.

    :func:`train` and :func:`predict` take ``words`` as they take ``text``, so that a
    table of texts that is asked several things is read and counted once.
    """
    others = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array(list(words_of(batch.column(len(others)).to_pylist(), vocabulary)), pa.binary())
            yield pa.record_batch([*batch.columns[: len(others)], words], names=[*others, "words"])

    return df.select(*others, text).mapInArrow(run, T.StructType([*df.select(*others).schema, T.StructField("words", T.BinaryType())]))


def _words(given: str | bytes | None, vocabulary: int) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
    """(hashed words, counts) of a text, or of what :func:`words_of` made of it."""
    return np.frombuffer(given, np.int32).reshape(2, -1) if isinstance(given, bytes) else word_counts(given, vocabulary)


def _said(df: DataFrame) -> str:
    return "words" if "words" in df.columns else "text"


class Student:
    """Parameters on the grid, and what is computed with them."""

    def __init__(self, heads: list[Head], config: Config, arrays: Arrays | None = None) -> None:
        if len({h.task_id for h in heads}) < len(heads) or not heads:
            raise ValueError("a head for each of one task or more")
        if any(h.kind not in ("boolean", "choice", "score") or h.width < 2 for h in heads):
            raise ValueError("heads are boolean, score, or choose between two candidates or more")
        self.heads, self.config = list(heads), config
        self.number = {h.task_id: k for k, h in enumerate(heads)}
        self.arrays = arrays or self._start()

    def _start(self) -> Arrays:
        r, n = np.random.default_rng(self.config.seed), self.config.hidden
        out = {"words": r.normal(0, 1.0, (self.config.vocabulary, n)), "hidden": r.normal(0, n**-0.5, (n, n)), "shift": np.zeros(n)}
        for k, h in enumerate(self.heads):
            out[f"head{k}"], out[f"bias{k}"] = r.normal(0, n**-0.5, (n, h.width)), np.zeros(h.width)
        return {k: _on_grid(v) for k, v in out.items()}

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {k: v.shape for k, v in self.arrays.items()}

    def blocks(self, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Texts that are counted in one matrix."""
        step = max(1, min(ROWS, CELLS // self.config.vocabulary))
        return ((begin, min(begin + step, len(offsets) - 1)) for begin in range(0, len(offsets) - 1, step))

    def counted(self, ids: np.ndarray, counts: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> np.ndarray:
        """How often each word of the vocabulary stands in each text of a block."""
        size, own = self.config.vocabulary, slice(offsets[begin], offsets[end])
        place = np.repeat(np.arange(end - begin) * size, np.diff(offsets[begin : end + 1])) + ids[own]
        return np.bincount(place, counts[own], (end - begin) * size).reshape(end - begin, size)

    def mean(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = counted.sum(1).astype(np.int64)
        return _product(counted, self.arrays["words"]) // np.maximum(n, 1)[:, None], n

    def pooled(self, ids: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean embedding of each text, how many words it has); a text without words is at the origin."""
        found = [self.mean(self.counted(ids, counts, offsets, *block)) for block in self.blocks(offsets)]
        if not found:
            return np.zeros((0, self.config.hidden), np.int64), np.zeros(0, np.int64)
        return np.concatenate([m for m, _ in found]), np.concatenate([n for _, n in found])

    def hidden(self, pooled: np.ndarray) -> np.ndarray:
        return np.clip(_product(pooled, self.arrays["hidden"]) // GRID + self.arrays["shift"], 0, _LARGEST)

    def output(self, k: int, hidden: np.ndarray) -> np.ndarray:
        """Logits of a head, or value and width."""
        return (_product(hidden, self.arrays[f"head{k}"]) // GRID + self.arrays[f"bias{k}"]) / GRID

    def gradient(self, task: np.ndarray, target: np.ndarray, weight: np.ndarray, ids: np.ndarray, counts: np.ndarray, offsets: np.ndarray, text: np.ndarray | None = None) -> tuple[Arrays, int]:
        """(sums over the rows, of whole products where two factors are on the grid; summed loss).

        ``text`` says which text each row asks about, in ascending order; without it, each
        about its own. A score's ``target`` is in steps of the grid. What is rounded is a
        row's own, never a sum.
        """
        out = {k: np.zeros(s, np.int64) for k, s in self.shapes().items()}
        text, loss = np.arange(len(task)) if text is None else text, 0
        for begin, end in self.blocks(offsets):
            counted = self.counted(ids, counts, offsets, begin, end)
            mean, n = self.mean(counted)
            rows = slice(*np.searchsorted(text, [begin, end]))
            own, hidden = text[rows] - begin, self.hidden(mean)[text[rows] - begin]
            back = np.zeros_like(hidden)
            for k, head in enumerate(self.heads):
                at = np.flatnonzero(task[rows] == k)
                if len(at):
                    error, each = _error(head, self.output(k, hidden[at]), target[rows][at])
                    delta = _on_grid(error * weight[rows][at][:, None])
                    loss += int(_on_grid(each * weight[rows][at]).sum())
                    out[f"head{k}"] += _product(hidden[at].T, delta)
                    out[f"bias{k}"] += delta.sum(0)
                    back[at] += _product(delta, self.arrays[f"head{k}"].T) // GRID
            back = np.where(hidden > 0, np.clip(back, -_LARGEST, _LARGEST), 0)
            down = _product(back, self.arrays["hidden"].T) // (GRID * np.maximum(n, 1))[own][:, None]
            of_text = np.zeros((2, *mean.shape), np.int64)
            np.add.at(of_text[0], own, back)
            np.add.at(of_text[1], own, down)
            out["hidden"] += _product(mean.T, of_text[0])
            out["shift"] += back.sum(0)
            out["words"] += _product(counted.T, of_text[1])
        return out, loss


def _error(head: Head, said: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(derivative of the loss by what the head says, loss) of each row: cross-entropy, or a score's squared error."""
    rows = np.arange(len(said))
    if head.kind == "score":
        error = np.zeros_like(said)
        error[:, 0] = 2 * (said[:, 0] - target / GRID)
        return error, np.minimum(16.0, (said[:, 0] - target / GRID) ** 2)
    p = np.exp(said - said.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    each = -np.log(np.maximum(p[rows, target], 1e-7))
    p[rows, target] -= 1
    return p, each


class _Adam:
    """Parameters in floats, moved by means of gradients and of their squares."""

    def __init__(self, arrays: Arrays, rate: float, decay: float) -> None:
        self.x = {k: v / GRID for k, v in arrays.items()}
        self.m = {k: np.zeros(v.shape) for k, v in arrays.items()}
        self.v = {k: np.zeros(v.shape) for k, v in arrays.items()}
        self.rate, self.decay, self.t = rate, decay, 0

    def step(self, gradient: Arrays) -> Arrays:
        self.t += 1
        for k, g in gradient.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            move = (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)
            self.x[k] = self.x[k] - self.rate * (move + self.decay * self.x[k])
        return {k: _on_grid(v) for k, v in self.x.items()}


def class_weights(df: DataFrame, task: str = "task_id", target: str = "target", scores: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``weight``: each class of a task counts alike in sum; rows of ``scores``, tasks without classes, weigh 1.

    Classes are counted first and joined back by broadcast: there are a few of them, and
    a shuffle by class would put all rows, with their texts, in as few tasks.
    """
    classes = df.where(~F.col(task).isin(*scores)).groupBy(task, target).agg(F.count("*").alias("_n"))
    tasks = classes.groupBy(task).agg(F.sum("_n").alias("_of"), F.count("*").alias("_k"))
    shares = classes.join(tasks, task).select(task, target, (F.col("_of") / (F.col("_k") * F.col("_n"))).alias("weight"))
    if not scores:
        return df.join(F.broadcast(shares), [task, target])
    joined = df.join(F.broadcast(shares), [task, target], "left")
    return joined.withColumn("weight", F.when(F.col(task).isin(*scores), 1.0).otherwise(F.col("weight"))).where("weight is not null")


def _pack(heads: list[Head], vocabulary: int) -> Callable:
    """Rows as numbers; task -1 for a row that no head can take. Rows of one text in a batch are one row, up to ``ASKS``."""
    number = {h.task_id: k for k, h in enumerate(heads)}
    classes = [{"false": 0, "true": 1} if h.kind == "boolean" else {c: i for i, c in enumerate(h.candidates)} for h in heads]

    def goal(k: int, said: str | None) -> int | None:
        if k < 0 or said is None:
            return None
        if heads[k].kind != "score":
            return classes[k].get(said)
        try:
            value = float(said)
        except ValueError:
            return None
        return round(value * GRID) if 0 <= value <= 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, latest = [], {}
            for task, text, target, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = number.get(task, -1)
                y = goal(k, target)
                row = latest.get(text)
                if row is None or len(row[0]) == ASKS:
                    words = row[3:] if row else [x.astype(np.int32).tobytes() for x in _words(text, vocabulary)]
                    row = latest[text] = [[], [], [], *words]
                    out.append(row)
                for column, x in zip(row, (-1 if y is None else k, y or 0, 1.0 if weight is None else weight), strict=False):
                    column.append(x)
            if out:
                types = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["task", "target", "weight", "ids", "counts"])

    return run


_PACKED = "task array<int>, target array<long>, weight array<double>, ids binary, counts binary"


#: Up to ``ROWS`` packed texts in a row: what is asked of them one after the other, how much of each, and their words.
_BLOCK = "task array<int>, target array<long>, weight array<double>, texts int, asks binary, lengths binary, ids binary, counts binary"


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(x.max(initial=0))).tobytes()


def _wide(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"u{len(x) // n}" if n else np.uint8).astype(np.int64)


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            ids, counts = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.int32) for c in (3, 4))
            lengths = np.array([len(x) // 4 for x in part.column(3).to_pylist()], np.int64)
            asked = [pa.array([part.column(c).flatten()], pa.list_(t)) for c, t in enumerate((pa.int32(), pa.int64(), pa.float64()))]
            told = [pa.array([_narrow(x)], pa.binary()) for x in (part.column(0).value_lengths().to_numpy(), lengths, ids, counts)]
            yield pa.record_batch([*asked, pa.array([part.num_rows], pa.int32()), *told], names=["task", "target", "weight", "texts", "asks", "lengths", "ids", "counts"])


def _flat(arrays: Arrays) -> np.ndarray:
    return np.concatenate([arrays[k].ravel() for k in sorted(arrays)])


def _shaped(flat: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> Arrays:
    out, at = {}, 0
    for k in sorted(shapes):
        n = int(np.prod(shapes[k]))
        out[k], at = flat[at : at + n].reshape(shapes[k]), at + n
    return out


def _sum_rows(heads: list[Head], config: Config, shared, factors: list[float]) -> Callable:
    """The gradient of a task's rows, in blocks; the loss stands behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        student, total = Student(heads, config, shared.value), None
        for batch in batches:
            for i in range(batch.num_rows):
                task, target, weight = (batch.column(c)[i].values.to_numpy() for c in range(3))
                texts, asks, lengths, ids, counts = (batch.column(c)[i].as_py() for c in range(3, 8))
                lengths = _wide(lengths, texts)
                text, n = np.repeat(np.arange(texts), _wide(asks, texts)), int(lengths.sum())
                gradient, loss = student.gradient(task, target, weight * np.array(factors)[task], _wide(ids, n), _wide(counts, n), np.append(0, np.cumsum(lengths)), text)
                flat = np.append(_flat(gradient), loss)
                total = flat if total is None else total + flat
        if total is not None:
            parts = np.array_split(total, BLOCKS)
            yield pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "sums"])

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(part, np.int64)
            sums[block] = sums[block] + part if block in sums else part
    if sums:
        yield pa.record_batch([pa.array(sums, pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "sums"])


def train(rows: DataFrame, heads: list[Head], config: Config | None = None) -> tuple[Student, list[float]]:
    """(the fitted model, mean loss before each step) from ``task_id, text, target`` and, if there, ``weight``.

    Targets are text: true or false, a candidate, or a number within 0 and 1. A row of
    another task or target is an error, as it is for the catalog. Every task counts alike,
    whatever its rows. A null text has no words; ``words`` may stand for ``text``. The rows are written once as numbers, many
    texts to a row, and read in each step; the same rows give the same model, however they are partitioned.
    """
    config = config or Config()
    student, spark = Student(heads, config), rows.sparkSession
    weight = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
    packed = written(rows.select("task_id", _said(rows), F.col("target").cast("string"), weight.alias("weight")).mapInArrow(_pack(heads, config.vocabulary), _PACKED).mapInArrow(_in_blocks, _BLOCK), "student-rows")
    # a row for each task
    sizes = {r["task"]: r["w"] for r in packed.select(F.inline(F.arrays_zip("task", "weight"))).groupBy("task").agg(F.sum(F.round(F.col("weight") * GRID).cast("long")).alias("w")).collect()}
    if -1 in sizes or len(sizes) < len(heads) or min(sizes.values()) <= 0:
        raise ValueError("each head needs rows, and each row a head that takes its target")
    total = sum(sizes.values()) / GRID
    factors = [total * GRID / (len(heads) * sizes[k]) for k in range(len(heads))]
    scale = {k: total * GRID * (GRID if k in ("hidden", *(f"head{i}" for i in range(len(heads)))) else 1) for k in student.arrays}
    adam, losses = _Adam(student.arrays, config.rate, config.decay), []
    for _ in range(config.steps):
        shared = spark.sparkContext.broadcast(student.arrays)
        blocks = packed.mapInArrow(_sum_rows(heads, config, shared, factors), "block int, sums binary").repartition(BLOCKS, "block").mapInArrow(_sum_blocks, "block int, sums binary")
        # as many bytes as the model has
        flat = np.concatenate([np.frombuffer(bytes(r["sums"]), np.int64) for r in sorted(blocks.collect(), key=lambda r: r["block"])])
        shared.unpersist()
        losses.append(flat[-1] / GRID / total)
        student = Student(heads, config, adam.step({k: g / scale[k] for k, g in _shaped(flat[:-1], student.shapes()).items()}))
    return student, losses


# -- the artefact ----------------------------------------------------------


def _manifest(student: Student) -> dict:
    digest = hashlib.sha256(_flat(student.arrays).astype("<i8").tobytes()).hexdigest()
    return {"artefact": "typed-heads", "version": 1, "heads": [asdict(h) | {"candidates": list(h.candidates)} for h in student.heads], "config": asdict(student.config), "sha256": digest}


def save(spark: SparkSession, student: Student, path: str) -> str:
    """Write the model as a table with a row for each array and one for the manifest; the digest of its parameters."""
    told = _manifest(student)
    rows = [("manifest", json.dumps(told, sort_keys=True).encode())] + [(k, v.astype("<i8").tobytes()) for k, v in student.arrays.items()]
    spark.createDataFrame(rows, "name string, data binary").coalesce(1).write.parquet(path)
    return told["sha256"]


def load(spark: SparkSession, path: str, heads: list[Head] | None = None) -> Student:
    """The model of a table that ``save`` wrote.

    It has to be whole (by its digest), and bound to ``heads``, if they are given: a
    model of another version of a task, or of other candidates, is refused.
    """
    parts = {r["name"]: bytes(r["data"]) for r in spark.read.parquet(path).collect()}
    told = json.loads(parts.pop("manifest"))
    if (told["artefact"], told["version"]) != ("typed-heads", 1):
        raise ValueError("another kind of artefact")
    own = [Head(h["task_id"], h["version"], h["kind"], tuple(h["candidates"])) for h in told["heads"]]
    if heads is not None and sorted(map(repr, heads)) != sorted(map(repr, own)):
        raise ValueError("the model is bound to other tasks, versions or candidates")
    empty = Student(own, Config(**told["config"]))
    student = Student(own, empty.config, {k: np.frombuffer(parts[k], "<i8").reshape(s).astype(np.int64) for k, s in empty.shapes().items()})
    if _manifest(student)["sha256"] != told["sha256"]:
        raise ValueError("the parameters don't have the manifest's digest")
    return student


# -- inference -------------------------------------------------------------

RESULT = "value boolean, selected string, probabilities array<double>, logits array<double>, score double, lower double, upper double, confidence double, abstained boolean"


def answer(head: Head, said: np.ndarray, temperature: float, minimum: float) -> dict:
    """What a head says of a text, as an answer of its kind; below ``minimum`` confidence it abstains."""
    if head.kind == "score":
        value = min(1.0, max(0.0, float(said[0])))
        reach = 0.5 / (1 + float(np.exp(-said[1])))
        sure = max(0.0, 1.0 - reach)
        return {"score": value, "lower": max(0.0, value - reach), "upper": min(1.0, value + reach), "confidence": sure, "abstained": sure < minimum}
    p = np.exp((said - said.max()) / temperature)
    p = p / p.sum()
    best = int(said.argmax())
    named = {"value": bool(best)} if head.kind == "boolean" else {"selected": head.candidates[best]}
    return named | {"probabilities": p.tolist(), "logits": said.tolist(), "confidence": float(p[best]), "abstained": bool(p[best] < minimum)}


def _answers(shared, temperatures: dict[str, float], minimum: float) -> Callable:
    kind = pa.schema([("value", pa.bool_()), ("selected", pa.string()), ("probabilities", pa.list_(pa.float64())), ("logits", pa.list_(pa.float64()))] + [(c, pa.float64()) for c in ("score", "lower", "upper", "confidence")] + [("abstained", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        student = Student(*shared.value)
        for batch in batches:
            tasks, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            # the rows of a text are often neighbours: it is counted once
            place = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            found = [_words(t, student.config.vocabulary) for t in place]
            offsets = np.cumsum([0] + [len(i) for i, _ in found])
            ids, counts = (np.concatenate([f[c] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for c in range(2))
            hidden, rows = student.hidden(student.pooled(ids, counts, offsets)[0])[[place[t] for t in texts]], [{}] * len(tasks)
            for name, k in student.number.items():
                at = [i for i, t in enumerate(tasks) if t == name]
                for i, said in zip(at, student.output(k, hidden[at]), strict=True):
                    rows[i] = answer(student.heads[k], said, temperatures.get(name, 1.0), minimum)
            told = pa.RecordBatch.from_pylist([{c: r.get(c) for c in kind.names} for r in rows], schema=kind)
            yield pa.record_batch([batch.column(0), batch.column(1), *told.columns], names=["id", "task_id", *kind.names])

    return run


def predict(df: DataFrame, student: Student, temperatures: dict[str, float] | None = None, minimum: float = 0.0, key: str = "id") -> DataFrame:
    """The answers of ``task_id, text`` (or ``words``) rows over whole texts, by ``key``; nulls for a task without a head.

    ``temperatures`` of tasks, as calibration manifests have them, soften or sharpen
    probabilities and with them confidence and abstention, never the answer.
    """
    shared = df.sparkSession.sparkContext.broadcast((student.heads, student.config, student.arrays))
    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("id"), "task_id", _said(df)).mapInArrow(_answers(shared, temperatures or {}, minimum), f"id {kind}, task_id string, {RESULT}")
    return out.withColumnRenamed("id", key)
