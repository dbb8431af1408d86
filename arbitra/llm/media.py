"""Media columns: payloads in tar shards by content, metadata by range reads.

A text becomes bytes (UTF-8, zeros up to a positive multiple of 64) and is stored
as an 8-bit grey PNG of 64 samples a row, lossless. Each writing task keeps one
tar shard (a new one beyond ``SHARD`` bytes), named by the digest of the payload
and holding each payload once; rows carry digest, shard, offset and length. Equal
payloads of different shards resolve to one address, the least.

Reading is a step of its own over the distinct addresses: a range read of the
PNG's header alone fills the metadata columns, and a second range read gets the
stored bytes for what needs all samples.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import materialize, partitions, shared_dir, small_batches

UNIT = 64
SHARD = 256 << 20
#: Stored bytes that a task reads back.
READ = 64 << 20
#: Signature and IHDR chunk.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes) -> bytes:
    """The text's bytes and zeros up to a positive multiple of 64."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes) -> bytes:
    """A grey PNG of 64 8-bit samples a row, no filter."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from a PNG's first 33 bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", first[16:25])


def decode(stored: bytes) -> bytes:
    """The samples of a PNG that :func:`encode` made."""
    width, height, _ = header(stored[:HEADER])
    at, parts = HEADER, []
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IDAT":
            parts.append(stored[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered PNG")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean and deviation of the samples, entropy in bits, and how many values occur."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, values = int(counts.sum()), np.arange(256)
    first, second = int(counts @ values), int(counts @ values**2)
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum()) + 0.0
    return f"mean={first / n:.4f};deviation={max(0.0, second / n - (first / n) ** 2) ** 0.5:.4f};entropy={entropy:.4f};values={len(p)}"


class _Shard:
    """A tar file under a temporary name until it is complete."""

    def __init__(self, folder: str, name: str, attempt: str) -> None:
        self.fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.temporary = f"{root}/{name}", f"{root}/.{name}.{attempt}"
        self.out, self.size = self.fs.open_output_stream(self.temporary), 0

    def add(self, name: str, data: bytes) -> int:
        """Where the member's data starts."""
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        at = self.size + len(head)
        self.size = at + len(data) + -len(data) % 512
        return at

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()
        self.fs.move(self.temporary, self.final)


def _write(folder: str, most: int):
    names = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        count, shard, inside = 0, None, {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                samples = payload(data)
                digest = hashlib.sha256(samples).hexdigest()
                if digest not in inside:
                    if shard and shard.size > most:
                        shard.close()
                        shard, inside, count = None, {}, count + 1
                    name = f"{task.partitionId():06d}-{count:04d}.tar"
                    shard = shard or _Shard(folder, name, str(task.taskAttemptId()))
                    stored = encode(samples)
                    inside[digest] = (name, shard.add(f"{digest}.png", stored), len(stored))
                rows.append((doc, len(data), digest, *inside[digest]))
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        if shard:
            shard.close()

    return run


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system: one without a scheme is on the default one, where tables of such names go too."""
    if "://" in folder:
        return folder
    if folder.startswith("file:"):
        return "file://" + folder.removeprefix("file:")
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return ("file://" if default.startswith("file:") else default.rstrip("/")) + folder


def store(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the shards; ``doc_id, n_bytes, digest, folder, shard, offset, length`` of each row.

    A task that runs again writes the same names and bytes again. A null text is an
    empty one (64 zeros). Other columns are ignored; no rows write no shard.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = _qualified(spark, folder or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}")
    written = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _write(folder, shard_bytes), "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
    )
    return materialize(written, "media-index").withColumn("folder", F.lit(folder))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Range reads of the addresses, in the order of shards."""
    path, file = None, None
    for batch in batches:
        rows = []
        for digest, folder, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != f"{folder}/{shard}":
                path = f"{folder}/{shard}"
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                file = fs.open_input_file(name)
            width, height, bits = header(file.read_at(HEADER, offset))
            stored = file.read_at(length, offset)
            samples = decode(stored)
            rows.append(
                (digest, folder, shard, offset, length, width, height, bits, width * height * bits // 8, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples))
            )
        if rows:
            yield pa.record_batch(
                [pa.array(x) for x in zip(*rows, strict=True)],
                names=["digest", "folder", "shard", "offset", "length", "width", "height", "bits", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )


def media_columns(stored: DataFrame) -> DataFrame:
    """Metadata and features of each row of :func:`store`'s result, from what the shards hold.

    Each distinct payload is read once, from its least address; its rows join the
    result by digest. Addresses are dealt to as many tasks as their payloads' bytes ask
    for (``READ`` each), not as their own few bytes would. No rows give no rows.
    """
    tasks = max(partitions(stored.sparkSession), 1 + (stored.agg(F.sum("length").alias("n")).first()["n"] or 0) // READ)
    places = (
        stored.groupBy("digest")
        .agg(F.min(F.struct("folder", "shard", "offset", "length")).alias("p"))
        .select("digest", "p.*")
    )
    read = (
        places.repartition(tasks, F.col("shard"), F.shiftright("offset", 22))
        .sortWithinPartitions("folder", "shard", "offset")
        .mapInArrow(_read, "digest string, folder string, shard string, offset long, length long, width long, height long, bits long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    )
    return stored.select("doc_id", "n_bytes", "digest").join(read, "digest")
