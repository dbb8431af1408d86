"""Logs and reports of JSON lines that appear whole or not at all.

Each task validates and writes its rows to a file of its own, under a name that nobody
reads. When all tasks are done, one small file is put in place that names these files,
their lines and digests: that is the commit. Readers take what commits name, so a failed
or repeated task, or a job that dies before its commit, leaves nothing that anybody sees.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .jsonl import ContractError

FORMAT = "committed_json_lines"
_COMMITS = "_commits"


def _at(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class _Part(WriterCommitMessage):
    name: str
    lines: int
    sha256: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, job: str, order: int) -> None:
        self.path, self.job, self.order = path, job, order

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}.json"
        fs, root = _at(self.path)
        fs.create_dir(root, recursive=True)
        digest, n = hashlib.sha256(), 0
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for line, error in zip(batch.column("line").to_pylist(), batch.column("error").to_pylist(), strict=True):
                    if error:
                        raise ContractError(error)
                    data = line.encode() + b"\n"
                    digest.update(data)
                    out.write(data)
                    n += 1
        return _Part(name, n, digest.hexdigest())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Publish: the list of files goes in place by one move."""
        fs, root = _at(self.path)
        parts = [{"name": m.name, "lines": m.lines, "sha256": m.sha256} for m in messages if m is not None and m.lines]
        fs.create_dir(f"{root}/{_COMMITS}", recursive=True)
        hidden = f"{root}/{_COMMITS}/.{self.job}"
        with fs.open_output_stream(hidden) as out:
            out.write(json.dumps({"order": self.order, "job": self.job, "parts": parts}, sort_keys=True).encode())
        fs.move(hidden, f"{root}/{_COMMITS}/{self.order:08d}-{self.job}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What tasks have told of goes; the rest was never named."""
        fs, root = _at(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}")


class CommittedJsonLines(DataSource):
    """A sink for rows of ``line`` and ``error``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "line string, error string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["job"], int(self.options["order"]))


def commits(path: str) -> list[dict]:
    """What was committed at ``path``, in order."""
    fs, root = _at(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{_COMMITS}", allow_not_found=True))
    names = sorted(f.path for f in found if f.base_name[:1] != "." and f.base_name.endswith(".json"))
    out = []
    for name in names:
        with fs.open_input_stream(name) as f:
            out.append(json.loads(f.read()))
    return out


def append_lines(df: DataFrame, path: str, errors: Column | None = None) -> str:
    """Append rows as JSON objects with their keys in order of name, in one commit; its name.

    A row with ``errors`` (an array of texts) stops it all: the task that finds it fails,
    and nothing of the call is ever seen. One pass over the rows, validation included.
    """
    spark, job = df.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(CommittedJsonLines)
    error = F.lit(None).cast("string") if errors is None else F.when(F.size(errors) > 0, F.array_join(errors, ","))
    before = commits(path)
    rows = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"), error.alias("error"))
    rows.write.format(FORMAT).mode("append").option("path", path).option("job", job).option("order", str(len(before))).save()
    return job


def read_lines(spark: SparkSession, path: str, schema: str, last: bool = False) -> DataFrame:
    """The rows of all commits, or of the last one alone: a report replaces the one before it by a commit of its own."""
    done = commits(path)
    files = [f"{path.rstrip('/')}/{p['name']}" for c in (done[-1:] if last else done) for p in c["parts"]]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)


def damaged(path: str) -> list[str]:
    """Committed files that aren't there any more or don't have their digest."""
    fs, root = _at(path)
    out = []
    for part in (p for c in commits(path) for p in c["parts"]):
        name = f"{root}/{part['name']}"
        if fs.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
            out.append(part["name"])
            continue
        digest = hashlib.sha256()
        with fs.open_input_stream(name) as f:
            while data := f.read(1 << 20):
                digest.update(data)
        if digest.hexdigest() != part["sha256"]:
            out.append(part["name"])
    return out
