"""A table of latest rows that a stream keeps up, at a cost that follows each batch.

A batch adds one run: its own latest row per key. When ``fan`` runs of a level are there,
they become one run of the next level. So a row is written again once per level, and
levels grow with the logarithm of the batches; nothing rewrites the whole table for a
small batch. A reader merges the few runs that are there by the greatest sequence number,
so that late and repeated rows change nothing.

Runs and the list of them are Parquet. The list of a batch is written after its runs; a
batch that runs again after a failure starts from the list before it, writes the same
folders again, and so commits once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.ranking import latest

#: Runs of a level that become one of the next.
FAN = 8
#: (level, first and last batch of a run)
_LIST = "level int, first long, last long"
Run = tuple[int, int, int]


class LatestTable:
    """Rows of ``schema`` at ``path``, one per ``key``: that of greatest ``seq``, among equals that of greatest other columns."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], seq: str, fan: int = FAN) -> None:
        if fan < 2:
            raise ValueError("two runs at least become one")
        self.spark, self.path, self.schema, self.key, self.seq, self.fan = spark, path.rstrip("/"), schema, key, seq, fan

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key]
        order = F.struct(self.seq, *(c for c in rest if c != self.seq))
        return latest(rows.withColumn("_order", order), self.key, "_order").select(*rows.columns)

    def _folder(self, run: Run) -> str:
        return f"{self.path}/runs/level={run[0]}/first={run[1]}/last={run[2]}"

    def _read(self, runs: list[Run]) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(self._folder(r)) for r in runs]
        return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], self.schema))

    def lists(self) -> DataFrame:
        """All lists of runs so far: some rows for each batch."""
        return self.spark.read.schema(f"{_LIST}, batch long").parquet(f"{self.path}/lists")

    def runs(self, before: int | None = None) -> list[Run]:
        """The runs that the last list names, of batches under ``before``; at most ``fan`` a level."""
        try:
            lists = self.lists()
        except AnalysisException:  # nothing was written yet
            return []
        if before is not None:
            lists = lists.where(F.col("batch") < before)
        last = lists.agg(F.max("batch")).first()[0]
        return [] if last is None else sorted(((r["level"], r["first"], r["last"]) for r in lists.where(F.col("batch") == last).collect()), key=lambda r: r[1])

    def merge(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""

        def run(batch: DataFrame, number: int) -> None:
            self.add(batch, number)

        return run

    def add(self, batch: DataFrame, number: int) -> None:
        """Fold batch ``number`` in; the same batch again changes nothing."""
        runs = self.runs(before=number)
        new: Run = (0, number, number)
        self._latest(batch.select(*self.schema.names)).write.mode("overwrite").parquet(self._folder(new))
        runs.append(new)
        while len(same := [r for r in runs if r[0] == runs[-1][0]]) >= self.fan:
            # those of a level stand together at the end: older runs have higher levels
            merged: Run = (same[0][0] + 1, same[0][1], same[-1][2])
            self._latest(self._read(same)).write.mode("overwrite").parquet(self._folder(merged))
            runs = [*runs[: -len(same)], merged]
        self.spark.createDataFrame(runs, _LIST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/batch={number}")

    def read(self) -> DataFrame:
        """The latest row per key of all batches that were committed."""
        return self._latest(self._read(self.runs()))
