"""Drafts of teachers for a queue, as a job that can be stopped and run again.

The job's output is its state: a table of each sample's latest attempt. A run asks only
for samples without a valid draft, in chunks by hash; a chunk is committed at once, so a
run that is stopped loses a chunk at most, and no sample is drafted twice once valid.
Invalid drafts are asked for again, up to a number of attempts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.jsonl import table_digest
from ..streaming.latest import LatestTable

#: What a draft has besides what the teacher gives.
_HEAD = "sample_id string, attempt int, schema_valid boolean"
#: Parts of the queue that are drafted and committed one after the other.
CHUNKS = 16

Draft = Callable[[DataFrame], DataFrame]


class Drafts:
    """Drafts by ``provider`` at ``path``; ``fields`` are the columns that its answers have besides ``schema_valid``."""

    def __init__(self, spark: SparkSession, path: str, provider: str, fields: str) -> None:
        self.spark, self.path, self.provider = spark, path.rstrip("/"), provider
        self.schema = T.StructType.fromDDL(f"{_HEAD}, {fields}")
        self.table = LatestTable(spark, f"{self.path}/drafts", self.schema, ["sample_id"], "attempt")

    def _bound(self, queue: DataFrame) -> None:
        """The output belongs to one queue and one provider."""
        told = table_digest(queue).withColumn("provider", F.lit(self.provider)).select("provider", "n", F.col("xor").cast("string").alias("xor"), F.col("sum").cast("string").alias("sum"))
        runs = self.table.runs()
        if runs:
            was, now = self.spark.read.parquet(f"{self.path}/manifest").first(), told.first()
            if was["provider"] != now["provider"]:
                raise ValueError("the output has drafts of another provider")
            if was != now:
                raise ValueError("the output has drafts of another queue")
        else:
            told.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")

    def drafts(self) -> DataFrame:
        """The latest attempt of each sample that was asked for."""
        return self.table.read()

    def pending(self, queue: DataFrame, attempts: int) -> DataFrame:
        """Samples without a valid draft that have attempts left, with the number of the next ``attempt``."""
        done = self.drafts().select(F.col("sample_id").alias("_id"), F.col("attempt").alias("_tried"), F.col("schema_valid").alias("_valid"))
        left = queue.join(done, F.col("sample_id") == F.col("_id"), "left").where(~F.coalesce("_valid", F.lit(False)) & (F.coalesce("_tried", F.lit(0)) < attempts))
        return left.withColumn("attempt", F.coalesce("_tried", F.lit(0)) + 1).drop("_id", "_tried", "_valid")

    def run(self, queue: DataFrame, draft: Draft, attempts: int = 2, chunks: int = CHUNKS, stop_after: int | None = None) -> int:
        """Draft what is pending; the number of chunks that were committed.

        ``queue`` has a unique ``sample_id``; ``draft`` maps pending rows (with ``attempt``)
        to one row each of ``sample_id, attempt, schema_valid`` and the fields. Samples of
        a null id are left out. ``stop_after`` chunks the run ends early, as if stopped.
        """
        if attempts < 1 or chunks < 1:
            raise ValueError("attempts and chunks are positive")
        queue = queue.where("sample_id is not null").withColumn("sample_id", F.col("sample_id").cast("string"))
        self._bound(queue)
        number = max((r[2] for r in self.table.runs()), default=-1) + 1
        committed = 0
        for _ in range(attempts):
            for k in range(chunks):
                part = self.pending(queue.where(F.pmod(F.xxhash64("sample_id"), F.lit(chunks)) == k), attempts)
                if part.isEmpty():
                    continue
                if committed == stop_after:
                    return committed
                self.table.add(draft(part).select(*self.schema.names), number)
                number, committed = number + 1, committed + 1
        return committed

    def summary(self, queue: DataFrame) -> DataFrame:
        """One row: samples, those with a valid and with an invalid draft, and those never asked for."""
        done = self.drafts().select(F.col("sample_id").alias("_id"), "schema_valid")
        n = queue.where("sample_id is not null").join(done, F.col("sample_id").cast("string") == F.col("_id"), "left")
        return n.agg(F.count("*").alias("samples"), F.count_if("schema_valid").alias("valid"), F.count_if(~F.col("schema_valid")).alias("invalid"), F.count_if(F.col("schema_valid").isNull()).alias("pending"))
