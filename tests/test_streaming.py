"""Streams equal batches over the same files; resumed runs see only what is new."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbitra.operators.ranking import latest
from arbitra.streaming import flows
from arbitra.streaming.latest import LatestTable

SCHEMA = "seq long, sample_id long, correction boolean"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream_into(spark, source, table, checkpoint, **options):
    reader = spark.readStream.schema(SCHEMA)
    for k, v in options.items():
        reader = reader.option(k, v)
    flows.once(reader.parquet(source), checkpoint).foreachBatch(table.merge()).start().awaitTermination()


def table_of(spark, tmp_path, fan=3):
    return LatestTable(spark, f"{tmp_path}/table", T.StructType.fromDDL(SCHEMA), ["sample_id"], "seq", fan)


def same_as_batch(spark, table, source):
    want = latest(spark.read.parquet(source).distinct(), ["sample_id"], "seq")
    assert sorted(map(tuple, table.read().select("seq", "sample_id", "correction").collect())) == sorted(map(tuple, want.select("seq", "sample_id", "correction").collect()))


def test_latest_wins_over_batches(spark, tmp_path):
    source, checkpoint, table = f"{tmp_path}/in", f"{tmp_path}/cp", table_of(spark, tmp_path)
    assert table.read().count() == 0
    write(spark, source, [(1, 1, True), (2, 2, False), (3, 1, False)])
    stream_into(spark, source, table, checkpoint)
    write(spark, source, [(4, 2, True), (0, 1, True), (3, 1, False), (3, 1, False), (5, None, True), (None, 7, True)])  # late, repeated, and without key or number
    table = table_of(spark, tmp_path)  # a restarted job
    stream_into(spark, source, table, checkpoint)
    stream_into(spark, source, table, checkpoint)  # nothing new
    rows = table.read().select("seq", "sample_id", "correction").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(3, 1, False), (4, 2, True), (5, None, True), (None, 7, True)], key=str)


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    """Rows written over 27 batches: once a level, of which there are four."""
    table, rows = table_of(spark, tmp_path), []
    for n in range(27):
        part = [(n * 10 + k, n * 10 + k if k else 1, k % 2 == 0) for k in range(10)]
        rows += part
        table.add(spark.createDataFrame(part, SCHEMA).coalesce(1), n)
    assert [r[0] for r in table.runs()] == [3] and len(table.runs(before=26)) <= 3 * 2
    written = spark.read.parquet(f"{tmp_path}/table/runs").count()
    assert written <= 4 * len(rows)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/all")
    same_as_batch(spark, table, f"{tmp_path}/all")


@pytest.mark.parametrize("at", [0, 1, 2, 3])
def test_a_failed_batch_runs_again(spark, tmp_path, at):
    """Whatever was written before the failure, the batch is folded in once."""
    source, checkpoint = f"{tmp_path}/in", f"{tmp_path}/cp"
    for n in range(4):
        write(spark, source, [(n * 3 + k, k, n % 2 == 0) for k in range(3)])

    class Failing(LatestTable):
        def add(self, batch, number):
            if number == at:
                if at % 2:
                    super().add(batch, number)  # after the commit of the table, before that of the stream
                else:
                    self._latest(batch).write.mode("overwrite").parquet(self._folder((0, number, number)))
                raise RuntimeError("lost")
            super().add(batch, number)

    failing = Failing(spark, f"{tmp_path}/table", T.StructType.fromDDL(SCHEMA), ["sample_id"], "seq", 2)
    with pytest.raises(Exception, match="lost"):
        stream_into(spark, source, failing, checkpoint, maxFilesPerTrigger=1)
    table = table_of(spark, tmp_path, 2)
    stream_into(spark, source, table, checkpoint, maxFilesPerTrigger=1)
    same_as_batch(spark, table, source)


def test_windows_are_the_same_in_batch(spark, tmp_path):
    df = spark.range(40).select(F.timestamp_seconds(F.col("id") * 7200).alias("ts"), F.when(F.col("id") % 2 == 0, "rule").otherwise("human").alias("route"), (F.col("id") % 5 == 0).alias("abstained"), (F.col("id") / 40.0).alias("confidence"))
    df.write.parquet(f"{tmp_path}/t")
    stream = flows.with_time(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/t"))
    flows.once(flows.traffic_windows(stream), f"{tmp_path}/cp", "complete").format("memory").queryName("windows").start().awaitTermination()
    same = ["start", "route", "requests", "abstained"]
    assert sorted(map(tuple, spark.table("windows").select(*same).collect())) == sorted(map(tuple, flows.traffic_windows(df).select(*same).collect()))


def test_stale_events_are_marked_not_dropped(spark):
    df = spark.createDataFrame([(1100.0, 1000.0), (1101.0, 1000.0), (999.0, 1000.0)], "now_ms double, timestamp_ms double")
    assert [r["reason"] for r in flows.mark_stale(df).collect()] == [None, "stale_observation", "invalid_clock"]
