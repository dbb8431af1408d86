"""Streams over the events table, run once over all that is there, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import routing
from ..operators.ranking import latest
from ..sources import adapters as A
from ..sources.shared import shared_folder
from ..streaming import flows
from ..streaming.cache import cached_answers
from ..streaming.latest import LatestTable
from . import views as V
from . import workflow


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream; single files are read through a glob."""
    schema = A.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def _run(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark, out = df.sparkSession, shared_folder(df.sparkSession, name)
    if mode == "append":
        flows.once(df, f"{out}/checkpoint").format("parquet").option("path", f"{out}/rows").start().awaitTermination()
    else:
        # every batch's changes as a folder of its own; a repeated batch overwrites its own
        write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/n={n}")
        flows.once(df, f"{out}/checkpoint", mode).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counters by update; of each window the last update counts."""
    e = flows.with_time(_events(spark, sf_dir))
    route = F.when(F.col("event_type") == "view", "rule").when(F.col("event_type") == "click", "qwen").when(F.col("event_type") == "purchase", "gemma").otherwise("human")
    t = e.select("ts", route.alias("route"), (F.col("event_type") == "error").alias("abstained"), (A.keyed("event_id", "confidence", 1001) / 1000.0).alias("confidence"))
    rows = _run(flows.traffic_windows(t), "traffic", "update")
    return latest(rows.select("start", "route", "requests", "abstained", "confidence", "batch"), ["start", "route"], "batch").select(
        F.to_date("start").cast("string").alias("day"), "route", "requests", "abstained", F.round("confidence", 3).alias("confidence")
    )


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = flows.with_time(_events(spark, sf_dir))
    route = F.when(F.col("event_type") == "view", "rule").when(F.col("event_type") == "click", "qwen").when(F.col("event_type") == "purchase", "gemma").otherwise("human")
    return e.select("ts", route.alias("route"), (F.col("event_type") == "error").alias("abstained"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each day and route, kept up by a stream as a table of latest rows."""
    path, counts = shared_folder(spark, "drift"), flows.route_windows(_routed(spark, sf_dir))
    table = LatestTable(spark, f"{path}/table", T.StructType.fromDDL("start timestamp, route string, requests long, abstained long"), ["start", "route"], "requests")
    flows.once(counts, f"{path}/checkpoint", "update").foreachBatch(table.merge()).start().awaitTermination()
    return table.read()


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half against the first, by the stream's counters."""
    counts, cut = _windows(spark, sf_dir), F.lit("2024-01-16").cast("timestamp")
    return routing.drift_of_counts(counts.where(F.col("start") < cut), counts.where(F.col("start") >= cut))


def _daily_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.window_drift(_windows(spark, sf_dir)).select(F.to_date("start").cast("string").alias("day"), "measure", "shift", "drifted")


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a stream answered from a small cache; whether an answer is accepted depends on the key, so that SQL can count what was used in between."""
    key = F.col("user_id") * 7 + F.col("event_id") % 5
    e = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), key.cast("string").alias("cache_key"), F.col("event_id").alias("at_ms"), F.col("event_type").alias("answer"), (key % 4 != 0).alias("accepted"))
    return _run(cached_answers(e, bound=40, shards=1).select("seq", "cache_key", "hit"), "cached")


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of a stream, each once; the watermark spans all events here."""
    e = flows.with_time(_events(spark, sf_dir), delay="3650 days")
    return _run(flows.first_in_time(e, ["user_id"]).select("user_id"), "first")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("seq"), (A.keyed("event_id", "correction", 2) == 1).alias("correction"))
    path = shared_folder(spark, "latest")
    table = LatestTable(spark, f"{path}/table", e.schema, ["sample_id"], "seq")
    flows.once(e, f"{path}/checkpoint").foreachBatch(table.merge()).start().awaitTermination()
    return table.read()


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).cast("double")
    e = _events(spark, sf_dir).select(F.col("event_id").alias("observation_id"), stamp.alias("timestamp_ms"), (stamp + A.keyed("event_id", "clock", 205) - 5).alias("now_ms"))
    return _run(flows.mark_stale(e).select("observation_id", "reason"), "stale")


QUERIES = {"stream_drift": _drift, "stream_daily_drift": _daily_drift, "stream_cache": _cached, "stream_traffic": _traffic, "stream_dedup": _first, "stream_latest": _latest, "stream_staleness": _stale}
SQL = {
    "stream_drift": workflow.SQL["drift_compare"],
    "stream_daily_drift": "WITH " + V.TRAFFIC + """, n AS (SELECT ts::DATE AS day, route, count(*)::DOUBLE AS n, count(*) FILTER (abstained)::DOUBLE AS x FROM tr GROUP BY 1, 2), t AS (SELECT day, sum(n) AS n, sum(x) AS x FROM n GROUP BY 1),
 p AS (SELECT day, n, x, lag(day) OVER w AS d0, lag(n) OVER w AS n0, lag(x) OVER w AS x0 FROM t WINDOW w AS (ORDER BY day)),
 s AS (SELECT p.day, route, n.n / p.n AS s FROM n JOIN p ON p.day = n.day WHERE d0 IS NOT NULL UNION ALL SELECT p.day, route, -n.n / p.n0 FROM n JOIN p ON p.d0 = n.day),
 m AS (SELECT day, 'route:' || route AS measure, sum(s) AS s FROM s GROUP BY 1, 2 UNION ALL SELECT day, 'abstain_rate', x / n - x0 / n0 FROM p WHERE d0 IS NOT NULL)
 SELECT day::VARCHAR AS day, measure, round(s, 6) AS shift, abs(s) > .1 AS drifted FROM m""",
    # a hit: the key was used before, and fewer than 40 accepted keys since
    "stream_cache": """WITH e AS (SELECT event_id AS seq, user_id * 7 + event_id % 5 AS k FROM events), p AS (SELECT seq, k, k % 4 <> 0 AS ok, lag(seq) OVER (PARTITION BY k ORDER BY seq) AS was FROM e)
 SELECT a.seq, a.k::VARCHAR AS cache_key, a.ok AND a.was IS NOT NULL AND count(DISTINCT b.k) < 40 AS hit FROM p a LEFT JOIN p b ON b.seq > a.was AND b.seq < a.seq AND b.ok AND a.ok GROUP BY a.seq, a.k, a.ok, a.was""",
    "stream_traffic": workflow.SQL["traffic_daily_window"],
    "stream_dedup": "SELECT DISTINCT user_id FROM events",
    "stream_latest": "WITH " + V.FEEDBACK + " SELECT sample_id, max(seq) AS seq, arg_max(correction, seq) AS correction FROM fb GROUP BY 1",
    "stream_staleness": "WITH " + V.OBSERVATIONS + " SELECT observation_id, CASE WHEN now_ms < timestamp_ms THEN 'invalid_clock' WHEN now_ms - timestamp_ms > 100 THEN 'stale_observation' END AS reason FROM ob",
}
