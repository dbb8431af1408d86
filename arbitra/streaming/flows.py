"""Streams over append-only logs: counters, dedup, staleness; latest-wins is in ``latest``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.control import staleness


def with_time(df: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Zone-less timestamps as instants, with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def traffic_windows(df: DataFrame, ts: str = "ts", width: str = "1 day") -> DataFrame:
    """Requests, abstentions and summed confidence per window and route, for streams and tables."""
    return df.groupBy(F.window(ts, width), "route").agg(
        F.count("*").alias("requests"), F.count_if("abstained").alias("abstained"), F.sum("confidence").alias("confidence")
    ).select(F.col("window.start").alias("start"), "route", "requests", "abstained", "confidence")


def route_windows(df: DataFrame, ts: str = "ts", width: str = "1 day") -> DataFrame:
    """``start, route, requests, abstained`` of each window: what drift needs of it. Late rows count until the watermark has passed their window."""
    return df.groupBy(F.window(ts, width), "route").agg(F.count("*").alias("requests"), F.count_if("abstained").alias("abstained")).select(F.col("window.start").alias("start"), "route", "requests", "abstained")


def window_drift(counts: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Drift of each window against the one before it that had requests: ``start, measure, shift, drifted``.

    ``counts`` has a row per window and route, as a :class:`LatestTable` keeps of
    :func:`route_windows`: so few that the windows are put in order by one sort.
    """
    totals = counts.groupBy("start").agg(F.sum("requests").alias("_n"), F.sum("abstained").alias("_x"))
    order = Window.orderBy("start")
    pairs = totals.select("start", "_n", "_x", *(F.lag(c).over(order).alias(f"{c}0") for c in ("start", "_n", "_x"))).where("start0 is not null")
    now = counts.join(pairs.select("start", "_n"), "start").select("start", "route", (F.col("requests") / F.col("_n")).alias("s"))
    was = pairs.select(F.col("start").alias("_to"), F.col("start0"), "_n0").join(counts.withColumnRenamed("start", "start0"), "start0").select(F.col("_to").alias("start"), "route", (-F.col("requests") / F.col("_n0")).alias("s"))
    routes = now.unionByName(was).groupBy("start", "route").agg(F.sum("s").alias("_s")).select("start", F.concat(F.lit("route:"), F.col("route")).alias("measure"), "_s")
    abstain = pairs.select("start", F.lit("abstain_rate").alias("measure"), (F.col("_x") / F.col("_n") - F.col("_x0") / F.col("_n0")).alias("_s"))
    return abstain.unionByName(routes).select("start", "measure", F.round("_s", 6).alias("shift"), (F.abs("_s") > threshold).alias("drifted"))


def first_in_time(df: DataFrame, key: list[str]) -> DataFrame:
    """The first row per key within the watermark: state is bounded by it."""
    return df.dropDuplicatesWithinWatermark(key)


def mark_stale(df: DataFrame) -> DataFrame:
    """A stateless policy per event, not a watermark: late events are kept and marked."""
    return df.withColumn("reason", staleness(F.col("now_ms"), F.col("timestamp_ms")))


def once(df: DataFrame, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """Run over all that is there and stop; the checkpoint makes the job resumable."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
