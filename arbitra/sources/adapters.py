"""Decision-shaped views of the star-schema and text tables.

None of those tables holds predictions, so they are derived by hashing keys, with
expressions that any SQL engine repeats exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_number

PROVIDERS = ("a", "b")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(key: Column | str, salt: str, most: int) -> Column:
    """A number below ``most`` from the key and a salt."""
    k = F.col(key) if isinstance(key, str) else key
    return hash_number(F.concat(k.cast("string"), F.lit(f":{salt}"))) % most


def event_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of all events as ``id``: what generated queues are made of."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draft per document and provider."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    out = docs.select("doc_id", F.explode(F.array(*map(F.lit, PROVIDERS))).alias("provider"))
    h = hash_number(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("provider"))) % 10001
    return out.withColumn("h", h).select(
        "doc_id", "provider", "h", (F.col("h") / 10000.0).alias("p"), (F.col("h") >= 5000).alias("value"), (F.col("h") / 10.0).alias("latency_ms"),
        (F.col("h") % 17 != 0).alias("schema_valid"), (F.col("h") % 23 == 0).alias("abstained"), (F.col("h") % 19 == 0).alias("repaired"), (F.col("h") % 512).alias("tokens"),
    )


def binary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """provider, doc_id, label, p, confidence, correct of labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("label"))
    joined = drafts(spark, sf_dir).join(labels, "doc_id")
    return joined.select(
        "provider", "doc_id", "label", "p", F.greatest("p", 1 - F.col("p")).alias("confidence"), ((F.col("h") >= 5000) == F.col("label")).alias("correct")
    )


def choice_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, label, class, w, p in long form: one row per event and class; an event's p sum to 1."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"))
    weight = lambda c: 1 + hash_number(F.concat(F.col("event_id").cast("string"), F.lit(f":{c}"))) % 1000
    weighed = events.select("event_id", "label", F.array(*(F.struct(F.lit(c).alias("class"), weight(c).alias("w")) for c in EVENT_TYPES)).alias("each"))
    total = F.aggregate("each", F.lit(0).cast("bigint"), lambda a, x: a + x["w"])
    long = weighed.select("event_id", "label", total.alias("total"), F.inline("each"))
    return long.select("event_id", "label", "class", "w", (F.col("w") / F.col("total").cast("double")).alias("p"))


def score_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, value and interval of each line item, all in 0..1."""
    items = table(spark, sf_dir, "lineitem")
    value = F.round(F.col("l_tax") * 10, 4)
    return items.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("grp"), F.round(F.col("l_discount") * 10, 4).alias("target"), value.alias("value"),
        F.greatest(F.lit(0.0), F.round(value - 0.1, 4)).alias("lower"), F.least(F.lit(1.0), F.round(value + 0.1, 4)).alias("upper"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviewers' labels of each labelled document; a null is a missing review."""
    labels = table(spark, sf_dir, "labels")

    def one(name: str) -> Column:
        h = keyed("doc_id", f"reviewer_{name}", 100)
        return F.when(h < 5, F.lit(None)).when(h < 15, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int")

    return labels.select("doc_id", "quality", one("a").alias("a"), one("b").alias("b"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log: several corrections per document, ordered by ``seq``."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("sample_id"), (keyed("event_id", "correction", 2) == 1).alias("correction"), F.col("event_type").alias("reviewer")
    )


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, ts, route, abstained, confidence."""
    events = table(spark, sf_dir, "events")
    route = F.when(F.col("event_type") == "view", "rule").when(F.col("event_type") == "click", "qwen").when(F.col("event_type") == "purchase", "gemma").otherwise("human")
    return events.select(
        F.col("event_id").alias("request_id"), "ts", route.alias("route"), (F.col("event_type") == "error").alias("abstained"), (keyed("event_id", "confidence", 1001) / 1000.0).alias("confidence")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded control observations with their clock."""
    events = table(spark, sf_dir, "events")
    stamp = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).cast("double")
    offset = keyed("event_id", "clock", 205) - 5
    return events.select(
        F.col("event_id").alias("observation_id"), stamp.alias("timestamp_ms"), (stamp + offset).alias("now_ms"), (F.col("event_type") == "error").alias("emergency_stop"),
        (keyed("event_id", "abstain", 10) == 0).alias("abstained"), (keyed("event_id", "confidence", 1001) / 1000.0).alias("confidence"), keyed("event_id", "ttl", 120).cast("int").alias("ttl_ms"),
    )
