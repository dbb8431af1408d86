"""Release gates, temperature fitting and the model lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import nll, ratio, wilson

# Least (or, for false stops, greatest) values of a release.
LIMITS = {
    "split_accuracy": 0.99, "split_accuracy_lower": 0.99, "skill_accuracy": 0.99, "accepted_accuracy": 0.995, "accepted_coverage": 0.99, "safety_accuracy": 1.0, "stop_recall": 1.0, "stop_recall_lower": 0.99, "stop_count": 500.0, "unique_groups": 381.0,
}
GREATEST = {"false_stop_rate": 0.0}

# Which state of a model may follow which.
EDGES = [
    ("trained", "evaluated"), ("evaluated", "calibrated"), ("calibrated", "candidate"), ("candidate", "canary"), ("candidate", "retired"), ("canary", "active"), ("canary", "candidate"), ("canary", "retired"), ("active", "retired"),
    ("retired", "candidate"), ("retired", "active"),
]


def accuracy_with_bounds(df: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    n = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("right"))
    lower, upper = wilson("right", "n")
    return n.select(*by, "n", "right", ratio(F.col("right"), F.col("n")).alias("accuracy"), lower.alias("lower"), upper.alias("upper"))


def gate_rows(values: DataFrame, gate: str = "gate", subject: str = "subject", value: str = "value") -> DataFrame:
    """One row per gate and subject; what is null or not finite fails."""
    v = F.col(value)
    least = F.create_map(*(F.lit(x) for kv in LIMITS.items() for x in kv))
    most = F.create_map(*(F.lit(x) for kv in GREATEST.items() for x in kv))
    low, high = F.try_element_at(least, F.col(gate)), F.try_element_at(most, F.col(gate))
    passed = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), False).when(low.isNotNull(), v >= low).when(high.isNotNull(), v <= high).otherwise(False)
    return values.select(gate, subject, F.round(v, 6).alias(value), F.coalesce(low, high).alias("limit"), (~passed).alias("failed"))


def split_values(summary: DataFrame, split: str = "split") -> DataFrame:
    """``gate, subject, value`` of the gates of a split: from ``n, correct, accepted, accepted_correct`` per split."""
    lower, _ = wilson("correct", "n")
    d = lambda c: c.cast("double")
    gates = F.array(
        F.struct(F.lit("split_accuracy").alias("gate"), ratio(F.col("correct"), F.col("n")).alias("value")), F.struct(F.lit("split_accuracy_lower").alias("gate"), lower.alias("value")),
        F.struct(F.lit("accepted_accuracy").alias("gate"), ratio(F.col("accepted_correct"), F.col("accepted")).alias("value")), F.struct(F.lit("accepted_coverage").alias("gate"), ratio(F.col("accepted"), F.col("n")).alias("value")),
    )
    return summary.select(F.col(split).alias("subject"), F.inline(gates)).select("gate", "subject", d(F.col("value")).alias("value"))


def skill_values(summary: DataFrame, split: str = "split", skill: str = "skill") -> DataFrame:
    """Accuracy of each skill of each split, from ``n, correct``; a skill without rows has none and fails."""
    return summary.select(F.lit("skill_accuracy").alias("gate"), F.concat(split, F.lit(":"), skill).alias("subject"), ratio(F.col("correct"), F.col("n")).alias("value"))


def safety_values(report: DataFrame) -> DataFrame:
    """The gates of a safety report: ``accuracy, stop_recall, stop_recall_lower, stops, false_stop_rate``."""
    names = {"safety_accuracy": "accuracy", "stop_recall": "stop_recall", "stop_recall_lower": "stop_recall_lower", "stop_count": "stops", "false_stop_rate": "false_stop_rate"}
    return report.select(F.inline(F.array(*(F.struct(F.lit(g).alias("gate"), F.lit("safety").alias("subject"), F.col(c).cast("double").alias("value")) for g, c in names.items()))))


def temperature_grid(steps: int = 76, minimum: float = 0.25, maximum: float = 4.0) -> Column:
    width = (maximum - minimum) / (steps - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.lit(minimum) + F.lit(width) * i)


def fit_temperature(df: DataFrame, by: list[str], logits: str = "logits", label: str = "label", minimum_samples: int = 1, steps: int = 76) -> DataFrame:
    """The grid's temperature of least mean loss per group, the lesser on ties, with the loss before and after; none below ``minimum_samples``.

    Losses are equal if they are to twelve digits: sums depend on the order of rows beyond
    that. The grid, and 1 for the loss before, are unfolded per row and summed map-side.
    """
    grid = F.array_append(F.transform(temperature_grid(steps), lambda t: F.struct(t.alias("t"), F.lit(True).alias("fit"))), F.struct(F.lit(1.0).alias("t"), F.lit(False).alias("fit")))
    rows = df.select(*by, logits, label, F.inline(grid))
    loss = rows.groupBy(*by, "t", "fit").agg(F.avg(nll(F.col(logits), F.col(label), F.col("t"))).alias("_l"), F.count("*").alias("n"))
    best = loss.groupBy(*by).agg(
        F.min(F.when(F.col("fit"), F.struct(F.round("_l", 12).alias("nll"), F.round("t", 6).alias("temperature")))).alias("b"), F.max(F.when(~F.col("fit"), F.col("_l"))).alias("_before"), F.max("n").alias("n")
    )
    enough = F.col("n") >= minimum_samples
    return best.select(
        *by, "n", F.when(enough, "fitted").otherwise("insufficient").alias("status"), F.when(enough, F.col("b.temperature")).alias("temperature"), F.when(enough, F.round("_before", 6)).alias("nll_before"), F.when(enough, F.round("b.nll", 6)).alias("nll")
    )


def edges(spark: SparkSession) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(a).alias("from_status"), F.lit(b).alias("to_status")) for a, b in EDGES))
    return spark.range(1).select(F.inline(pairs))


def transitions(models: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked-for status changes with ``allowed``; models without a request are left out."""
    spark = models.sparkSession
    rows = models.join(asked, "model_id").withColumnRenamed("status", "from_status")
    return rows.join(F.broadcast(edges(spark)).withColumn("_ok", F.lit(True)), ["from_status", "to_status"], "left").select("model_id", "from_status", "to_status", F.coalesce("_ok", F.lit(False)).alias("allowed"))
