"""Review workflow: latest feedback, dual review, adjudication, priorities, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .ranking import latest, positions


def latest_feedback(log: DataFrame, key: str = "sample_id", seq: str = "seq") -> DataFrame:
    """The last correction per sample in append order."""
    return latest(log, [key], seq)


def apply_feedback(queue: DataFrame, log: DataFrame, key: str = "sample_id") -> DataFrame:
    """The queue with ``label`` and ``status`` from the latest feedback, pending where there is none."""
    newest = latest_feedback(log, key).select(key, F.col("correction").alias("_c"), F.col("reviewer").alias("reviewer"))
    return queue.join(newest, key, "left").withColumn("status", F.when(F.col("_c").isNotNull(), "reviewed").otherwise("pending")).withColumnRenamed("_c", "label")


def pending(queue: DataFrame, log: DataFrame, key: str = "sample_id") -> DataFrame:
    return queue.join(log.select(key), key, "left_anti")


def reviewed(queue: DataFrame, log: DataFrame, key: str = "sample_id") -> DataFrame:
    return queue.join(log.select(key), key, "left_semi")


def review_status(queue: DataFrame, log: DataFrame, split: str = "split", key: str = "sample_id") -> DataFrame:
    """Per split: rows, reviewed, pending, coverage, whether it is complete."""
    done = log.select(key).distinct().withColumn("_d", F.lit(1))
    n = queue.join(done, key, "left").groupBy(split).agg(F.count("*").alias("n"), F.count("_d").alias("reviewed"))
    return n.select(split, "n", "reviewed", (F.col("n") - F.col("reviewed")).alias("pending"), ratio(F.col("reviewed"), F.col("n")).alias("coverage"), (F.col("n") == F.col("reviewed")).alias("complete"))


def review_actions(queue: DataFrame, log: DataFrame, action: str, key: str = "sample_id") -> DataFrame:
    """Per action of the latest feedback: how many samples have it."""
    newest = latest_feedback(log, key).select(key, action)
    return queue.select(key).join(newest, key).groupBy(action).agg(F.count("*").alias("n"))


def readiness(queue: DataFrame, log: DataFrame, split: str = "split", key: str = "sample_id") -> DataFrame:
    """One row: whether everything is reviewed, and whether the test split is."""
    s = review_status(queue, log, split, key)
    return s.agg(F.bool_and("complete").alias("all_splits"), F.coalesce(F.bool_or(F.when(F.col(split) == "test", F.col("complete"))), F.lit(False)).alias("test"), F.sum("pending").alias("pending"))


def dual_status(a: Column, b: Column) -> Column:
    return (
        F.when(a.isNull() & b.isNull(), "missing_both").when(a.isNull(), "missing_a").when(b.isNull(), "missing_b").when(a == b, "agreed").otherwise("disagreement")
    )


def dual_counts(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return df.groupBy(dual_status(F.col(a), F.col(b)).alias("status")).agg(F.count("*").alias("n"))


def dual_pairs(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows per pair of labels, ``a->b``."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(F.concat(F.col(a).cast("string"), F.lit("->"), F.col(b).cast("string")).alias("pair")).agg(F.count("*").alias("n"))


def dual_actions(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per action: agreed and disagreeing reviews (a disagreement counts for both labels) and the rate."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    same = F.col(a) == F.col(b)
    rows = both.select(F.explode(F.when(same, F.array(a)).otherwise(F.array(a, b))).alias("action"), same.alias("same"))
    n = rows.groupBy("action").agg(F.count_if("same").alias("agreed"), F.count_if(~F.col("same")).alias("disagreed"))
    return n.withColumn("rate", ratio(F.col("agreed"), F.col("agreed") + F.col("disagreed")))


def action_summary(df: DataFrame) -> DataFrame:
    """Actions with their ``position`` by rate (null last), then most disagreements, then name."""
    order = [F.col("rate").asc_nulls_last(), F.col("disagreed").desc(), F.col("action")]
    return positions(df, order)


def dual_gate(df: DataFrame, minimum: float = 0.98, a: str = "a", b: str = "b") -> DataFrame:
    """Nothing missing and agreement of at least ``minimum``."""
    n = df.agg(F.count("*").alias("n"), F.count_if(F.col(a).isNull() | F.col(b).isNull()).alias("missing"), F.count_if(F.col(a) == F.col(b)).alias("agreed"))
    rate = ratio(F.col("agreed"), F.col("n") - F.col("missing"))
    return n.withColumn("rate", rate).withColumn("passed", (F.col("missing") == 0) & F.coalesce(F.col("rate") >= minimum, F.lit(False)))


def focus_actions(actions: DataFrame, maximum: float = 0.98) -> DataFrame:
    return actions.filter(F.col("rate") < maximum)


def finalize(df: DataFrame, adjudicated: DataFrame, key: str = "sample_id", a: str = "a", b: str = "b") -> DataFrame:
    """Agreed rows, and disagreements as adjudicated; without a ruling they stay out."""
    agreed = df.filter(F.col(a) == F.col(b)).select(key, F.col(a).alias("label"), F.lit("agreed").alias("source"))
    ruled = df.filter(F.col(a) != F.col(b)).join(adjudicated, key).select(key, "label", F.lit("adjudicated").alias("source"))
    return agreed.unionByName(ruled)


def unruled(df: DataFrame, adjudicated: DataFrame, key: str = "sample_id", a: str = "a", b: str = "b") -> DataFrame:
    return df.filter(F.col(a) != F.col(b)).join(adjudicated, key, "left_anti")


def signature(kind: Column, value: Column, selected: Column, score: Column) -> Column:
    """Type and value; scores to 6 digits."""
    return F.concat_ws(":", kind, F.when(kind == "boolean", value.cast("string")).when(kind == "choice", selected).otherwise(F.round(score, 6).cast("string")))


def adjudicate(a: Column, b: Column) -> Column:
    """Of two signatures, null where invalid or abstained."""
    return F.when(a.isNull() | b.isNull(), "invalid_or_abstained").when(a == b, "agreed").otherwise("disagreement")


def propagate(df: DataFrame, key: list[str], pos: str, label: str) -> DataFrame:
    """Rows of a group without a label get the last label of the group by position."""
    last = df.filter(F.col(label).isNotNull()).groupBy(*key).agg(F.max_by(label, pos).alias("_last"))
    return df.join(last, key, "left").withColumn("propagated", F.coalesce(F.col(label), F.col("_last"))).drop("_last")


def collisions(df: DataFrame, group: str, signature: str) -> DataFrame:
    """Groups of several rows that all have one signature."""
    g = df.groupBy(group).agg(F.count("*").alias("members"), F.count(signature).alias("_s"), F.count_distinct(signature).alias("_d"))
    return g.filter("members > 1 and members = _s and _d = 1").select(group, "members")


def teacher_rank(schema_valid: Column, repaired: Column, confidence: Column, id: Column) -> Column:
    """Order key: invalid, then repaired, then by confidence, then by id."""
    level = F.when(~schema_valid, 0).when(repaired, 1).otherwise(2)
    return F.struct(level.alias("level"), F.when(level == 2, confidence).otherwise(F.lit(0.0)).alias("confidence"), id.alias("id"))


def priority_keys(items: DataFrame, group: str = "group", id: str = "sample_id", focus: list[str] | None = None) -> tuple[DataFrame, list[Column]]:
    """(``items`` with the keys of the review order, the keys) for :func:`positions`.

    Columns needed: signature, action, schema_valid, repaired, confidence,
    student_confidence, student_disagrees. Groups stay together: collisions first,
    then those with a focus action, then with a student's disagreement, then by the
    least student confidence, the least teacher rank, and the group's name. Group keys
    are aggregates that are joined back.
    """
    rank = teacher_rank(F.col("schema_valid"), F.col("repaired"), F.col("confidence"), F.col(id))
    rows = items.withColumn("_rank", rank)
    focused = F.coalesce(F.col("action").isin(focus or []), F.lit(False))
    g = rows.groupBy(group).agg(
        F.when((F.count("*") > 1) & (F.count("signature") == F.count("*")) & (F.count_distinct("signature") == 1), 0).otherwise(1).alias("not_collision"),
        F.min(F.when(focused, 0).otherwise(1)).alias("not_focus"), F.min(F.when(F.col("student_disagrees") & F.col("signature").isNotNull(), 0).otherwise(1)).alias("not_disagreeing"),
        F.coalesce(F.min("student_confidence"), F.lit(1.0)).alias("least_confidence"), F.min("_rank").alias("_least"),
    )
    order = [F.col(c) for c in ("not_collision", "not_focus", "not_disagreeing", "least_confidence", "_least", group, "_rank")]
    return rows.join(g, group), order


def review_priority(items: DataFrame, group: str = "group", id: str = "sample_id", focus: list[str] | None = None) -> DataFrame:
    """``items`` in the review order, with their ``position`` and the keys that make it."""
    return positions(*priority_keys(items, group, id, focus)).drop("_least", "_rank").orderBy("position")


def batch_of_groups(df: DataFrame, group: str, offset: int, limit: int) -> DataFrame:
    """The rows of the groups at positions ``offset``.. in order of name: a page of a queue."""
    names = df.select(group).distinct().orderBy(group).offset(offset).limit(limit)
    return df.join(names, group, "left_semi")


def first_pending(df: DataFrame, pos: str, status: str = "status") -> DataFrame:
    return df.agg(F.min(F.when(F.col(status) == "pending", F.col(pos))).alias("resume_at"))
