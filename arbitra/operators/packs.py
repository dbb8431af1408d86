"""Review packs: a queue joined to a teacher's drafts for blind review, in order of priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .review import priority_keys
from .ranking import positions

UNCERTAIN = 0.90


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def semantic_group(semantic: Column, id: Column) -> Column:
    """The group that counts as one independent example: the provenance's, or the sample alone."""
    return F.coalesce(_some(semantic), F.concat(F.lit("sample:"), id))


def counterfactual_group(counterfactual: Column, semantic: Column, id: Column) -> Column:
    """The group that is reviewed together: counterfactual siblings, else the semantic group, else the sample."""
    return F.coalesce(_some(counterfactual), _some(semantic), id)


def review_key(task: str, language: str, domain: str, state: str, question: str) -> Column:
    """What makes two review items the same: task reference and raw texts."""
    return F.struct(task, language, domain, state, question)


def focus(asked: list[str], actions: DataFrame | None, maximum: float = 0.98) -> list[str]:
    """Actions to look at first: asked for, or of low agreement by a dual review (there are as many as skills)."""
    low = [] if actions is None else [r["action"] for r in actions.filter(F.col("rate") < maximum).select("action").distinct().orderBy("action").collect()]
    return sorted({*asked, *low})


def pack_errors(queue: DataFrame, drafts: DataFrame, queue_digest: str, manifest_digest: str) -> DataFrame:
    """``error, n``: what keeps drafts from making a pack: another queue's, repeated or empty ids, samples without a draft."""
    spark = queue.sparkSession
    bound = spark.createDataFrame([("queue_sha256", int(queue_digest != manifest_digest))], "error string, n long")
    ids = drafts.groupBy("sample_id").agg(F.count("*").alias("_n"))
    repeated = ids.agg(F.lit("duplicate_or_empty_id").alias("error"), F.count_if((F.col("_n") > 1) | (F.coalesce("sample_id", F.lit("")) == "")).alias("n"))
    missing = queue.join(ids, "sample_id", "left_anti").agg(F.lit("missing_draft").alias("error"), F.count("*").alias("n"))
    return bound.unionByName(repeated).unionByName(missing).filter("n > 0")


def review_pack(queue: DataFrame, drafts: DataFrame, prioritize: bool = True, focused: list[str] | None = None, split: str | None = None) -> DataFrame:
    """Items of ``queue`` with their draft, in ``position``; what the queue has as target or label isn't among them.

    ``queue``: sample_id, task, state, question, language, domain, lineage, split, counterfactual,
    semantic, seq; ``drafts``: sample_id, provider, signature, action, schema_valid, repaired,
    confidence, student_confidence, student_disagrees.
    """
    rows = queue if split is None else queue.filter(F.col("split") == split)
    group = counterfactual_group(F.col("counterfactual"), F.col("semantic"), F.col("sample_id"))
    items = rows.select("sample_id", "task", "state", "question", "language", "domain", "lineage", "split", "seq", group.alias("group")).join(drafts, "sample_id")
    if prioritize:
        items, order = priority_keys(items, "group", "sample_id", focused)
    else:
        order = [F.col("seq")]
    out = positions(items, order)
    return out.select(
        "position", "sample_id", "group", "task", "state", "question", "language", "domain", "lineage", "split", F.struct("provider", "signature", "schema_valid", "repaired").alias("teacher"), F.lit("pending").alias("review_status"),
        "action", "confidence", "student_confidence", "student_disagrees", "signature",
    )


def pack_manifest(items: DataFrame, focused: list[str] | None = None, student: bool = True) -> DataFrame:
    """One row: how many items and groups, of those colliding, focused, uncertain and disagreeing ones, and what the order follows."""
    groups = items.groupBy("group").agg(F.count("*").alias("_n"), F.count("signature").alias("_s"), F.count_distinct("signature").alias("_d"))
    colliding = (F.col("_n") > 1) & (F.col("_s") == F.col("_n")) & (F.col("_d") == 1)
    g = groups.agg(F.count("*").alias("counterfactual_group_count"), F.count_if(colliding).alias("collision_group_count"), F.coalesce(F.sum(F.when(colliding, F.col("_n"))), F.lit(0)).alias("collision_item_count"))
    n = items.agg(
        F.count("*").alias("sample_count"), F.count_if(F.coalesce(F.col("action").isin(focused or []), F.lit(False))).alias("focus_action_item_count"), F.count_if(F.col("student_confidence") < UNCERTAIN).alias("student_uncertain_item_count"),
        F.count_if(F.col("signature").isNotNull() & F.col("student_disagrees")).alias("student_teacher_disagreement_item_count"),
    )
    apart = F.col("student_teacher_disagreement_item_count") > 0
    if student:
        head = "focus_action_then_" if focused else ""
        uncertain = F.lit("focus_action_then_uncertainty_then_teacher" if focused else "student_uncertainty_then_teacher")
        order = F.when(apart, F.lit(f"{head}student_disagreement_then_uncertainty_then_teacher")).otherwise(uncertain)
    else:
        order = F.lit("focus_action_then_teacher" if focused else "uncertain_first")
    return n.crossJoin(F.broadcast(g)).withColumn("priority_order", order)
