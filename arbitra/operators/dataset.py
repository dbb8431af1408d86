"""Dataset factory: gates, first-wins dedup, leak reports, merging, balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest, json_object, json_string, normalize_prompt
from .ranking import earliest

#: Labels of scores agree within this; confidences may differ by this at most; both below is too low.
SCORE_TOLERANCE, CONFIDENCE_GAP, LOW_CONFIDENCE = 0.20, 0.35, 0.5
SPLITS = ("train", "validation", "test")


def private(sensitivity: Column, kind: Column, allow_user: bool = False) -> Column:
    """Rows that may not enter a dataset: secret ones, and a user's unless allowed."""
    secret = F.coalesce(F.lower(sensitivity) == "secret", F.lit(False))
    user = F.coalesce(F.lower(kind) == "user", F.lit(False))
    return secret | (user & ~F.lit(allow_user))


def dedup_key(task: Column, version: Column, state: Column, question: Column) -> Column:
    """SHA-256 over task, redacted state and redacted question."""
    reference = F.concat(task, F.lit("@"), version.cast("string"))
    return digest(json_object(task=json_string(reference), state=json_string(state), question=json_string(question)))


def first_wins(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The first row per key in input order."""
    return earliest(df, key, seq)


def mark_duplicates(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """``df`` with ``duplicate``: not the first of its key. ``seq`` is different on every row.

    Hot keys are pre-aggregated, and a key is made once: the firsts are joined by ``seq``.
    """
    first = df.groupBy(*key).agg(F.min(seq).alias(seq)).select(seq, F.lit(False).alias("duplicate"))
    return df.join(first, seq, "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(True)))


def cover(left: DataFrame, right: DataFrame, id: str = "sample_id") -> DataFrame:
    """``missing, unknown, repeated``: ids of ``left`` without a row in ``right``, the other way round, and ids that ``right`` has more than once."""
    l, r = left.select(id).distinct().withColumn("_l", F.lit(1)), right.groupBy(id).agg(F.count("*").alias("_r"))
    both = l.join(r, id, "full_outer")
    return both.agg(F.count_if(F.col("_r").isNull()).alias("missing"), F.count_if(F.col("_l").isNull()).alias("unknown"), F.count_if(F.col("_r") > 1).alias("repeated"))


def same_label(kind: Column, value_a: Column, value_b: Column, score_a: Column, score_b: Column) -> Column:
    """Equal labels; scores within the tolerance."""
    return F.when(kind == "score", F.abs(score_a - score_b) <= SCORE_TOLERANCE).otherwise(value_a == value_b)


def outcome(is_private: Column, invalid: Column, duplicate: Column, human: Column, schema_ok: Column, same: Column, confidence_a: Column, confidence_b: Column) -> Column:
    """What becomes of a seed: the gates in their order.

    A human label wins over failing teachers; both confidences low, then different
    labels or a large gap, send the row to review.
    """
    low = (confidence_a < LOW_CONFIDENCE) & (confidence_b < LOW_CONFIDENCE)
    apart = ~same | (F.abs(confidence_a - confidence_b) > CONFIDENCE_GAP)
    return (
        F.when(invalid, "review_invalid_seed")
        .when(is_private, "excluded_privacy")
        .when(duplicate, "excluded_duplicate")
        .when(human.isNotNull(), "accepted_human")
        .when(~schema_ok, "review_schema_invalid")
        .when(low, "excluded_low_confidence")
        .when(apart, "review_disagreement")
        .otherwise("accepted_silver")
    )


#: Characters of an error that are kept.
ERROR_CHARS = 240


def teacher_metadata(provider: Column, model: Column, reply: Column, error: Column, elapsed_ms: Column) -> Column:
    """What is kept of a teacher's call besides its answer: of a valid one the model, a digest of the reply and the time, of a failed one the error alone."""
    valid = error.isNull() & reply.isNotNull()
    return F.struct(
        provider.alias("provider"), F.when(valid, "valid").otherwise("invalid").alias("status"), valid.alias("schema_valid"), F.when(valid, model).alias("model"), F.when(valid, digest(reply)).alias("response_sha256"),
        F.when(valid, F.round(elapsed_ms, 3)).alias("latency_ms"), F.when(~valid, F.substring(F.coalesce(error, F.lit("no reply")), 1, ERROR_CHARS)).alias("error"),
    )


def review_record(sample_id: Column, task: Column, version: Column, state: Column, question: Column, reason: Column, qwen: Column, gemma: Column) -> Column:
    """What goes to review: the sample, why, and both teachers' metadata."""
    return F.struct(
        F.lit("review").alias("record_type"), sample_id.alias("sample_id"), F.concat(task, F.lit("@"), version.cast("string")).alias("task"), state.alias("state"), question.alias("question"), digest(state).alias("state_sha256"), reason.alias("reason"),
        F.struct(qwen.alias("qwen"), gemma.alias("gemma")).alias("teacher_metadata"), F.lit(False).alias("reviewed"),
    )


def soft_boolean(value_a: Column, p_a: Column, value_b: Column, p_b: Column) -> Column:
    """Mean of both probabilities of true."""
    true = lambda v, p: F.when(v, p).otherwise(1 - p)
    return F.round((true(value_a, p_a) + true(value_b, p_b)) / 2, 6)


def soft_choice(a: Column, b: Column) -> Column:
    """Mean distribution over the union of both maps' keys."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.round((at(a, k) + at(b, k)) / 2, 6).alias("value"))))


def outcome_counts(df: DataFrame, column: str = "outcome") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, task: str = "task_id", split: str = "split") -> DataFrame:
    """Rows per task and per split in one pass: ``kind, name, n``; splits that there aren't are ``invalid``."""
    named = df.withColumn(split, F.when(F.col(split).isin(*SPLITS), F.col(split)).otherwise("invalid"))
    sets = named.groupingSets([[task], [split]], task, split).agg(F.count("*").alias("n"), F.grouping(task).alias("_g"))
    return sets.select(F.when(F.col("_g") == 0, "task").otherwise("split").alias("kind"), F.when(F.col("_g") == 0, F.col(task)).otherwise(F.col(split)).alias("name"), "n")


def golden_gate(df: DataFrame, minimum: int = 1000, human: str = "human") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count(human).alias("human")).select(
        "n", "human", F.greatest(F.lit(0), F.lit(minimum) - F.col("n")).alias("missing"), ((F.col("n") >= minimum) & (F.col("human") == F.col("n"))).alias("passed")
    )


def leaks(df: DataFrame, key: list[str], kind: str, split: str = "split", id: str = "sample_id") -> DataFrame:
    """Groups that span several splits: their size, splits and least id.

    Splits of a group are at most three, so their set is bounded.
    """
    g = df.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("_n"), F.count("*").alias("members"), F.min(id).alias("first_id"))
    return g.filter("_n > 1").select(F.lit(kind).alias("kind"), "first_id", "members", "splits")


def exact_key(task: str, version: str, language: str, domain: str, state: str, question: str) -> list[Column]:
    """The leak check's key: folded and normalised prompts."""
    return [F.col(task), F.col(version), F.col(language), F.col(domain), normalize_prompt(state).alias("_state"), normalize_prompt(question).alias("_question")]


def merge(*parts: DataFrame, id: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(all rows, ids that occur more than once)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, out.groupBy(id).agg(F.count("*").alias("n")).filter("n > 1")


def materialize_labels(df: DataFrame, labels: DataFrame, id: str = "sample_id") -> DataFrame:
    """Rows with a human label, which replaces the target; provenance says so."""
    return df.drop("target").join(labels.select(id, F.col("label").alias("target")), id).withColumn("target_source", F.lit("human"))


#: Fixed value: how the reason of a review by two people begins.
DUAL_REASON = "control dual-review "


def dual_review_error(status: Column, reviewer: Column, reason: Column) -> Column:
    """What a review lacks to prove that two people agreed; null if nothing."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(status.isNull() & reviewer.isNull() & reason.isNull(), "missing").when(F.coalesce(status, F.lit("")) != "reviewed", "status")
        .when(blank(reviewer), "reviewer").when(~F.coalesce(reason, F.lit("")).startswith(DUAL_REASON), "reason")
    )


def materialize_reviewed(df: DataFrame, reviews: DataFrame, id: str = "sample_id", dual: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows with the human's target and where it comes from, ``id, error`` of rows that can't have one).

    ``reviews`` has the label, status, reviewer and reason of each row. Nothing may be
    used as long as there are errors: the first table is empty then. Each row stays, its
    old target becomes ``materialized_from``.
    """
    r = reviews.select(F.col(id).alias("_id"), F.col("label").alias("_label"), F.col("status").alias("_status"), F.col("reviewer").alias("_reviewer"), F.col("reason").alias("_reason"))
    proof = dual_review_error(F.col("_status"), F.col("_reviewer"), F.col("_reason")) if dual else F.lit(None).cast("string")
    judged = df.join(r, F.col(id) == F.col("_id"), "left").withColumn("_error", F.when(F.col("_label").isNull(), "label").otherwise(proof))
    errors = judged.where("_error is not null").select(id, F.col("_error").alias("error"))
    ready = errors.agg((F.count("*") == 0).alias("_ready"))  # one row
    others = [c for c in df.columns if c != "target"]
    rows = judged.crossJoin(F.broadcast(ready)).where("_ready").select(*others, F.col("_label").alias("target"), F.col("target").alias("materialized_from"), F.lit("human_review").alias("target_source"))
    return rows, errors


def quality_errors(df: DataFrame, task: str, human: bool = False, id: str = "sample_id") -> DataFrame:
    """``sample_id, reason, value`` of each thing that is wrong with a row of a dataset."""
    e = lambda wrong, reason, value: F.when(wrong, F.struct(F.lit(reason).alias("reason"), F.coalesce(value, F.lit("")).alias("value")))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    found = [
        e(~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False)), "invalid_split", F.col("split")), e(~F.coalesce(F.col("task_id") == task, F.lit(False)), "unexpected_task", F.col("task_id")),
        *(e(empty(c), f"missing_{c}", F.lit("")) for c in ("scenario_id", "episode_id", "semantic_group_id")), *([e(F.col("human").isNull(), "human_label_required", F.lit("null"))] if human else []),
    ]
    return df.select(id, F.inline(F.array_compact(F.array(*found))))


def balance(df: DataFrame, label: str, seq: str) -> DataFrame:
    """Each class repeated to the largest class's size; ``copy`` counts from 0.

    The surplus copies are cut by rank in ``seq``: row k of a class of n gets one more
    copy while k <= most mod n. Ranks come from the sizes of hash buckets, two-level.
    """
    from pyspark.sql import Window

    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n").alias("_most"))
    placed = df.withColumn("_b", F.floor(F.col(seq) / 4096))
    per = placed.groupBy(label, "_b").agg(F.count("*").alias("_k"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_k0", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    ranked = placed.join(per, [label, "_b"]).withColumn("_r", F.col("_k0") + F.row_number().over(Window.partitionBy(label, "_b").orderBy(seq)))
    sized = ranked.join(F.broadcast(counts.crossJoin(most)), label)
    copies = F.expr("cast(_most div _n as int) + if(_r <= _most % _n, 1, 0)")
    return sized.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_b", "_k0", "_r", "_n", "_most")


def loss_weight(counterfactual: Column, hard: float = 2.0) -> Column:
    """Rows of a counterfactual group weigh more."""
    return F.when(F.nullif(counterfactual, F.lit("")).isNotNull(), F.lit(hard)).otherwise(F.lit(1.0))
