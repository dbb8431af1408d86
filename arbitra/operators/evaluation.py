"""Reports of evaluations: summaries, gates with their reasons, rule coverage and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .quantiles import nearest, order_statistics, upper_median


def evaluation_target(human: Column, human_abstained: Column, target: Column) -> Column:
    """``value, source, error`` of what a prediction is held against: a human's label, else the sample's target; a human may not abstain."""
    error = F.when(human.isNotNull() & F.coalesce(human_abstained, F.lit(False)), "human_abstained")
    return F.struct(F.when(error.isNull(), F.coalesce(human, target)).alias("value"), F.when(human.isNull(), "sample.target").otherwise("human").alias("source"), error.alias("error"))


def with_rules(df: DataFrame, rule_value: str, rule_probability: str) -> DataFrame:
    """Predictions that a rule overrides: its answer and probability, accepted, by way of ``rule``."""
    ruled = F.col(rule_value).isNotNull()
    return df.withColumns({
        "prediction": F.when(ruled, F.col(rule_value)).otherwise(F.col("prediction")), "confidence": F.when(ruled, F.round(rule_probability, 6)).otherwise(F.col("confidence")),
        "accepted": ruled | F.col("accepted"), "route": F.when(ruled, "rule").otherwise(F.col("route")), "correct": F.when(ruled, F.col(rule_value) == F.col("target")).otherwise(F.col("correct")),
    })


def summary(df: DataFrame, by: str = "task_id", whole: str = "overall") -> DataFrame:
    """Overall and per task: counts, accuracy, accepted ones and theirs, coverage and what falls back."""
    n = df.groupingSets([[], [by]], by).agg(
        F.grouping(by).alias("_g"), F.count("*").alias("count"), F.count_if("correct").alias("correct"), F.count_if("accepted").alias("accepted_count"), F.count_if(F.col("accepted") & F.col("correct")).alias("accepted_correct")
    )
    return n.select(
        F.when(F.col("_g") == 1, whole).otherwise(F.col(by)).alias("subject"), "count", "correct", ratio(F.col("correct"), F.col("count")).alias("accuracy"), "accepted_count", "accepted_correct", ratio(F.col("accepted_correct"), F.col("accepted_count")).alias("accepted_accuracy"),
        ratio(F.col("accepted_count"), F.col("count")).alias("coverage"), (F.col("count") - F.col("accepted_count")).alias("fallback_count"),
    )


def quality_gate(df: DataFrame, minimum: float = 0.99, minimum_accepted: float = 0.995, minimum_task: float = 0.98, by: str = "task_id", human: str = "human") -> DataFrame:
    """``ready, reasons, task_failures`` of predictions: human labels everywhere, accuracy overall, of accepted ones and of each task.

    Failing tasks are listed; there are as many as the catalog has.
    """
    s = summary(df, by)
    low = F.coalesce("accuracy", F.lit(0.0))
    failing = s.filter(F.col("subject") != "overall").agg(F.array_join(F.array_sort(F.collect_list(F.when(low < minimum_task, F.col("subject")))), ",").alias("task_failures"))
    labelled = df.agg(F.count(human).alias("_h"), F.count("*").alias("_n"))
    whole = s.filter(F.col("subject") == "overall").crossJoin(F.broadcast(failing)).crossJoin(F.broadcast(labelled))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_h") != F.col("_n"), "human_labels_required"), F.when(low < minimum, "overall_accuracy_below_threshold"), F.when(F.coalesce(F.col("accepted_accuracy") < minimum_accepted, F.lit(True)), "accepted_accuracy_below_threshold"),
            F.when(F.col("task_failures") != "", "task_accuracy_below_threshold"),
        )
    )
    return whole.select((F.size(reasons) == 0).alias("ready"), F.array_join(reasons, ",").alias("reasons"), "task_failures", F.col("_h").alias("human_labeled_count"), F.col("_n").alias("row_count"))


def _told(target: str, skill: str) -> tuple[Column, Column]:
    known = F.col(target).isNotNull() & F.col(skill).isNotNull()
    return F.count_if(known), F.count_if(known & (F.col(skill) == F.col(target)))


def rule_coverage(df: DataFrame, skill: str = "skill", source: str = "source", target: str = "target", human: str = "human") -> DataFrame:
    """One row: what rules resolve of a queue, and how right they are by synthetic and by human targets, kept apart.

    ``skill`` is null where no rule decides. There are as many sources as kinds of rules.
    """
    labelled, right = _told(target, skill)
    human_labelled, human_right = _told(human, skill)
    per = df.groupBy(source).agg(
        F.count("*").alias("n"), F.count(skill).alias("resolved"), labelled.alias("labelled"), right.alias("right"), human_labelled.alias("human_labelled"), human_right.alias("human_right")
    )
    each = F.transform(F.array_sort(F.collect_list(F.struct(source, "n"))), lambda x: F.concat(x[source], F.lit("="), x["n"].cast("string")))
    t = per.agg(*(F.sum(c).alias(c) for c in ("n", "resolved", "labelled", "right", "human_labelled", "human_right")), F.array_join(each, ",").alias("sources"))
    return t.select(
        F.col("n").alias("row_count"), F.col("resolved").alias("resolved_count"), (F.col("n") - F.col("resolved")).alias("unresolved_count"), ratio(F.col("resolved"), F.col("n")).alias("coverage"), "sources", F.col("labelled").alias("synthetic_labeled"),
        ratio(F.col("right"), F.col("labelled")).alias("synthetic_accuracy"), F.col("human_labelled").alias("human_labeled"), ratio(F.col("human_right"), F.col("human_labelled")).alias("human_accuracy"), (F.col("human_labelled") == F.col("n")).alias("human_label_gate"),
    )


def replay(df: DataFrame, skill: str = "skill", source: str = "source", target: str = "target", latency: str = "latency") -> DataFrame:
    """Overall and per source of decision: accuracy, recall of stops and the latency bundle."""
    labelled, right = _told(target, skill)
    stops = F.count_if(F.col(target) == "STOP")
    # every row once for its source and once for all
    rows = df.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("all"), F.col(source).alias("_source"), skill, target, latency).select(F.when(F.col("all"), "all").otherwise(F.col("_source")).alias("source"), "all", skill, target, latency)
    n = rows.groupBy("source", "all").agg(ratio(right, labelled).alias("accuracy"), ratio(F.count_if((F.col(target) == "STOP") & (F.col(skill) == "STOP")), stops).alias("stop_recall"))
    times = order_statistics(rows, ["source", "all"], latency, {f"p{p}": nearest(p) for p in (50, 95, 99)}).withColumnsRenamed({"source": "_s", "all": "_a"})
    joined = n.join(times, F.col("source").eqNullSafe(F.col("_s")) & (F.col("all") == F.col("_a")))
    return joined.select("source", F.col("rows").alias("row_count"), "accuracy", "stop_recall", *(F.round(c, 3).alias(c) for c in ("p50", "p95", "p99")), F.round("greatest", 3).alias("max"), F.round("mean", 3).alias("mean"))


def simulation(df: DataFrame, most_ms: float, skill: str = "skill", target: str = "target", stopped: str = "abstained", latency: str = "latency") -> DataFrame:
    """One row of a simulated control loop: accuracy, recall of safe stops, false ones, latency and whether its 95th percentile is within the limit."""
    expected = F.col(target) == "STOP"
    n = df.agg(
        F.count("*").alias("n"), ratio(F.count_if(F.col(skill) == F.col(target)), F.count("*")).alias("accuracy"), ratio(F.count_if(expected & (F.col(skill) == "STOP")), F.count_if(expected)).alias("stop_recall"),
        ratio(F.count_if(~expected & F.col(stopped)), F.count_if(~expected)).alias("false_stop_rate"),
    )
    times = order_statistics(df, [], latency, {"p50": upper_median, "p95": nearest(95), "p99": nearest(99)}).drop("n", "rows")
    # one row each
    return n.crossJoin(times).select(
        "n", "accuracy", "stop_recall", "false_stop_rate", *(F.round(c, 3).alias(c) for c in ("p50", "p95", "p99")), F.round("greatest", 3).alias("max"), F.round("mean", 3).alias("mean"), (F.col("p95") <= most_ms).alias("within_limit")
    )
