"""The router's cascade with its attempts, deadline, traces, payloads and cache."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest, json_object, json_string, result_cache_key, state_cache_key

MODEL, CALIBRATION = "phase1-router", "phase1-router-uncalibrated"
#: The provider before which the deadline is looked at.
LAST = "gemma"


@dataclass(frozen=True)
class Stage:
    """A provider's answer to a question: null where it failed; whether the task's thresholds accept it; what it took."""

    name: str
    answer: Column
    accepted: Column
    elapsed_ms: Column


def attempts(stages: list[Stage], started_ms: Column, deadline_ms: Column, allow_fallback: Column) -> Column:
    """``list`` of (provider, status, accepted, latency_ms) in order, ``route, answer, abstained, reason, elapsed_ms`` of a question.

    The first stage is the rules': no answer is no attempt there. Others follow if
    fallback is allowed, until one is accepted; before the last one the time since the
    request's start is held against the deadline. ``reason`` is why it went on last, even
    if a later stage was accepted. Without an accepted answer the last valid one goes to
    a human, abstained.
    """
    ok = lambda s: F.coalesce(s.answer.isNotNull() & s.accepted, F.lit(False))
    none = F.lit(None).cast("string")
    status = lambda s: F.when(s.answer.isNull(), "error").when(ok(s), "accepted").otherwise("uncertain")
    rule, *rest = stages
    done, late = ok(rule), F.lit(False)
    spent = F.lit(0.0)
    reason = F.when(~done & ~allow_fallback, F.lit("fallback_disabled")).otherwise(none)
    last, route = rule.answer, F.when(done, F.lit(rule.name))
    # an uncertain rule is no answer to fall back on
    valid = F.when(done, rule.answer)
    listed = [F.when(rule.answer.isNotNull(), F.struct(F.lit(rule.name).alias("provider"), status(rule).alias("status"), ok(rule).alias("accepted"), F.lit(0.0).alias("latency_ms")))]
    for s in rest:
        if s.name == LAST:
            late = ~done & allow_fallback & (started_ms + spent >= deadline_ms)
            reason = F.when(late, F.lit(f"deadline_exceeded_before_{LAST}")).otherwise(reason)
        tried = ~done & allow_fallback & ~late
        listed.append(F.when(tried, F.struct(F.lit(s.name).alias("provider"), status(s).alias("status"), ok(s).alias("accepted"), F.round(s.elapsed_ms, 3).alias("latency_ms"))))
        reason = F.when(tried & ~ok(s), F.concat(F.lit(f"{s.name}_"), status(s))).otherwise(reason)
        valid = F.when(tried & s.answer.isNotNull(), s.answer).otherwise(valid)
        route = F.when(tried & ok(s), F.lit(s.name)).otherwise(route)
        spent = spent + F.when(tried, F.coalesce(s.elapsed_ms, F.lit(0.0))).otherwise(F.lit(0.0))
        done = done | (tried & ok(s))
    return F.struct(
        F.array_compact(F.array(*listed)).alias("list"), F.coalesce(route, F.lit("human")).alias("route"), valid.alias("answer"), (~done).alias("abstained"),
        F.when(done, reason).otherwise(F.coalesce(reason, F.lit("teachers_exhausted"))).alias("reason"), spent.alias("elapsed_ms"),
    )


def started(df: DataFrame, request: str, position: str, elapsed: str, out: str) -> DataFrame:
    """Time that a request's earlier questions took; a request has a bounded number of them."""
    before = Window.partitionBy(request).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(elapsed).over(before), F.lit(0.0)))


def questions_json(questions: Column) -> Column:
    """Canonical JSON of an array of (id, task, candidates)."""
    one = lambda q: F.when(
        F.coalesce(F.size(q["candidates"]), F.lit(0)) > 0,
        json_object(id=json_string(q["id"]), task=json_string(q["task"]), candidates=F.concat(F.lit("["), F.array_join(F.transform(q["candidates"], json_string), ", "), F.lit("]"))),
    ).otherwise(json_object(id=json_string(q["id"]), task=json_string(q["task"])))
    return F.concat(F.lit("["), F.array_join(F.transform(questions, one), ", "), F.lit("]"))


def cache_key(state: Column, questions: Column) -> Column:
    """The key of a request's answers: its state, white space aside, and its questions."""
    return result_cache_key(F.lit(MODEL), F.lit(CALIBRATION), state_cache_key(F.lit(MODEL), state), digest(questions_json(questions)))


def response(df: DataFrame, request: str, position: str) -> DataFrame:
    """One row per request of ``question_id, answer, route, abstained, elapsed_ms``: results, common or mixed route, latency, whether any needs review."""
    results = F.transform(F.array_sort(F.collect_list(F.struct(position, "question_id", "answer", "abstained"))), lambda x: F.struct(x["question_id"].alias("key"), F.struct(x["answer"].cast("string").alias("value"), x["abstained"].alias("abstained")).alias("value")))
    return df.groupBy(request).agg(
        F.map_from_entries(results).alias("results"), F.when(F.count_distinct("route") == 1, F.min("route")).otherwise("mixed").alias("route"), F.round(F.sum("elapsed_ms"), 3).alias("latency_ms"), F.bool_or(F.col("route") == "human").alias("review_required")
    )


def payload(results: Column, request_id: Column, route: Column, latency_ms: Column, traces: Column, with_evidence: Column) -> Column:
    """The response as JSON; traces only on demand."""
    return F.to_json(
        F.struct(
            F.lit(CALIBRATION).alias("calibration"), latency_ms.alias("latency_ms"), F.lit(MODEL).alias("model"), request_id.alias("request_id"), results.alias("results"), route.alias("route"), F.when(with_evidence, traces).alias("traces")
        )
    )


def cacheable(responses: DataFrame, key: str = "cache_key") -> DataFrame:
    """What may be answered from later: one response per key of those that no human has to look at."""
    kept = responses.filter("not review_required")
    return kept.groupBy(key).agg(F.min_by(F.struct(*(c for c in kept.columns if c != key)), F.col("request_id")).alias("_r")).select(key, "_r.*")


def answered(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests with the cached ``route`` and ``results`` where there are any, and ``hit``."""
    hits = cache.select(key, F.col("route").alias("cached_route"), F.col("results").alias("cached_results"))
    return requests.join(hits, key, "left").withColumn("hit", F.col("cached_route").isNotNull())
