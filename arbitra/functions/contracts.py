"""Typed contracts on JSON text: strict types, tagged unions, repair.

JSON is read as VARIANT; a value's own type is tested before it is cast, so that
neither ``true`` nor ``"0.5"`` passes for a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

SUM_TOLERANCE = 0.02
REFERENCE = r"^([a-z][a-z0-9_.-]*)@([1-9][0-9]*)$"
QUESTION_ID = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"
MOST_QUESTIONS, LONGEST_STATE, LONGEST_DEADLINE = 128, 12_000, 300_000
ROUTES = ("rule", "student", "qwen", "gemma", "human", "mixed")


def task_reference(text: Column | str) -> Column:
    """``id`` and ``version`` of id@version; null if it isn't one."""
    c = col(text)
    return F.when(c.rlike(REFERENCE), F.struct(F.regexp_extract(c, REFERENCE, 1).alias("id"), F.regexp_extract(c, REFERENCE, 2).cast("int").alias("version")))


def json_type(v: Column, path: str) -> Column:
    """The value's own type: BOOLEAN, STRING, a number's, ARRAY<..>, OBJECT<..>, VOID, or null without one."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_number(kind: Column) -> Column:
    return F.coalesce(kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def number(v: Column, path: str) -> Column:
    return F.when(is_number(json_type(v, path)), F.try_variant_get(v, path, "double"))


def probability(v: Column, path: str) -> Column:
    """A number within 0 and 1, else null."""
    x = number(v, path)
    return F.when((x >= 0) & (x <= 1), x)


def strict(v: Column, path: str, kind: str) -> Column:
    """The value if it is of that very type."""
    return F.when(F.coalesce(json_type(v, path) == kind.upper(), F.lit(False)), F.try_variant_get(v, path, kind))


def parse_decision(text: Column | str) -> Column:
    """``type, value, selected, probability, probabilities, score, lower, upper, abstained, error``.

    ``error`` names the first thing wrong, null if the decision holds.
    """
    v = F.try_parse_json(col(text))
    tag = F.when(strict(v, "$.type", "string") == "noul", "boolean").otherwise(strict(v, "$.type", "string"))
    flag, p = strict(v, "$.value", "boolean"), probability(v, "$.probability")
    selected = strict(v, "$.selected", "string")
    # strings pass the cast to a map of numbers: types are tested per value
    raw = F.try_variant_get(v, "$.probabilities", "map<string,variant>")
    typed = F.transform_values(raw, lambda _, x: F.when(is_number(F.schema_of_variant(x)), F.try_variant_get(x, "$", "double")))
    total = F.aggregate(F.map_values(typed), F.lit(0.0), lambda a, x: a + x)
    bad = F.exists(F.map_values(typed), lambda x: x.isNull() | (x < 0) | (x > 1))
    score, low, high = number(v, "$.value"), number(v, "$.interval_90[0]"), number(v, "$.interval_90[1]")
    abstained = F.coalesce(strict(v, "$.abstained", "boolean"), F.lit(False))
    not_flag = F.coalesce(~json_type(v, "$.abstained").isin("BOOLEAN", "VOID"), F.lit(False))
    error = (
        F.when(v.isNull(), "not_json")
        .when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "not_object")
        .when(tag.isNull() | ~tag.isin("boolean", "choice", "score"), "type")
        .when(not_flag, "abstained")
        .when((tag == "boolean") & flag.isNull(), "value")
        .when((tag == "boolean") & p.isNull(), "probability")
        .when((tag == "choice") & (typed.isNull() | (F.size(typed) < 1)), "probabilities")
        .when((tag == "choice") & bad, "probabilities")
        .when((tag == "choice") & (selected.isNull() | ~F.map_contains_key(typed, F.coalesce(selected, F.lit("")))), "selected")
        .when((tag == "choice") & (F.abs(total - 1.0) > SUM_TOLERANCE), "sum")
        .when((tag == "score") & (score.isNull() | (score < 0) | (score > 1)), "value")
        .when((tag == "score") & (low.isNull() | high.isNull() | (low > score) | (high < score) | (low < 0) | (high > 1)), "interval_90")
    )
    return F.struct(
        tag.alias("type"), flag.alias("value"), selected.alias("selected"), F.when(tag == "boolean", p).when(tag == "choice", F.try_element_at(typed, selected)).alias("probability"), typed.alias("probabilities"),
        F.when(tag == "score", score).alias("score"), low.alias("lower"), high.alias("upper"), abstained.alias("abstained"), error.alias("error"),
    )


def fits_task(decision: Column, output_type: Column, candidates: Column) -> Column:
    """A decision of the task's type, and for a choice over exactly its candidates."""
    keys = F.map_keys(decision["probabilities"])
    same = (F.size(F.array_except(keys, candidates)) == 0) & (F.size(F.array_except(candidates, keys)) == 0)
    return decision["error"].isNull() & (decision["type"] == output_type) & F.when(output_type == "choice", same & F.array_contains(candidates, decision["selected"])).otherwise(F.lit(True))


def json_in(text: Column | str) -> Column:
    """What stands from the first { to the last } of a model's reply, if it parses."""
    found = F.regexp_extract(col(text), r"(?s)\{.*\}", 0)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def repair_probabilities(p: Column, candidates: Column) -> Column:
    """A rounded distribution made to sum to 1, the rest added to its greatest value; null if it can't be repaired."""
    total = F.aggregate(F.map_values(p), F.lit(0.0), lambda a, x: a + x)
    keys = F.map_keys(p)
    same = (F.size(F.array_except(keys, candidates)) == 0) & (F.size(F.array_except(candidates, keys)) == 0)
    scaled = F.transform_values(p, lambda _, x: F.round(x / total, 6))
    rest = 1.0 - F.aggregate(F.map_values(scaled), F.lit(0.0), lambda a, x: a + x)
    anchor = F.array_max(F.transform(F.map_entries(p), lambda e: F.struct(e["value"], e["key"])))["key"]
    out = F.transform_values(scaled, lambda k, x: F.when(k == anchor, F.round(x + rest, 6)).otherwise(x))
    fit = same & F.forall(F.map_values(p), lambda x: x >= 0) & total.between(0.90, 1.10) & (F.abs(total - 1.0) > SUM_TOLERANCE)
    # the rest may not take the anchor below nothing
    return F.when(fit & F.forall(F.map_values(out), lambda x: x >= 0), out)


def question_errors(id: Column, task: Column, candidates: Column) -> Column:
    """What is wrong with a question, as an array."""
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(id.rlike(QUESTION_ID), F.lit(False)), "id"), F.when(task_reference(task).isNull(), "task"),
            F.when(F.size(F.array_distinct(candidates)) != F.size(candidates), "candidates"),
        )
    )


def request_errors(state: Column, ids: Column, deadline: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim(state), F.lit("")) == "", "state"), F.when(F.length(state) > LONGEST_STATE, "state_length"), F.when(~F.size(ids).between(1, MOST_QUESTIONS), "questions"),
            F.when(F.size(F.array_distinct(ids)) != F.size(ids), "duplicate_question"), F.when(deadline.isNotNull() & ~deadline.between(1, LONGEST_DEADLINE), "deadline"),
        )
    )


def response_errors(route: Column, latency: Column, results: Column) -> Column:
    return F.array_compact(F.array(F.when(~F.coalesce(route.isin(*ROUTES), F.lit(False)), "route"), F.when(F.coalesce(latency, F.lit(-1.0)) < 0, "latency_ms"), F.when(F.coalesce(F.size(results), F.lit(0)) < 1, "results")))


def model_ids(payload: Column) -> Column:
    """Distinct ids of a model list, in order."""
    rows = F.try_variant_get(F.try_parse_json(payload), "$.data", "array<variant>")
    return F.array_distinct(F.filter(F.transform(rows, lambda x: F.try_variant_get(x, "$.id", "string")), lambda x: x != ""))


def message_content(choice: Column) -> Column:
    """A reply's text: content, its text parts joined, the first tool call's arguments, or the plain text, as it is."""
    v = F.try_parse_json(choice)
    parts = F.try_variant_get(v, "$.message.content", "array<variant>")
    joined = F.array_join(F.array_compact(F.transform(parts, lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), strict(x, "$.text", "string")))), "")
    some = lambda c: F.when(c.rlike(r"(?U)\S"), c)
    return F.coalesce(some(strict(v, "$.message.content", "string")), some(joined), some(strict(v, "$.message.tool_calls[0].function.arguments", "string")), some(strict(v, "$.text", "string")))
