"""Messages to teachers: a role and rules, and the question as canonical JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import json_object, json_string


@dataclass(frozen=True)
class Wording:
    """What the caller wants said: the rules with ``{role}`` in them, each provider's role, and guidance for some tasks."""

    rules: str
    roles: dict[str, str]
    guidance: dict[str, str] = field(default_factory=dict)


# What an answer of each kind has to hold.
FIELDS = {"boolean": ("type", "value", "probability", "abstained"), "choice": ("type", "selected", "probabilities", "abstained"), "score": ("type", "value", "interval_90", "abstained")}


def _named(key: Column, texts: dict[str, str]) -> Column:
    """The text of a key; null if there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in texts.items() for x in pair)), key) if texts else F.lit(None).cast("string")


def system_prompt(provider: Column, task_id: Column, wording: Wording) -> Column:
    """The rules with the provider's role in them, then the task's guidance; null for a provider without a role."""
    said = {name: wording.rules.replace("{role}", role) for name, role in wording.roles.items()}
    return F.concat(_named(provider, said), F.coalesce(_named(task_id, wording.guidance), F.lit("")))


def user_prompt(task_id: Column, version: Column, state: Column, question: Column, output_type: Column, candidates: Column) -> Column:
    """The question as JSON with its keys in order; candidates only where there are any."""
    names = lambda kind: F.lit("[" + ", ".join(f'"{f}"' for f in FIELDS[kind]) + "]")
    required = F.when(output_type == "boolean", names("boolean")).when(output_type == "choice", names("choice")).otherwise(names("score"))
    fields = {
        "output_schema": json_object(type=json_string(output_type), required=required), "question": json_string(question), "state": json_string(state), "task": json_string(F.concat(task_id, F.lit("@"), version.cast("string"))),
    }
    listed = F.concat(F.lit("["), F.array_join(F.transform(candidates, json_string), ", "), F.lit("]"))
    return F.when(F.coalesce(F.size(candidates), F.lit(0)) > 0, json_object(candidates=listed, **fields)).otherwise(json_object(**fields))


def messages(provider: Column, task_id: Column, version: Column, state: Column, question: Column, output_type: Column, candidates: Column, wording: Wording) -> Column:
    """Both messages as an array of (role, content)."""
    return F.array(
        F.struct(F.lit("system").alias("role"), system_prompt(provider, task_id, wording).alias("content")),
        F.struct(F.lit("user").alias("role"), user_prompt(task_id, version, state, question, output_type, candidates).alias("content")),
    )
