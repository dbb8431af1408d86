"""The catalog of tasks: versioned output types with candidates and thresholds."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "task_id string, version int, output_type string, candidates array<string>, auto_true double, auto_false double, minimum_probability double, otherwise string, languages array<string>, max_chars int, status string"
)


#: Fixed value: how tasks are named.
_ID = re.compile(r"[a-z][a-z0-9_.-]+\Z")


@dataclass(frozen=True)
class Task:
    task_id: str
    version: int = 1
    output_type: str = "boolean"
    candidates: tuple[str, ...] = ()
    auto_true: float = 0.92
    auto_false: float = 0.08
    minimum_probability: float = 0.9
    otherwise: str | None = None
    languages: tuple[str, ...] = ("ko", "en")
    max_chars: int = 12_000
    status: str = "active"
    prompt_version: int = 1

    def errors(self) -> list[str]:
        """What the definition lacks."""
        out = [] if _ID.match(self.task_id) else ["id"]
        out += [] if self.output_type in ("boolean", "choice", "score") else ["output_type"]
        if self.output_type == "choice" and (len(set(self.candidates)) < max(2, len(self.candidates))):
            out.append("candidates")
        out += [name for name in ("version", "max_chars", "prompt_version") if getattr(self, name) < 1]
        return out if self.languages else [*out, "languages"]


@dataclass
class Catalog:
    """At most one active version of an id."""

    tasks: list[Task] = field(default_factory=list)

    def __post_init__(self) -> None:
        active = [t.task_id for t in self.tasks if t.status == "active"]
        if repeated := {x for x in active if active.count(x) > 1}:
            raise ValueError(f"several active versions: {sorted(repeated)}")
        if wrong := {t.task_id: e for t in self.tasks if (e := t.errors())}:
            raise ValueError(f"invalid tasks: {wrong}")

    def get(self, task_id: str, version: int) -> Task:
        for t in self.tasks:
            if (t.task_id, t.version) == (task_id, version):
                return t
        raise KeyError(f"{task_id}@{version}")

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.task_id, t.version, t.output_type, list(t.candidates), t.auto_true, t.auto_false, t.minimum_probability, t.otherwise, list(t.languages), t.max_chars, t.status) for t in sorted(self.tasks, key=lambda t: (t.task_id, t.version))]
        return spark.createDataFrame(rows, SCHEMA)


def load(folder: str) -> Catalog:
    """A catalog of YAML files, one task each, in order of their names.

    A folder without files, a file that isn't a mapping, an id that two files have, and
    a definition with errors are refused.
    """
    import pathlib

    import yaml

    tasks: list[Task] = []
    files = sorted(p for p in pathlib.Path(folder).iterdir() if p.suffix in (".yaml", ".yml"))
    if not files:
        raise ValueError(f"no tasks in {folder}")
    for p in files:
        d = yaml.safe_load(p.read_text(encoding="utf-8"))
        if not isinstance(d, dict) or "id" not in d:
            raise ValueError(f"{p.name} doesn't define a task")
        if any(t.task_id == d["id"] for t in tasks):
            raise ValueError(f"several active versions or files of {d['id']}")
        out, limits = d.get("output", {}), d.get("thresholds", {})
        tasks.append(
            Task(
                d["id"], int(d.get("version", 0)), out.get("type", "boolean"), tuple(map(str, out.get("candidates", ()))), float(limits.get("auto_true", 0.92)), float(limits.get("auto_false", 0.08)), float(limits.get("minimum_probability", 0.9)),
                limits.get("otherwise"), tuple(d.get("languages", ("ko", "en"))), int(d.get("input", {}).get("max_chars", 12_000)), d.get("status", "active"), int(d.get("teacher_prompt_version", 1)),
            )
        )
    return Catalog(tasks)


# Ids, types and thresholds of the decision tasks.
TASKS = Catalog([
    Task("memory.remember_worthy"),
    Task("memory.importance", output_type="score"),
    Task("wiki.semantic_change", auto_true=0.90, auto_false=0.10),
    Task("control.skill", output_type="choice", candidates=("STOP", "HOLD", "MOVE", "ROTATE", "APPROACH", "RETREAT", "INTERACT", "RECOVER"), otherwise="safe_stop", max_chars=4096),
])
