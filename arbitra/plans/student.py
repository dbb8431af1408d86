"""Queries of typed heads: trained on labelled documents, calibrated, and applied to all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from ..operators import student as S
from ..sources import adapters as A
from ..sources.shared import shared_folder, written

LANGUAGES = ("de", "en", "es", "fr")
HEADS = [S.Head("text.quality", 1, "boolean"), S.Head("text.toxic", 1, "boolean"), S.Head("text.language", 1, "choice", LANGUAGES), S.Head("text.length", 1, "score")]
CONFIG = S.Config(vocabulary=2048, hidden=16, steps=25, rate=0.05)


def _counted(s, d):
    """The documents, with their whole texts counted once for training and all answers."""
    return written(S.counted(A.table(s, d, "documents").select("doc_id", "lang", "n_chars", "text"), CONFIG.vocabulary), "student-words")


def _asked(s, d, counted):
    """Each document with each task, and its target where a label has one; every fifth label is held out."""
    asked = lambda task, target: F.struct(F.lit(task).alias("task_id"), target.alias("target"))
    docs = counted.join(A.table(s, d, "labels"), "doc_id", "left").select(
        "doc_id", "words", F.coalesce(A.keyed("doc_id", "held", 5) == 0, F.lit(False)).alias("held_out"),
        F.array(
            asked("text.quality", (F.col("quality") == 1).cast("string")), asked("text.toxic", (F.col("toxic") == 1).cast("string")),
            asked("text.language", F.when(F.col("lang").isin(*LANGUAGES), F.col("lang"))), asked("text.length", F.least(F.lit(1.0), F.col("n_chars") / 10_000).cast("string")),
        ).alias("tasks"),
    )
    return docs.select("doc_id", "words", "held_out", F.inline("tasks"))


def _fitted(asked):
    return S.train(S.class_weights(asked.where("target is not null and not held_out"), scores=("text.length",)), HEADS, CONFIG)[0]


def _answers(s, d):
    """Answers of every document by the saved and loaded model, with temperatures fitted on held-out labels."""
    path, asked = shared_folder(s, "student"), _asked(s, d, _counted(s, d))
    S.save(s, _fitted(asked), path)
    model = S.load(s, path, HEADS)
    classes = F.when(F.col("task_id") == "text.language", F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("target")).cast("int") - 1).otherwise((F.col("target") == "true").cast("int"))
    held = asked.where("held_out and target is not null and task_id <> 'text.length'").select(classes.alias("label"), "task_id", "words")
    # a row for each task
    fitted = {r["task_id"]: r["temperature"] for r in gates.fit_temperature(S.predict(held, model, key="label"), ["task_id"]).where("status = 'fitted'").collect()}
    out = S.predict(asked, model, fitted, 0.6, key="doc_id")
    shown = F.coalesce(F.col("value").cast("string"), "selected", F.format_string("%.3f", "score"))
    return out.select("doc_id", "task_id", shown.alias("answer"), F.round("confidence", 6).alias("confidence"), "abstained")


def _accuracy(s, d):
    """How often held-out labels are met, by task."""
    asked = _asked(s, d, _counted(s, d))
    out = S.predict(asked.where("held_out and target is not null"), _fitted(asked), key="target")
    right = F.coalesce(F.col("value").cast("string"), "selected") == F.col("target")
    return out.groupBy("task_id").agg(F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"), F.round(F.avg(F.abs(F.col("score") - F.col("target").cast("double"))), 6).alias("error"))


QUERIES = {"student_answers": _answers, "student_accuracy": _accuracy}
SQL: dict[str, str] = {}
