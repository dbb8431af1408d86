"""Queries of jobs that write: resumable drafts and logs with one commit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.drafting import Drafts
from ..sources import adapters as A
from ..sources import committed
from ..sources.shared import shared_folder
from . import views as V


def _draft(rows):
    """A teacher whose every third answer is invalid, at the first attempt and at the second."""
    h = A.keyed(F.concat("sample_id", F.lit("/"), F.col("attempt").cast("string")), "draft", 3)
    return rows.select("sample_id", "attempt", (h != 0).alias("schema_valid"), F.concat("lang", F.lit(":"), h.cast("string")).alias("answer"))


def _resumed(s, d):
    """Drafts of all documents by a run that is stopped after two of its chunks, and one that goes on."""
    queue = A.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "lang")
    path = shared_folder(s, "drafts")
    Drafts(s, path, "teacher", "answer string").run(queue, _draft, chunks=4, stop_after=2)
    drafts = Drafts(s, path, "teacher", "answer string")
    drafts.run(queue, _draft, chunks=4)
    return drafts.drafts()


def _logged(s, d):
    """Events appended in two commits, each row held against the contract."""
    path = shared_folder(s, "log")
    events = A.table(s, d, "events").select("event_id", "event_type", "user_id")
    odd = F.array_compact(F.array(F.when(F.col("user_id").isNull(), F.lit("user_id"))))
    for k in (0, 1):
        committed.append_lines(events.where(F.col("event_id") % 2 == k), path, odd)
    return committed.read_lines(s, path, "event_id long, event_type string, user_id long")


QUERIES = {"resumed_drafts": _resumed, "committed_log": _logged}
_H = V.keyed("(doc_id::VARCHAR || '/{0}')", "draft", 3)
SQL = {
    "resumed_drafts": f"""WITH h AS (SELECT doc_id, lang, {_H.format(1)} AS a, {_H.format(2)} AS b FROM documents)
 SELECT doc_id::VARCHAR AS sample_id, CASE WHEN a <> 0 THEN 1 ELSE 2 END AS attempt, a <> 0 OR b <> 0 AS schema_valid, lang || ':' || CASE WHEN a <> 0 THEN a ELSE b END AS answer FROM h""",
    "committed_log": "SELECT event_id, event_type, user_id FROM events",
}
