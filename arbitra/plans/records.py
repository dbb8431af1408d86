"""Queries and SQL of record scans, the task catalog and training gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import json_string
from ..operators import records as R
from ..sources import adapters as A
from ..sources import jsonl
from ..sources.catalog import TASKS
from . import views as V

KEPT = ("ko", "en")


def _lines(df, line):
    """One line per row: file by the id's remainder, number by the id."""
    return df.select(F.concat(F.lit("part-"), (F.col("doc_id") % 4).cast("string")).alias("path"), F.col("doc_id").alias("line_no"), line.alias("line"))


def _object(*fields):
    """JSON of (condition under which it is left out, name, JSON of the value)."""
    parts = F.array_compact(F.array(*(F.when(~gone if gone is not None else F.lit(True), F.concat(F.lit(f'"{name}": '), value)) for gone, name, value in fields)))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def _samples(s, d):
    docs = A.table(s, d, "documents").select("doc_id", "lang", "source")
    k = F.col("doc_id") % 14
    when = lambda n, odd, usual: F.when(k == n, F.lit(odd)).otherwise(usual if not isinstance(usual, str) else F.lit(usual))
    id_ = F.when(k == 10, F.lit('"same"')).otherwise(F.concat(F.lit('"doc-'), F.col("doc_id").cast("string"), F.lit('"')))
    whole = _object(
        (None, "sample_id", id_), (None, "task_id", when(4, '"no.task"', '"memory.remember_worthy"')), (None, "task_version", when(5, "9", "1")), (None, "state", when(3, '""', json_string(F.col("source")))), (None, "question", F.lit('"keep it?"')),
        (k == 2, "target", F.lit("true")), (None, "language", F.when(k == 6, F.lit('"xx"')).otherwise(json_string(F.when(F.col("doc_id") % 3 > 0, "en").otherwise(F.col("lang"))))), (k == 2, "domain", F.lit('"d"')), (None, "source", when(7, "[]", "{}")),
        (None, "labels", when(8, "3", "{}")), (None, "provenance", when(9, '{"prompt_version": 1.5}', '{"prompt_version": 3}')),
    )
    return _lines(docs, F.when(k == 0, "not json {").when(k == 1, "[1]").when(k == 11, "  ").otherwise(whole))


def _canonical(s, d):
    return R.canonical(_samples(s, d), TASKS.frame(s)).select("at", F.when(F.size("errors") == 0, F.col("id")).alias("sample_id"), F.array_join("errors", ",").alias("errors"))


def _scenarios(s, d):
    docs = A.table(s, d, "documents").select("doc_id")
    k = F.col("doc_id") % 6
    id_ = F.when(k == 0, F.lit('""')).when(k == 1, F.lit('"again"')).otherwise(F.concat(F.lit('"s'), F.col("doc_id").cast("string"), F.lit('"')))
    return _lines(docs, F.when(k == 2, '"text"').otherwise(_object((None, "scenario_id", id_), (None, "sample_id", id_), (k == 3, "state", F.when(k == 4, '" "').otherwise('"s"')))))


def _found(rows):
    return rows.select("at", F.array_join("errors", ",").alias("errors"))


def _training_lines(s, d):
    """Records of the four tasks' kinds, some of them wrong in one way."""
    docs = A.table(s, d, "documents").select("doc_id")
    k, kind = F.col("doc_id") % 11, F.floor(F.col("doc_id") / 11) % 3
    by = lambda b, c, x: F.when(kind == 0, F.lit(b)).when(kind == 1, F.lit(c)).otherwise(F.lit(x))
    skills = ", ".join(f'"{x}": {1.0 if x == "MOVE" else 0.0}' for x in TASKS.get("control.skill", 1).candidates)
    low = ", ".join(f'"{x}": {0.5 if x == "MOVE" else 0.0}' for x in TASKS.get("control.skill", 1).candidates)
    target = F.when(k == 0, by('"true"', '"JUMP"', "false")).otherwise(by("true", '"MOVE"', "0.5"))
    soft = F.when(k == 1, by("true", f"{{{low}}}", '"x"')).when(k == 2, by("1.5", '{"MOVE": 1.0}', "[]")).when(k == 3, F.lit("null")).otherwise(by("0.75", f"{{{skills}}}", '"0.25"'))
    human = F.when(k == 4, F.lit('"yes"')).when(k == 5, by('{"type": "score", "value": 0.5, "interval_90": [0.4, 0.6]}', '{"type": "boolean", "value": true, "probability": 1}', '{"type": "boolean", "value": true, "probability": 1}')).otherwise(
        by('{"type": "boolean", "value": true, "probability": 1.0}', f'{{"type": "choice", "selected": "MOVE", "probabilities": {{{skills}}}}}', '{"type": "score", "value": 0.5, "interval_90": [0.4, 0.6]}')
    )
    split = F.element_at(F.array(*map(F.lit, ("train", "train", "validation", "test"))), (F.col("doc_id") % 4 + 1).cast("int"))
    provenance = _object(
        (None, "split", F.when(k == 6, F.lit('"all"')).otherwise(F.concat(F.lit('"'), split, F.lit('"')))), (k != 7, "privacy_raw_inputs_stored", F.lit("true")), (k == 8, "target_source", F.lit('"human_review"')),
    )
    whole = _object(
        (None, "sample_id", F.concat(F.lit('"doc-'), F.col("doc_id").cast("string"), F.lit('"'))), (None, "task_id", F.when(k == 9, F.lit('"no.task"')).otherwise(by('"memory.remember_worthy"', '"control.skill"', '"memory.importance"'))), (None, "task_version", F.lit("1")),
        (None, "target", target), (k == 10, "soft_target", soft), (None, "labels", F.concat(F.lit('{"human": '), human, F.lit("}"))), (None, "provenance", provenance),
    )
    return _lines(docs, whole)


#: Of each log's records by number, which are manifests, and which isn't an object.
_LOGS = {"proper": ((0,), None), "late": ((1,), None), "twice": ((0, 3), None), "none": ((), None), "odd": ((0,), 2), "empty": None}


def _runs(s, d):
    """Events as the records of some logs: with a manifest first, later, twice, or none, or one that is no object, and a log without any."""
    out, n, events = None, F.floor(F.col("event_id") / len(_LOGS)), A.table(s, d, "events").select("event_id")
    for k, (name, told) in enumerate(_LOGS.items()):
        first, odd = told or ((), None)
        line = F.when(n.isin(*first) if first else F.lit(False), '{"record_type": "manifest"}').when(n == (-1 if odd is None else odd), "[1]").otherwise(F.concat(F.lit('{"record_type": "x", "n": '), n.cast("string"), F.lit("}")))
        rows = events.where((F.col("event_id") % len(_LOGS) == k) & F.lit(told is not None)).select(F.lit(name).alias("path"), n.alias("line_no"), F.try_parse_json(line).alias("value"))
        manifest, records, error = jsonl.split_run(rows)
        n_rows = manifest.agg(F.count("*").alias("manifests")).crossJoin(records.agg(F.count("*").alias("records"))).crossJoin(error).select(F.lit(name).alias("log"), "manifests", "records", "error")
        out = n_rows if out is None else out.unionByName(n_rows)
    return out


def _plan(s, d):
    rows = R.training(_training_lines(s, d), TASKS.frame(s))
    plan = R.training_plan(rows, F.sha2(F.bit_xor(F.xxhash64("id")).cast("string"), 256), {"model_id": "m1", "backbone": "words"}, {"epochs": 3, "precision": "fp32"})
    return plan.select("record_type", "status", "sample_count", F.to_json("split_counts").alias("splits"), F.to_json("task_counts").alias("tasks"), F.to_json("student").alias("student"), F.to_json("training").alias("training"), (F.length("sha256") == 64).alias("bound"))


def _catalog(s, d):
    """Requests for tasks, joined to their definition: drafts' languages and thresholds by task."""
    asked = A.table(s, d, "events").select(
        "event_id", F.element_at(F.array(*map(F.lit, ("memory.remember_worthy", "memory.importance", "wiki.semantic_change", "control.skill", "no.task"))), (F.col("event_id") % 5 + 1).cast("int")).alias("task_id"),
        F.when(F.col("event_id") % 7 == 0, 2).otherwise(1).alias("version"), F.element_at(F.array(*map(F.lit, ("ko", "en", "de"))), (F.col("event_id") % 3 + 1).cast("int")).alias("language"),
    )
    return asked.join(F.broadcast(TASKS.frame(s)), ["task_id", "version"], "left").select(
        "event_id", F.col("output_type").isNotNull().alias("known"), F.coalesce(F.array_contains("languages", F.col("language")), F.lit(False)).alias("language_ok"), "output_type", "auto_true", "minimum_probability", F.coalesce(F.size("candidates"), F.lit(0)).alias("candidates"),
    )


def _calibrated(s, d):
    """A manifest for each label: good ones, and those of another checkpoint, of another kind, and broken ones."""
    i = F.col("doc_id")
    checkpoint, kind = F.when(i % 4 == 1, "xyz").otherwise("abc"), F.when(i % 4 == 2, "report").otherwise("calibration_manifest")
    told = F.format_string('{"record_type": "%s", "checkpoint_sha256": "%s", "tasks": {"t%d": {"status": "fitted", "temperature": %.2f}, "u%d": {"status": "insufficient"}}}', kind, checkpoint, i, (i % 100 + 1) / 4, i)
    lines = A.table(s, d, "labels").select((i % 4).cast("string").alias("path"), i.alias("line_no"), F.when(i % 4 == 3, "{").otherwise(told).alias("line"))
    return R.calibrations(lines, "abc")


QUERIES = {
    "canonical_scan": _canonical,
    "scenario_scan": lambda s, d: _found(R.scenarios(_scenarios(s, d))),
    "queue_scan": lambda s, d: _found(R.queue(_scenarios(s, d))),
    "seed_scan": lambda s, d: _found(R.seeds(_scenarios(s, d))),
    "draft_scan": lambda s, d: _found(R.drafts(_scenarios(s, d))),
    "empty_files": lambda s, d: R.empty_files(_samples(s, d).withColumn("path", F.concat("path", F.lit("/"), (F.col("line_no") % 14).cast("string")))),
    "run_scan": _runs,
    "training_scan": lambda s, d: R.training(_training_lines(s, d), TASKS.frame(s)).select("at", "task_id", F.array_join("errors", ",").alias("errors")),
    "training_scan_human": lambda s, d: R.training(_training_lines(s, d), TASKS.frame(s), human=True).select("at", F.array_join("errors", ",").alias("errors")),
    "training_counts": lambda s, d: R.training_counts(R.training(_training_lines(s, d), TASKS.frame(s))),
    "training_plan": _plan,
    "task_catalog": _catalog,
    "calibration_scan": _calibrated,
    "split_filter": lambda s, d: R.of_split(A.table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "validation").otherwise("test").alias("split")), "validation"),
    "first_rows": lambda s, d: R.first_rows(A.table(s, d, "events").select("event_id", "event_type"), "event_id", 25),
}

W = "WITH "
_AT = "'part-' || doc_id % 4 || ':' || doc_id"
CANONICAL = f"""c AS (SELECT doc_id, {_AT} AS "at", doc_id % 14 AS k, CASE WHEN doc_id % 14 = 6 THEN 'xx' WHEN doc_id % 3 > 0 THEN 'en' ELSE lang END AS language, coalesce(source, '') AS state FROM documents WHERE doc_id % 14 <> 11),
 e AS (SELECT *, array_to_string(list_filter([CASE k WHEN 0 THEN 'json' WHEN 1 THEN 'object' WHEN 2 THEN 'missing:target' END, CASE k WHEN 2 THEN 'missing:domain' END, CASE k WHEN 3 THEN 'empty:state' END, CASE WHEN k IN (4, 5) THEN 'task' END,
  CASE WHEN k NOT IN (0, 1, 4, 5) AND language NOT IN ('ko', 'en') THEN 'language' END, CASE k WHEN 7 THEN 'source' WHEN 8 THEN 'labels' WHEN 9 THEN 'prompt_version' END], lambda x: x IS NOT NULL), ',') AS er FROM c),
 f AS (SELECT *, CASE WHEN k = 10 AND er = '' AND row_number() OVER (PARTITION BY k = 10 AND er = '' ORDER BY doc_id % 4, doc_id) > 1 THEN 'duplicate' ELSE er END AS errors FROM e)"""
_SCAN = lambda id_error, distinct, state: f"""WITH c AS (SELECT doc_id, {_AT} AS "at", doc_id % 6 AS k FROM documents), e AS (SELECT *, CASE WHEN k = 2 THEN 'object' WHEN k = 0 AND {bool(id_error)} THEN '{id_error}' WHEN {state} AND k IN (3, 4) THEN 'state'
  WHEN {distinct} AND k = 1 AND row_number() OVER (PARTITION BY k ORDER BY doc_id % 4, doc_id) > 1 THEN 'duplicate' ELSE '' END AS errors FROM c) SELECT "at", errors FROM e"""  # noqa: E731
TRAINING = f"""t AS (SELECT doc_id, {_AT} AS "at", doc_id % 11 AS k, doc_id // 11 % 3 AS kind, ['train', 'train', 'validation', 'test'][doc_id % 4 + 1] AS split FROM documents),
 u AS (SELECT *, CASE WHEN k = 9 THEN 'no.task' ELSE ['memory.remember_worthy', 'control.skill', 'memory.importance'][kind + 1] END AS task_id, CASE WHEN k = 0 THEN 'target' WHEN k IN (1, 2) THEN 'soft_target' WHEN k = 6 THEN 'split' WHEN k = 7 THEN 'raw_inputs' WHEN k = 9 THEN 'task' ELSE '' END AS errors,
  CASE WHEN k = 4 THEN 'human' WHEN kind = 1 AND k = 8 THEN 'target_source' WHEN k = 5 THEN 'human_label' ELSE '' END AS human FROM t)"""
SQL = {
    "canonical_scan": W + CANONICAL + """ SELECT "at", CASE WHEN errors = '' THEN CASE WHEN k = 10 THEN 'same' ELSE 'doc-' || doc_id END END AS sample_id, errors FROM f""",
    "scenario_scan": _SCAN("scenario_id", True, False),
    "queue_scan": _SCAN("", False, True),
    "seed_scan": _SCAN("sample_id", False, False),
    "draft_scan": _SCAN("sample_id", True, False),
    "empty_files": "SELECT DISTINCT 'part-' || doc_id % 4 || '/11' AS path FROM documents WHERE doc_id % 14 = 11",
    "run_scan": """WITH e AS (SELECT event_id // 6 AS n, ['proper', 'late', 'twice', 'none', 'odd', 'empty'][event_id % 6 + 1] AS log FROM events WHERE event_id % 6 < 5), m AS (SELECT log, n = 1 AND log = 'late' OR n = 0 AND log IN ('proper', 'twice', 'odd') OR n = 3 AND log = 'twice' AS m FROM e)
 SELECT log, count(*) FILTER (m) AS manifests, count(*) FILTER (NOT m) AS records, CASE log WHEN 'odd' THEN 'records must be objects' WHEN 'late' THEN 'first record must be a manifest' WHEN 'none' THEN 'first record must be a manifest' WHEN 'twice' THEN 'exactly one manifest is needed' END AS error FROM m GROUP BY log UNION ALL SELECT 'empty', 0, 0, 'run is empty'""",
    "training_scan": W + TRAINING + ' SELECT "at", task_id, errors FROM u',
    "training_scan_human": W + TRAINING + """ SELECT "at", CASE WHEN errors IN ('target', 'soft_target') THEN concat_ws(',', nullif(human, ''), errors) ELSE concat_ws(',', nullif(errors, ''), nullif(human, '')) END AS errors FROM u""",
    "training_counts": W + TRAINING + " SELECT 'split' AS kind, split AS name, count(*) AS n FROM u WHERE errors = '' GROUP BY 2 UNION ALL SELECT 'task', task_id, count(*) FROM u WHERE errors = '' GROUP BY 2 UNION ALL SELECT 'error', errors, count(*) FROM u WHERE errors <> '' GROUP BY 2",
    "training_plan": W + TRAINING + """, s AS (SELECT split AS name, count(*) AS n FROM u WHERE errors = '' GROUP BY 1), k AS (SELECT task_id AS name, count(*) AS n FROM u WHERE errors = '' GROUP BY 1)
 SELECT 'training_plan' AS record_type, 'planned' AS status, (SELECT sum(n)::BIGINT FROM s) AS sample_count, (SELECT '{' || string_agg('"' || name || '":' || n, ',' ORDER BY name) || '}' FROM s) AS splits, (SELECT '{' || string_agg('"' || name || '":' || n, ',' ORDER BY name) || '}' FROM k) AS tasks,
 '{"backbone":"words","model_id":"m1"}' AS student, '{"epochs":"3","precision":"fp32"}' AS training, true AS bound""",
    "task_catalog": """WITH t AS (SELECT * FROM (VALUES ('memory.remember_worthy', 'boolean', .92::DOUBLE, 0), ('memory.importance', 'score', .92, 0), ('wiki.semantic_change', 'boolean', .9, 0), ('control.skill', 'choice', .92, 8)) v(task_id, output_type, auto_true, n)),
 a AS (SELECT event_id, ['memory.remember_worthy', 'memory.importance', 'wiki.semantic_change', 'control.skill', 'no.task'][event_id % 5 + 1] AS task_id, ['ko', 'en', 'de'][event_id % 3 + 1] AS language FROM events)
 SELECT event_id, output_type IS NOT NULL AS known, output_type IS NOT NULL AND language <> 'de' AS language_ok, output_type, auto_true, CASE WHEN output_type IS NOT NULL THEN .9::DOUBLE END AS minimum_probability, coalesce(n, 0)::INT AS candidates FROM a LEFT JOIN t ON t.task_id = a.task_id AND event_id % 7 <> 0""",
    "calibration_scan": """SELECT DISTINCT CASE WHEN doc_id % 4 = 0 THEN 't' || doc_id END AS task_id, CASE WHEN doc_id % 4 = 0 THEN ((doc_id % 100 + 1) / 4.0)::DOUBLE END AS temperature, [NULL, 'checkpoint_sha256', 'record_type', 'json'][doc_id % 4 + 1] AS error FROM labels""",
    "split_filter": "SELECT doc_id, 'validation' AS split FROM documents WHERE doc_id % 10 = 8",
    "first_rows": "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 25",
}
