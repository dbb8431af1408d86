"""Queries and SQL of control decisions, gates, calibration and lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contracts as C
from ..functions import stats
from ..functions import text as T
from ..operators import control as K
from ..operators import dataset as D
from ..operators import gates
from ..operators.control import BLOCKERS, PHRASES, SKILLS, STOP_SIGNALS
from ..sources import adapters as A
from . import views as V
from .workflow import _any

PREFIX = "the corridor is clear for forward motion. "


def _states(s, d):
    """Conversation texts, some with a control phrase in front."""
    cases = [" while ".join(p[0]) for p in PHRASES.values()] + ["obstacle is directly ahead", "the path is blocked but clear path", "plain talk"]
    pick = F.element_at(F.array(*map(F.lit, cases)), (F.col("k") % len(cases) + 1).cast("int"))
    rows = A.table(s, d, "conversations").select("conv_id", "turn", "text", A.keyed(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "state", 1000).alias("k"))
    return rows.select("conv_id", "turn", F.concat(pick, F.lit("; "), F.col("text")).alias("state"))


def _replay(s, d):
    """Safety and near-miss matrices through the decision chain, with a model that says HOLD."""
    a = K.safety_matrix(s, A.event_numbers(s, d)).select("scenario_id", F.lit("plain state").alias("state"), "timestamp_ms", "now_ms", "emergency_stop", F.lit("STOP").alias("expected_skill"), F.lit(True).alias("expected_stop"))
    b = K.near_miss_matrix(s, A.event_numbers(s, d)).select("scenario_id", "state", "timestamp_ms", "now_ms", F.lit(False).alias("emergency_stop"), "expected_skill", F.lit(False).alias("expected_stop"))
    rows = a.unionByName(b)
    act = K.decide(F.col("state"), F.col("now_ms"), F.col("timestamp_ms"), F.col("emergency_stop"), F.lit("HOLD"), F.lit(0.95), F.lit(False))
    return rows.withColumn("act", act).select("scenario_id", "expected_skill", "expected_stop", "act.*").withColumn("stopped", F.col("skill") == "STOP").withColumn("correct", F.col("skill") == F.col("expected_skill"))


def _logits(s, d):
    """Ten logits per vector: its values at every sixth place."""
    e = A.table(s, d, "embeddings").filter("embedding is not null and label is not null")
    return e.select("vec_id", F.pmod("label", F.lit(10)).cast("int").alias("label"), (F.col("vec_id") % 3).alias("task"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.col("embedding")[i * 6].cast("double")).alias("logits"))


def _gate_values(s, d):
    labelled = A.binary_predictions(s, d)
    acc = gates.accuracy_with_bounds(labelled, ["provider"])
    return acc.select(F.inline(F.array(F.struct(F.lit("split_accuracy").alias("gate"), F.col("provider").alias("subject"), F.col("accuracy").alias("value")), F.struct(F.lit("split_accuracy_lower").alias("gate"), F.col("provider").alias("subject"), F.col("lower").alias("value")), F.struct(F.lit("unique_groups").alias("gate"), F.col("provider").alias("subject"), F.col("n").cast("double").alias("value")), F.struct(F.lit("false_stop_rate").alias("gate"), F.col("provider").alias("subject"), F.lit(None).cast("double").alias("value")))))


def _lifecycle(s, d):
    names = F.array(*map(F.lit, ["trained", "evaluated", "calibrated", "candidate", "canary", "active", "retired"]))
    u = A.table(s, d, "events").select(F.col("user_id").alias("model_id")).distinct()
    pick = lambda salt: F.element_at(names, (A.keyed("model_id", salt, 7) + 1).cast("int"))
    return gates.transitions(u.withColumn("status", pick("status")), u.withColumn("to_status", pick("to")))


def _decisions(s, d):
    """JSON replies made from drafts, some broken on purpose."""
    x = A.drafts(s, d)
    p = F.format_string("%.4f", F.col("p"))
    good = F.concat(F.lit('{"type": "'), F.when(F.col("h") % 5 == 0, "noul").otherwise("boolean"), F.lit('", "value": '), F.col("value").cast("string"), F.lit(', "probability": '), p, F.lit("}"))
    reply = F.when(F.col("h") % 7 == 0, F.lit('{"type": "boolean", "value": "true", "probability": 0.5}')).when(F.col("h") % 11 == 0, F.lit('{"type": "boolean", "value": true, "probability": true}')).when(F.col("h") % 13 == 0, F.lit("no json")).otherwise(good)
    return x.select("doc_id", "provider", reply.alias("reply"))


def _teacher_reviews(s, d):
    """Documents of which a teacher's reply fails, for review, with both calls' metadata."""
    drafts = A.drafts(s, d).select("doc_id", "provider", "latency_ms")
    calls = _decisions(s, d).withColumn("r", C.parse_decision("reply")).join(drafts, ["doc_id", "provider"])
    meta = D.teacher_metadata(F.col("provider"), F.concat(F.lit("model-"), "provider"), F.col("reply"), F.col("r.error"), F.col("latency_ms"))
    side = lambda p: calls.where(F.col("provider") == p).select("doc_id", meta.alias(p))
    both = side("a").join(side("b"), "doc_id").where("not a.schema_valid or not b.schema_valid").join(A.table(s, d, "documents").select("doc_id", "text"), "doc_id")
    record = D.review_record(F.col("doc_id").cast("string"), F.lit("memory.remember_worthy"), F.lit(1), F.coalesce("text", F.lit("")), F.lit("q"), F.lit("schema_invalid"), F.col("a"), F.col("b"))
    x = both.select("doc_id", record.alias("x"))
    flat = lambda p: [F.col(f"x.teacher_metadata.{p}.{c}").alias(f"{p}_{c}") for c in ("status", "model", "response_sha256", "latency_ms", "error")]
    return x.select("doc_id", "x.task", "x.state_sha256", "x.reason", "x.reviewed", *flat("qwen"), *flat("gemma"))


def _repair(s, d):
    e = A.table(s, d, "events").select("event_id", (A.keyed("event_id", "u", 400) / 1000.0).alias("u"), (A.keyed("event_id", "v", 400) / 1000.0).alias("v"))
    p = F.create_map(F.lit("x"), F.col("u"), F.lit("y"), F.col("v"), F.lit("z"), F.lit(0.3))
    r = C.repair_probabilities(p, F.array(F.lit("x"), F.lit("y"), F.lit("z")))
    return e.withColumn("r", r).filter("r is not null").select("event_id", *(F.element_at("r", F.lit(k)).alias(k) for k in "xyz"))


QUERIES = {
    "teacher_reviews": _teacher_reviews,
    "explicit_stop": lambda s, d: _states(s, d).select("conv_id", "turn", K.explicit_stop(F.col("state")).alias("stop")),
    "phrase_skill": lambda s, d: _states(s, d).select("conv_id", "turn", K.phrase_skill(F.col("state")).alias("skill")),
    "safety_policy": lambda s, d: A.observations(s, d).select("observation_id", F.coalesce(K.safety_policy(*map(F.col, ("now_ms", "timestamp_ms", "emergency_stop", "abstained", "confidence", "ttl_ms"))), F.lit("run")).alias("reason")),
    "staleness_gate": lambda s, d: A.observations(s, d).select("observation_id", K.staleness(F.col("now_ms"), F.col("timestamp_ms")).alias("reason")),
    "control_queue": lambda s, d: K.review_queue(s, ids=A.event_numbers(s, d)),
    "control_queue_counts": lambda s, d: K.review_queue(s, ids=A.event_numbers(s, d)).groupBy("target", "language", "split").agg(F.count("*").alias("n")),
    "hard_negative_queue": lambda s, d: K.hard_negative_queue(s, A.event_numbers(s, d)).select("sample_id", "counterfactual_group_id", F.col("pair_side").cast("bigint").alias("pair_side"), "target", "language", "split"),
    "safety_matrix": lambda s, d: K.safety_matrix(s, A.event_numbers(s, d)),
    "near_miss_matrix": lambda s, d: K.near_miss_matrix(s, A.event_numbers(s, d)).select("scenario_id", "expected_skill", "timestamp_ms", "now_ms"),
    "simulation_report": lambda s, d: _replay(s, d).groupBy("expected_skill", "source").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct")),
    "safety_report": lambda s, d: K.safety_report(_replay(s, d)),
    "quality_gate_rows": lambda s, d: gates.gate_rows(_gate_values(s, d)),
    "temperature_fit": lambda s, d: gates.fit_temperature(_logits(s, d), []),
    "task_temperatures": lambda s, d: gates.fit_temperature(_logits(s, d), ["task"], minimum_samples=10),
    "softmax_calibrated": lambda s, d: _logits(s, d).select("vec_id", F.round(F.array_max(stats.softmax(F.col("logits"), 0.5)), 6).alias("confidence"), F.round(stats.nll(F.col("logits"), F.col("label"), F.lit(0.5)), 6).alias("nll")),
    "lifecycle_transitions": _lifecycle,
    "typed_contract_parse": lambda s, d: _decisions(s, d).select("doc_id", "provider", C.parse_decision("reply").alias("r")).select("doc_id", "provider", F.col("r.type").alias("kind"), F.col("r.error").alias("error"), F.round("r.probability", 6).alias("probability")),
    "json_extraction": lambda s, d: _decisions(s, d).select("doc_id", "provider", C.json_in(F.concat(F.lit("```json\n"), F.col("reply"), F.lit("\n```"))).isNotNull().alias("found")),
    "choice_repair": _repair,
    "task_references": lambda s, d: A.table(s, d, "events").select("event_id", C.task_reference(F.concat(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, "").otherwise("@"), (F.col("event_id") % 5).cast("string")))["version"].alias("version")),
    "request_errors": lambda s, d: A.table(s, d, "documents").select("doc_id", F.array_join(C.request_errors(F.col("text"), F.array(F.lit("q"), F.concat(F.lit("q"), F.when(F.col("doc_id") % 4 == 0, "").otherwise("2"))), (F.col("doc_id") % 3).cast("int")), ",").alias("errors")),
}

W = "WITH "
CASES = [" while ".join(p[0]) for p in PHRASES.values()] + ["obstacle is directly ahead", "the path is blocked but clear path", "plain talk"]
_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
STATES = f"""st AS (SELECT conv_id, turn, {_list(CASES)}[{V.H.format("conv_id || '-' || turn || ':state'")} % 1000 % {len(CASES)} + 1] || '; ' || text AS state FROM conversations),
 sn AS (SELECT *, trim(regexp_replace(replace(replace(lower(state), 'ß', 'ss'), 'ς', 'σ'), '\\s+', ' ', 'g')) AS t FROM st)"""


def _skill(skill: str) -> str:
    hit = " OR ".join("(" + " AND ".join(f"contains(t, '{x.replace(chr(39), chr(39) * 2)}')" for x in p) + ")" for p in PHRASES[skill])
    return f"CASE WHEN ({hit}) AND NOT {_any('t', BLOCKERS[skill])} THEN '{skill}' END"


_variant = lambda e: f"CASE WHEN {e} < 8 THEN 'train' WHEN {e} = 8 THEN 'validation' ELSE 'test' END"
_QUEUE_STATES = {s: [" while ".join(p) for p in PHRASES.get(s, [STOP_SIGNALS[:1]])] for s in SKILLS}
_CONFUSED = (("MOVE", "STOP"), ("HOLD", "MOVE"), ("ROTATE", "MOVE"), ("APPROACH", "RETREAT"), ("INTERACT", "APPROACH"), ("RECOVER", "HOLD"))
QUEUE = f"""q AS (SELECT i, (i // 100) % 8 AS k, i % 100 AS v FROM (SELECT event_id FROM events) r(i)), cq AS (SELECT printf('control-review-%05d', i + 1) AS sample_id, {_list(SKILLS)}[k + 1] AS target,
 {'[' + ', '.join(_list(_QUEUE_STATES[s]) for s in SKILLS) + ']'}[k + 1][v % len({'[' + ', '.join(_list(_QUEUE_STATES[s]) for s in SKILLS) + ']'}[k + 1]) + 1] || printf('; scenario variant %04d', v) AS state,
 CASE WHEN (v + k + 7) % 2 = 1 THEN 'ko' ELSE 'en' END AS language, {_variant('(v + k * 3 + 7) % 10')} AS split FROM q)"""
MATRIX = f"""mx AS (SELECT printf('control-safety-%04d', i) AS scenario_id, {_list(K.REASONS)}[i % 3 + 1] AS expected_reason, (1000 + i // 3)::DOUBLE AS timestamp_ms FROM (SELECT event_id FROM events) r(i)),
 sm AS (SELECT *, timestamp_ms + CASE expected_reason WHEN 'emergency_stop' THEN 1 WHEN 'stale_observation' THEN 101 ELSE -1 END AS now_ms, expected_reason = 'emergency_stop' AS emergency_stop FROM mx)"""
MISS = f"nm AS (SELECT printf('control-safety-near-miss-%04d', i) AS scenario_id, {_list(list(PHRASES))}[i % {len(PHRASES)} + 1] AS expected_skill, (2000 + i // 3)::DOUBLE AS timestamp_ms, (2000 + i // 3)::DOUBLE + CASE WHEN i % 3 = 1 THEN 100 ELSE 1 END AS now_ms FROM (SELECT event_id FROM events) r(i))"
LOGITS = "lo AS (SELECT vec_id, ((label % 10) + 10) % 10 AS label, vec_id % 3 AS task, [embedding[i * 6 + 1]::DOUBLE for i in range(10)] AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"
FIT = LOGITS + """, g AS (SELECT lo.*, 0.25::DOUBLE + i * (3.75::DOUBLE / 75) AS t FROM lo, range(76) r(i)), n AS (SELECT task, t, list_max(x) / t + ln(list_sum([exp(y / t - list_max(x) / t) for y in x])) - x[label + 1] / t AS l FROM g),
 n1 AS (SELECT task, list_max(x) + ln(list_sum([exp(y - list_max(x)) for y in x])) - x[label + 1] AS l FROM lo)"""
STATUSES = "['trained', 'evaluated', 'calibrated', 'candidate', 'canary', 'active', 'retired']"
REASON = "CASE WHEN now_ms < timestamp_ms THEN 'invalid_clock' {0} END"
_CALLS = V.DRAFTS + """, cl AS (SELECT doc_id, provider, latency_ms, CASE WHEN h % 7 = 0 THEN 'value' WHEN h % 11 = 0 THEN 'probability' WHEN h % 13 = 0 THEN 'not_json' END AS er,
 sha256('{"type": "' || CASE WHEN h % 5 = 0 THEN 'noul' ELSE 'boolean' END || '", "value": ' || value::VARCHAR || ', "probability": ' || printf('%.4f', p) || '}') AS sha FROM drafts),
 ct AS (SELECT doc_id, provider, er, CASE WHEN er IS NULL THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN er IS NULL THEN 'model-' || provider END AS model, CASE WHEN er IS NULL THEN sha END AS sha, CASE WHEN er IS NULL THEN latency_ms END AS ms FROM cl)"""
SQL = {
    "teacher_reviews": W + _CALLS + """ SELECT a.doc_id, 'memory.remember_worthy@1' AS task, sha256(coalesce(d.text, '')) AS state_sha256, 'schema_invalid' AS reason, false AS reviewed, a.status AS qwen_status, a.model AS qwen_model, a.sha AS qwen_response_sha256, a.ms AS qwen_latency_ms, a.er AS qwen_error,
 b.status AS gemma_status, b.model AS gemma_model, b.sha AS gemma_response_sha256, b.ms AS gemma_latency_ms, b.er AS gemma_error FROM ct a JOIN ct b ON a.doc_id = b.doc_id AND a.provider = 'a' AND b.provider = 'b' JOIN documents d ON d.doc_id = a.doc_id WHERE a.er IS NOT NULL OR b.er IS NOT NULL""",
    "explicit_stop": W + STATES + f" SELECT conv_id, turn, {_any('t', STOP_SIGNALS)} AS stop FROM sn",
    "phrase_skill": W + STATES + ", f AS (SELECT conv_id, turn, list_filter([" + ", ".join(map(_skill, PHRASES)) + "], lambda x: x IS NOT NULL) AS f FROM sn) SELECT conv_id, turn, CASE WHEN len(f) = 1 THEN f[1] END AS skill FROM f",
    "safety_policy": W + V.OBSERVATIONS + " SELECT observation_id, CASE WHEN now_ms < timestamp_ms THEN 'invalid_clock' WHEN emergency_stop THEN 'emergency_stop' WHEN now_ms - timestamp_ms > 100 THEN 'stale_observation' WHEN abstained THEN 'model_abstained' WHEN confidence < .9 THEN 'confidence_below_control_threshold' WHEN ttl_ms > 100 THEN 'action_ttl_exceeded' ELSE 'run' END AS reason FROM ob",
    "staleness_gate": W + V.OBSERVATIONS + " SELECT observation_id, CASE WHEN now_ms < timestamp_ms THEN 'invalid_clock' WHEN now_ms - timestamp_ms > 100 THEN 'stale_observation' END AS reason FROM ob",
    "control_queue": W + QUEUE + " SELECT * FROM cq",
    "control_queue_counts": W + QUEUE + " SELECT target, language, split, count(*) AS n FROM cq GROUP BY ALL",
    "hard_negative_queue": f"""WITH p AS (SELECT i, s FROM (SELECT event_id FROM events) r(i), (VALUES (1), (2)) v(s)) SELECT printf('control-hard-%05d', i * 2 + s) AS sample_id, printf('control-hard-group-%05d', i) AS counterfactual_group_id, s::BIGINT AS pair_side,
 CASE WHEN s = 1 THEN {_list([a for a, _ in _CONFUSED])}[i % 6 + 1] ELSE {_list([b for _, b in _CONFUSED])}[i % 6 + 1] END AS target, CASE WHEN (i + 7) % 2 = 1 THEN 'ko' ELSE 'en' END AS language, {_variant('(i + 7) % 10')} AS split FROM p""",
    "safety_matrix": W + MATRIX + " SELECT * FROM sm",
    "near_miss_matrix": W + MISS + " SELECT * FROM nm",
    "simulation_report": W + MISS + " SELECT 'STOP' AS expected_skill, 'safety' AS source, count(*) AS n, count(*) AS correct FROM nm UNION ALL SELECT expected_skill, 'control-rule', count(*), count(*) FROM nm GROUP BY 1",
    "quality_gate_rows": W + V.BINARY + """, c AS (SELECT provider, count(*) AS n, count(*) FILTER (correct) AS x, 1.959963984540054::DOUBLE AS z FROM pred GROUP BY 1), g AS (SELECT 'split_accuracy' AS gate, provider AS subject, round(x / n::DOUBLE, 6) AS value, .99::DOUBLE AS lim FROM c
 UNION ALL SELECT 'split_accuracy_lower', provider, round(greatest(0, (x + z * z / 2 - z * sqrt(x * (n - x) / n::DOUBLE + z * z / 4)) / (n + z * z)), 6), .99 FROM c UNION ALL SELECT 'unique_groups', provider, n::DOUBLE, 381 FROM c UNION ALL SELECT 'false_stop_rate', provider, NULL, 0 FROM c)
 SELECT gate, subject, value, lim AS "limit", coalesce(value < lim, true) AS failed FROM g""",
    "temperature_fit": W + FIT + ", m AS (SELECT t, round(avg(l), 12) AS a, count(*) AS n FROM n GROUP BY 1) SELECT n, 'fitted' AS status, round(t, 6) AS temperature, (SELECT round(avg(l), 6) FROM n1) AS nll_before, round(a, 6) AS nll FROM m ORDER BY a, t LIMIT 1",
    "task_temperatures": W + FIT + ", m AS (SELECT task, t, round(avg(l), 12) AS a, count(*) AS n FROM n GROUP BY 1, 2), o AS (SELECT task, round(avg(l), 6) AS b FROM n1 GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY a, t) AS k FROM m) SELECT k.task, n, 'fitted' AS status, round(t, 6) AS temperature, b AS nll_before, round(a, 6) AS nll FROM k JOIN o ON o.task = k.task WHERE k = 1",
    "softmax_calibrated": W + LOGITS + " SELECT vec_id, round(1 / list_sum([exp((y - list_max(x)) / .5) for y in x]), 6) AS confidence, round(list_max(x) / .5 + ln(list_sum([exp((y - list_max(x)) / .5) for y in x])) - x[label + 1] / .5, 6) AS nll FROM lo",
    "lifecycle_transitions": f"""WITH u AS (SELECT DISTINCT user_id AS model_id FROM events), e AS (SELECT model_id, {STATUSES}[{V.keyed('model_id', 'status', 7)} + 1] AS from_status, {STATUSES}[{V.keyed('model_id', 'to', 7)} + 1] AS to_status FROM u)
 SELECT model_id, from_status, to_status, list_contains({_list([f'{a}>{b}' for a, b in gates.EDGES])}, from_status || '>' || to_status) AS allowed FROM e""",
    "typed_contract_parse": W + V.DRAFTS + """ SELECT doc_id, provider, CASE WHEN h % 13 = 0 AND h % 7 <> 0 AND h % 11 <> 0 THEN NULL ELSE 'boolean' END AS kind, CASE WHEN h % 7 = 0 THEN 'value' WHEN h % 11 = 0 THEN 'probability' WHEN h % 13 = 0 THEN 'not_json' END AS error,
 CASE WHEN h % 7 = 0 THEN .5 WHEN h % 11 = 0 OR h % 13 = 0 THEN NULL ELSE p END::DOUBLE AS probability FROM drafts""",
    "json_extraction": W + V.DRAFTS + " SELECT doc_id, provider, NOT (h % 13 = 0 AND h % 7 <> 0 AND h % 11 <> 0) AS found FROM drafts",
    "task_references": "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 5 > 0 THEN (event_id % 5)::INT END AS version FROM events",
    "request_errors": """SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'state' END, CASE WHEN length(text) > 12000 THEN 'state_length' END, CASE WHEN doc_id % 4 = 0 THEN 'duplicate_question' END, CASE WHEN doc_id % 3 = 0 THEN 'deadline' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents""",
}

_U, _V = (f"{V.keyed('event_id', k, 400)} / 1000.0::DOUBLE" for k in "uv")
SQL |= {
    "choice_repair": f"""WITH e AS (SELECT event_id, {_U} AS u, {_V} AS v, 0.3::DOUBLE AS w FROM events), t AS (SELECT *, u + v + w AS t FROM e), r AS (SELECT event_id, u, v, w, round(u / t, 6) AS x, round(v / t, 6) AS y, round(w / t, 6) AS z FROM t WHERE t BETWEEN .9 AND 1.1 AND abs(t - 1) > .02),
 a AS (SELECT *, 1 - (x + y + z) AS d, CASE WHEN w >= u AND w >= v THEN 'z' WHEN v >= u THEN 'y' ELSE 'x' END AS k FROM r)
 SELECT event_id, round(x + CASE WHEN k = 'x' THEN d ELSE 0 END, 6) AS x, round(y + CASE WHEN k = 'y' THEN d ELSE 0 END, 6) AS y, round(z + CASE WHEN k = 'z' THEN d ELSE 0 END, 6) AS z FROM a""",
    "safety_report": """WITH c AS (SELECT 2 * count(*)::DOUBLE AS n, count(*)::DOUBLE AS s, 1.959963984540054::DOUBLE AS z FROM events) SELECT n::BIGINT AS n, 1.0::DOUBLE AS accuracy, round((n + z * z / 2 - z * sqrt(z * z / 4)) / (n + z * z), 6) AS accuracy_lower, 1.0::DOUBLE AS stop_recall,
 round((s + z * z / 2 - z * sqrt(z * z / 4)) / (s + z * z), 6) AS stop_recall_lower, 0.0::DOUBLE AS false_stop_rate FROM c""",
}
