"""Queries and SQL of review packs, the router with attempts and cache, and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import text as T
from ..operators import packs as P
from ..operators import review as R
from ..operators import router
from ..operators import routing as G
from ..sources import adapters as A
from ..sources.catalog import TASKS
from . import views as V

FOCUS = ["true"]
QUESTION = "Is this text worth keeping?"


def _queue(s, d):
    """Documents to be reviewed: siblings of ten, semantic groups of six, or alone."""
    i = F.col("doc_id")
    docs = A.table(s, d, "documents")
    return docs.select(
        F.concat(F.lit("doc-"), i.cast("string")).alias("sample_id"), F.lit("memory.remember_worthy@1").alias("task"), F.col("text").alias("state"), F.lit(QUESTION).alias("question"), F.col("lang").alias("language"), F.col("source").alias("domain"),
        F.create_map(F.lit("kind"), F.lit("document")).alias("lineage"), F.when(i % 10 < 8, "train").when(i % 10 == 8, "validation").otherwise("test").alias("split"), F.when(i % 5 == 0, F.concat(F.lit("cf-"), F.floor(i / 50).cast("string"))).when(i % 5 == 1, "").alias("counterfactual"),
        F.when(i % 3 == 0, F.concat(F.lit("sem-"), F.floor(i / 6).cast("string"))).alias("semantic"), i.alias("seq"), F.lit("kept back").alias("target"),
    )


def _drafts(s, d):
    x = A.drafts(s, d)
    a = x.filter("provider = 'a'").select("doc_id", "provider", "schema_valid", "repaired", "value", F.greatest("p", 1 - F.col("p")).alias("confidence"))
    b = x.filter("provider = 'b'").select("doc_id", F.col("value").alias("student"), F.col("p").alias("student_confidence"))
    return a.join(b, "doc_id").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("sample_id"), "provider", F.when(F.col("schema_valid"), F.col("value").cast("string")).alias("signature"), F.col("value").cast("string").alias("action"), "schema_valid", "repaired", "confidence", "student_confidence",
        (F.col("value") != F.col("student")).alias("student_disagrees"),
    )


def _shown(items):
    return items.select("position", "sample_id", "group", "language", T.digest("state").alias("state_sha256"), "split", F.col("teacher.signature").alias("signature"), "review_status")


def _keys(s, d):
    q = _queue(s, d)
    return q.select("sample_id", P.semantic_group(F.col("semantic"), F.col("sample_id")).alias("semantic_group"), P.counterfactual_group(F.col("counterfactual"), F.col("semantic"), F.col("sample_id")).alias("group"))


def _errors(s, d):
    q, x = _queue(s, d), _drafts(s, d)
    short = x.filter("sample_id <> 'doc-7'").unionByName(x.filter("sample_id = 'doc-9'"))
    bad = P.pack_errors(q, short, "a", "b").withColumn("pack", F.lit("bad"))
    return bad.unionByName(P.pack_errors(q, x, "a", "a").withColumn("pack", F.lit("good"))).select("pack", "error", F.col("n").cast("bigint").alias("n"))


def _focused(s, d):
    low = R.dual_actions(A.reviews(s, d)).withColumn("action", F.col("action").cast("string"))
    return s.createDataFrame([(x,) for x in P.focus(["STOP", "1"], low)], "action string")


def _attempts(s, d):
    """Questions of documents, three a request, through rule, student and two teachers."""
    x = A.drafts(s, d).withColumns({"q": F.greatest("p", 1 - F.col("p"))})
    side = lambda p: x.filter(F.col("provider") == p).select("doc_id", F.when(F.col("schema_valid"), F.col("value")).alias(f"v_{p}"), (~F.col("abstained") & G.accepted_boolean(F.col("value"), F.col("q"))).alias(f"ok_{p}"), F.col("latency_ms").alias(f"ms_{p}"))
    docs = A.table(s, d, "documents").select("doc_id", F.col("source"), "text")
    rows = docs.join(side("a"), "doc_id").join(side("b"), "doc_id").withColumn("r", G.rule_match(F.lit("memory.remember_worthy"), F.col("text")))
    h = A.keyed("doc_id", "student", 1000)
    rows = rows.select(
        "doc_id", F.floor(F.col("doc_id") / 3).alias("request"), (F.col("doc_id") % 3).alias("pos"), F.col("r.value").alias("rule"), F.col("r").isNotNull().alias("ruled"), F.when(h % 4 > 0, h >= 500).alias("student"), (h % 9 == 1).alias("sure"), (h / 20.0).alias("ms"), "v_a", "ok_a", "ms_a", "v_b", "ok_b", "ms_b",
    )
    stages = [
        router.Stage("rule", F.col("rule"), F.col("ruled"), F.lit(0.0)), router.Stage("student", F.col("student"), F.col("sure"), F.col("ms")), router.Stage("qwen", F.col("v_a"), F.col("ok_a"), F.col("ms_a")), router.Stage("gemma", F.col("v_b"), F.col("ok_b"), F.col("ms_b")),
    ]
    # time before a question: what the earlier ones of the request took without a deadline
    alone = rows.withColumn("t", router.attempts(stages, F.lit(0.0), F.lit(1e9), F.col("request") % 8 != 0))
    timed = router.started(alone.withColumn("took", F.col("t.elapsed_ms")), "request", "pos", "took", "since")
    return timed.withColumn("t", router.attempts(stages, F.col("since"), F.lit(900.0), F.col("request") % 8 != 0))


def _routed(s, d):
    tried = F.array_join(F.transform("t.list", lambda a: F.concat_ws(":", a["provider"], a["status"])), " ")
    return _attempts(s, d).select("doc_id", "t.route", F.col("t.answer").alias("answer"), "t.abstained", "t.reason", tried.alias("attempts"), F.round("t.elapsed_ms", 3).alias("elapsed_ms"))


def _responses(s, d):
    rows = _attempts(s, d).select("request", "pos", F.concat(F.lit("q"), F.col("pos").cast("string")).alias("question_id"), "t.answer", "t.route", "t.abstained", "t.elapsed_ms")
    return router.response(rows, "request", "pos")


def _payloads(s, d):
    r = _responses(s, d)
    body = router.payload(F.col("results"), T.request_id(F.col("request").cast("string")), F.col("route"), F.lit(0.5), F.array(F.lit("trace")), F.col("request") % 2 == 0)
    return r.select("request", "route", "review_required", T.digest(body).alias("payload_sha256"))


def _cached(s, d):
    """Responses kept by key, and later requests answered from them."""
    key = router.cache_key(F.concat(F.lit("state  "), (F.col("request") % 50).cast("string")), F.array(F.struct(F.lit("q0").alias("id"), F.lit("memory.type@1").alias("task"), F.array(F.lit("x"), F.lit("y")).alias("candidates"))))
    r = _responses(s, d).withColumn("cache_key", key).withColumn("request_id", F.col("request"))
    kept = router.cacheable(r)
    asked = A.table(s, d, "events").select("event_id", (F.col("event_id") % 60).alias("request")).withColumn("cache_key", key)
    return router.answered(asked, kept).select("event_id", F.col("cache_key"), "hit", F.col("cached_route").alias("route"))


#: Words of a caller, for the query.
WORDING = prompts.Wording("Give one object. {role}", {"qwen": "You go first.", "gemma": "You go second."}, {"control.skill": " Pick by safety."})


def _prompts(s, d):
    docs = A.table(s, d, "documents").select("doc_id", "source", F.element_at(F.array(*map(F.lit, ("memory.remember_worthy", "control.skill", "memory.importance"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("task_id"))
    rows = docs.join(F.broadcast(TASKS.frame(s)), "task_id")
    user = prompts.user_prompt(F.col("task_id"), F.col("version"), F.col("source"), F.lit(QUESTION), F.col("output_type"), F.col("candidates"))
    provider = F.when(F.col("doc_id") % 2 == 0, "qwen").when(F.col("doc_id") % 5 == 0, "other").otherwise("gemma")
    return rows.select("doc_id", T.digest(user).alias("user_sha256"), prompts.system_prompt(provider, F.col("task_id"), WORDING).alias("system"))


QUERIES = {
    "review_pack": lambda s, d: _shown(P.review_pack(_queue(s, d), _drafts(s, d), focused=FOCUS)),
    "review_pack_plain": lambda s, d: _shown(P.review_pack(_queue(s, d), _drafts(s, d), prioritize=False, split="validation")),
    "review_pack_manifest": lambda s, d: P.pack_manifest(P.review_pack(_queue(s, d), _drafts(s, d), focused=FOCUS), FOCUS),
    "review_pack_errors": _errors,
    "review_group_keys": _keys,
    "focus_union": _focused,
    "router_attempts": _routed,
    "router_responses": lambda s, d: _responses(s, d).select("request", F.array_join(F.transform(F.map_entries("results"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["value"], F.lit("-")))), ",").alias("results"), "route", "latency_ms", "review_required"),
    "router_payloads": _payloads,
    "router_cache": _cached,
    "teacher_prompts": _prompts,
}

W = "WITH "
QUEUE = """qu AS (SELECT doc_id AS i, 'doc-' || doc_id AS sample_id, lang AS language, text AS state, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
 coalesce(CASE WHEN doc_id % 5 = 0 THEN 'cf-' || doc_id // 50 END, CASE WHEN doc_id % 3 = 0 THEN 'sem-' || doc_id // 6 END, 'doc-' || doc_id) AS grp, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'sem-' || doc_id // 6 END, 'sample:doc-' || doc_id) AS sem FROM documents)"""
PACK = V.DRAFTS + ", " + QUEUE + """, it AS (SELECT qu.*, CASE WHEN a.schema_valid THEN a.value::VARCHAR END AS signature, a.value AS action, a.schema_valid, a.repaired, greatest(a.p, 1 - a.p) AS confidence, b.p AS lc, a.value <> b.value AS dis FROM qu JOIN drafts a ON a.doc_id = i AND a.provider = 'a' JOIN drafts b ON b.doc_id = i AND b.provider = 'b'),
 rk AS (SELECT *, {'l': CASE WHEN NOT schema_valid THEN 0 WHEN repaired THEN 1 ELSE 2 END, 'c': CASE WHEN schema_valid AND NOT repaired THEN confidence ELSE 0 END, 'i': sample_id} AS rk FROM it),
 g AS (SELECT grp, count(*) AS n, CASE WHEN count(*) > 1 AND count(signature) = count(*) AND count(DISTINCT signature) = 1 THEN 0 ELSE 1 END AS nc, min(CASE WHEN action THEN 0 ELSE 1 END) AS nf, min(CASE WHEN dis AND signature IS NOT NULL THEN 0 ELSE 1 END) AS nd, min(lc) AS least, min(rk) AS lr FROM rk GROUP BY 1)"""
_RULE = "CASE WHEN rule IS NOT NULL THEN rule = 'remember.explicit_commitment' END"


def _attempt_sql() -> str:
    from .workflow import REMEMBER

    h = V.keyed("d.doc_id", "student", 1000)
    return V.DRAFTS + f""", b0 AS (SELECT d.doc_id, d.doc_id // 3 AS request, d.doc_id % 3 AS pos, {REMEMBER} AS rule, {h} AS h, a.value AS va, a.schema_valid AS ka, a.schema_valid AND NOT a.abstained AND greatest(a.p, 1 - a.p) >= .92 AS oa, a.latency_ms AS ma,
 b.value AS vb, b.schema_valid AS kb, b.schema_valid AND NOT b.abstained AND greatest(b.p, 1 - b.p) >= .92 AS ob, b.latency_ms AS mb FROM documents d JOIN drafts a ON a.doc_id = d.doc_id AND a.provider = 'a' JOIN drafts b ON b.doc_id = d.doc_id AND b.provider = 'b'),
 b1 AS (SELECT *, rule IS NOT NULL AS dr, request % 8 <> 0 AS fb, h % 4 > 0 AS ks, h % 4 > 0 AND h % 9 = 1 AS os, h / 20.0::DOUBLE AS ms FROM b0),
 b2 AS (SELECT *, fb AND NOT dr AS ts, fb AND NOT dr AND NOT os AS ta FROM b1), b3 AS (SELECT *, CASE WHEN ts THEN ms ELSE 0 END + CASE WHEN ta THEN ma ELSE 0 END AS before, ta AND NOT oa AS wb FROM b2),
 b4 AS (SELECT *, coalesce(sum(before + CASE WHEN wb THEN mb ELSE 0 END) OVER (PARTITION BY request ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM b3),
 b5 AS (SELECT *, wb AND since + before >= 900 AS late, wb AND since + before < 900 AS tb FROM b4),
 att AS (SELECT *, CASE WHEN dr THEN 'rule' WHEN ts AND os THEN 'student' WHEN ta AND oa THEN 'qwen' WHEN tb AND ob THEN 'gemma' ELSE 'human' END AS route, CASE WHEN dr THEN rule = 'remember.explicit_commitment' WHEN ts AND os THEN h >= 500 WHEN tb AND kb THEN vb WHEN ta AND ka THEN va WHEN ts AND ks THEN h >= 500 END AS answer,
 NOT (dr OR (ts AND os) OR (ta AND oa) OR (tb AND ob)) AS abstained, CASE WHEN dr THEN NULL WHEN NOT fb THEN 'fallback_disabled' WHEN late THEN 'deadline_exceeded_before_gemma' WHEN tb AND NOT ob THEN CASE WHEN kb THEN 'gemma_uncertain' ELSE 'gemma_error' END
  WHEN ta AND NOT oa THEN CASE WHEN ka THEN 'qwen_uncertain' ELSE 'qwen_error' END WHEN ts AND NOT os THEN CASE WHEN ks THEN 'student_uncertain' ELSE 'student_error' END END AS reason,
 array_to_string(list_filter([CASE WHEN dr THEN 'rule:accepted' END, CASE WHEN ts THEN 'student:' || CASE WHEN os THEN 'accepted' WHEN ks THEN 'uncertain' ELSE 'error' END END, CASE WHEN ta THEN 'qwen:' || CASE WHEN oa THEN 'accepted' WHEN ka THEN 'uncertain' ELSE 'error' END END,
  CASE WHEN tb THEN 'gemma:' || CASE WHEN ob THEN 'accepted' WHEN kb THEN 'uncertain' ELSE 'error' END END], lambda x: x IS NOT NULL), ' ') AS attempts, before + CASE WHEN tb THEN mb ELSE 0 END AS elapsed_ms FROM b5),
 rs AS (SELECT request, string_agg('q' || pos || '=' || coalesce(answer::VARCHAR, '-'), ',' ORDER BY pos) AS results, '{{' || string_agg('"q' || pos || '":{{' || coalesce('"value":"' || answer::VARCHAR || '",', '') || '"abstained":' || abstained || '}}', ',' ORDER BY pos) || '}}' AS js,
  CASE WHEN count(DISTINCT route) = 1 THEN min(route) ELSE 'mixed' END AS route, round(sum(elapsed_ms), 3) AS latency_ms, bool_or(route = 'human') AS review_required FROM att GROUP BY 1)"""


ATTEMPTS = _attempt_sql()
_QJ = '[{"candidates": ["x", "y"], "id": "q0", "task": "memory.type@1"}]'
_KEY = """sha256('{"calibration_version": "phase1-router-uncalibrated", "kind": "result", "model_version": "phase1-router", "question_key": "' || sha256('%s') || '", "state_key": "' || sha256('{"kind": "state", "model_version": "phase1-router", "state": "state ' || event_id %% 60 %% 50 || '"}') || '"}')""" % _QJ
_USER = """sha256('{' || CASE doc_id % 3 WHEN 1 THEN '"candidates": ["STOP", "HOLD", "MOVE", "ROTATE", "APPROACH", "RETREAT", "INTERACT", "RECOVER"], ' ELSE '' END || '"output_schema": {"required": [' || CASE doc_id % 3 WHEN 0 THEN '"type", "value", "probability", "abstained"' WHEN 1 THEN '"type", "selected", "probabilities", "abstained"' ELSE '"type", "value", "interval_90", "abstained"' END || '], "type": "' || ['boolean', 'choice', 'score'][doc_id % 3 + 1] || '"}, "question": "Is this text worth keeping?", "state": "' || source || '", "task": "' || ['memory.remember_worthy', 'control.skill', 'memory.importance'][doc_id % 3 + 1] || '@1"}')"""
SQL = {
    "review_pack": W + PACK + ' SELECT row_number() OVER (ORDER BY nc, nf, nd, least, lr, rk.grp, rk) AS position, sample_id, rk.grp AS "group", language, sha256(state) AS state_sha256, split, signature, \'pending\' AS review_status FROM rk JOIN g ON g.grp = rk.grp',
    "review_pack_plain": W + PACK + ' SELECT row_number() OVER (ORDER BY i) AS position, sample_id, grp AS "group", language, sha256(state) AS state_sha256, split, signature, \'pending\' AS review_status FROM rk WHERE split = \'validation\'',
    "review_pack_manifest": W + PACK + """ SELECT count(*) AS sample_count, count(*) FILTER (action) AS focus_action_item_count, count(*) FILTER (lc < .9) AS student_uncertain_item_count, count(*) FILTER (signature IS NOT NULL AND dis) AS student_teacher_disagreement_item_count,
 (SELECT count(*) FROM g) AS counterfactual_group_count, (SELECT count(*) FROM g WHERE nc = 0) AS collision_group_count, (SELECT coalesce(sum(n), 0)::BIGINT FROM g WHERE nc = 0) AS collision_item_count, 'focus_action_then_student_disagreement_then_uncertainty_then_teacher' AS priority_order FROM rk""",
    "review_pack_errors": "SELECT * FROM (VALUES ('bad', 'queue_sha256', 1::BIGINT), ('bad', 'duplicate_or_empty_id', 1), ('bad', 'missing_draft', 1)) v(pack, error, n)",
    "review_group_keys": W + QUEUE + ' SELECT sample_id, sem AS semantic_group, grp AS "group" FROM qu',
    "focus_union": W + V.REVIEWS + """, e AS (SELECT a AS action, a = b AS same FROM rv WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT b, false FROM rv WHERE a <> b) SELECT action::VARCHAR AS action FROM e GROUP BY 1 HAVING avg(same::INT) < .98 UNION SELECT '1' UNION SELECT 'STOP'""",
    "router_attempts": W + ATTEMPTS + " SELECT doc_id, route, answer, abstained, reason, attempts, round(elapsed_ms, 3) AS elapsed_ms FROM att",
    "router_responses": W + ATTEMPTS + " SELECT request, results, route, latency_ms, review_required FROM rs",
    "router_payloads": W + ATTEMPTS + """ SELECT request, route, review_required, sha256('{"calibration":"phase1-router-uncalibrated","latency_ms":0.5,"model":"phase1-router","request_id":"req-' || substr(sha256(request::VARCHAR), 1, 24) || '","results":' || js || ',"route":"' || route || '"' || CASE WHEN request % 2 = 0 THEN ',"traces":["trace"]' ELSE '' END || '}') AS payload_sha256 FROM rs""",
    "router_cache": W + ATTEMPTS + ", c AS (SELECT request % 50 AS k, arg_min(route, request) AS route FROM rs WHERE NOT review_required GROUP BY 1) SELECT event_id, " + _KEY + " AS cache_key, c.k IS NOT NULL AS hit, c.route FROM events LEFT JOIN c ON c.k = event_id % 60 % 50",
    "teacher_prompts": f"SELECT doc_id, {_USER} AS user_sha256, CASE WHEN doc_id % 2 = 0 THEN 'Give one object. You go first.' WHEN doc_id % 5 <> 0 THEN 'Give one object. You go second.' END || CASE WHEN doc_id % 3 = 1 THEN ' Pick by safety.' ELSE '' END AS system FROM documents",
}
