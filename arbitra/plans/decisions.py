"""Queries and SQL of control decisions end to end, their contracts, and typed answers of all kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, contracts, stats
from ..functions import text as T
from ..operators import control as K
from ..sources import adapters as A
from . import views as V

#: States, whether they name a collision, and the skill that their phrases name; told by hand.
CASES: list[tuple[str | None, bool, str | None]] = [
    ("The target is ahead and can be  approached safely", False, "APPROACH"), ("Target is ahead but cannot be approached safely", False, None), ("Now CLOSE THE GAP to the visible marker", False, "APPROACH"),
    ("The pose is stable; no new command", False, "HOLD"), ("pose is stable, no new command, but an emergency hazard is present", False, None), ("Corridor is clear for forward motion", False, "MOVE"),
    ("corridor is clear for forward motion but the path is blocked", False, None), ("a clear path", False, "MOVE"), ("Heading is wrong and the turn space is clear", False, "ROTATE"), ("heading is wrong and turn space is clear yet it cannot turn", False, None),
    ("The hazard is approaching, move away", False, "RETREAT"), ("there is no safe space behind", False, None), ("An aligned object is within reach", False, "INTERACT"), ("the aligned object is not within reach", False, None),
    ("Lost localization", False, "RECOVER"), ("localization is lost but no recovery is needed", False, None), ("clear path and pose is stable with no new command", False, None), ("목표가 앞에 있고 접근 중", False, "APPROACH"),
    ("목표가 앞에 있고 접근할 수 없다", False, None), ("자세가 안정적이고  새 명령이 없다", False, "HOLD"), ("통로가 비어 있어 앞으로 움직일 수 있다", False, "MOVE"), ("통로가 비어 있어 앞으로 움직일 듯하나 막혀 있어", False, None),
    ("방향이 틀렸고 회전 공간이 있다", False, "ROTATE"), ("방향이 틀렸고 회전 공간이 막혀", False, None), ("위험이 다가오므로 멀어져야 한다", False, "RETREAT"), ("뒤쪽에 안전한 공간이 있다", False, "RETREAT"),
    ("정렬된 물체가 손이 닿는 거리에 있다", False, "INTERACT"), ("위치를 잃어 복구가 필요하다", False, "RECOVER"), ("위치를 잃어 복구가 필요 없다", False, None), ("Obstacle is directly ahead", True, None), ("즉시 충돌 위험이 있다", True, None),
    ("장애물이 바로 앞에 있다, clear path", True, "MOVE"), ("plain talk", False, None), (None, False, None),
]
_SKILLS = ("STOP", "HOLD", "MOVE", "ROTATE", "APPROACH", "RETREAT", "INTERACT", "RECOVER", "JUMP")


def _cases(s):
    return s.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "case_id long, state string")


def _observed(s, d):
    """Observations with one of the states each, and a model's answer that may be missing or wrong."""
    k = A.keyed("observation_id", "case", len(CASES))
    rows = A.observations(s, d).withColumn("case_id", k).join(F.broadcast(_cases(s)), "case_id")
    at = A.keyed("observation_id", "skill", 10)
    skill = F.when(at < 9, F.element_at(F.array(*map(F.lit, _SKILLS)), (at + 1).cast("int")))
    none = A.keyed("observation_id", "none", 20)
    return rows.withColumns({"skill": skill, "said": F.when(none == 1, F.lit(1.5)).when(none != 0, F.col("confidence"))})


def _decided(s, d):
    rows = _observed(s, d)
    act = K.decide(F.col("state"), F.col("now_ms"), F.col("timestamp_ms"), F.col("emergency_stop"), F.col("skill"), F.col("said"), F.col("abstained"), F.col("ttl_ms"))
    return rows.select("observation_id", act.alias("act")).select("observation_id", "act.*")


def _memories(s, d):
    """Words of documents as summaries, the whole text as the only one now and then."""
    words = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 11 == 0, F.array("text")).otherwise(F.slice(F.split("text", " "), 1, (F.col("doc_id") % 10).cast("int")))
    rows = A.table(s, d, "documents").select("doc_id", "text", words.alias("m"), F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("source")).alias("source"))
    shown = K.render_state(F.lit("a state"), F.col("m"), F.col("source"))
    return rows.select("doc_id", F.array_join(K.memory_errors(F.col("m"), F.col("source")), ",").alias("errors"), T.digest(shown).alias("rendered"), F.length(F.element_at(K.memory_from_text(F.col("text")), 1)).cast("bigint").alias("summary"))


def _bounds(s, d):
    rows = A.observations(s, d).select(
        F.col("observation_id").alias("id"), A.keyed("observation_id", "id", 9).alias("a"), A.keyed("observation_id", "state", 9).alias("b"), "timestamp_ms", "ttl_ms", "confidence", (A.keyed("observation_id", "x", 31) / 10.0 - 1.5).alias("x")
    )
    stamp = F.when(F.col("a") == 3, F.lit(float("nan"))).when(F.col("a") == 4, F.lit(-1.0)).when(F.col("a") == 5, F.lit(None)).otherwise(F.col("timestamp_ms"))
    name = F.when(F.col("b") == 0, " ").otherwise("speed")
    return rows.select(
        "id", F.array_join(K.observation_errors(F.when(F.col("a") > 0, "o").otherwise(" "), F.when(F.col("b") > 0, "s"), F.when(F.col("b") != 1, "d").otherwise("\t"), stamp), ",").alias("observation"),
        F.array_join(K.action_errors(F.when(F.col("a") > 0, "MOVE").otherwise("JUMP"), F.col("ttl_ms"), F.when(F.col("b") > 1, F.col("confidence") * 1.5), F.create_map(name, F.col("x"))), ",").alias("action"),
        F.array_join(K.policy_errors(F.col("x"), F.col("x") + 1, F.col("ttl_ms")), ",").alias("policy"),
    )


def _contents(s, d):
    """Replies of chat services in their several shapes, from benchmark items."""
    t = T.json_string(F.col("text"))
    k = F.col("item_id") % 7
    part = lambda x: F.concat(F.lit('{"type": "text", "text": '), x, F.lit("}"))
    reply = (
        F.when(k == 0, F.concat(F.lit('{"message": {"content": '), t, F.lit("}}")))
        .when(k == 1, F.concat(F.lit('{"message": {"content": ['), part(t), F.lit(', 7, {"type": "image"}, '), part(F.lit('" end"')), F.lit("]}}")))
        .when(k == 2, F.concat(F.lit('{"message": {"content": " ", "tool_calls": [{"function": {"arguments": '), t, F.lit("}}]}}")))
        .when(k == 3, F.concat(F.lit('{"text": '), t, F.lit("}")))
        .when(k == 4, F.lit('{"message": {"content": null}}'))
        .when(k == 5, F.lit("no json"))
        .otherwise(F.concat(F.lit('{"message": {"content": [], "tool_calls": []}, "text": '), t, F.lit("}")))
    )
    models = F.when(k == 4, F.lit('{"data": 3}')).otherwise(F.concat(F.lit('{"data": [{"id": "m'), k.cast("string"), F.lit('"}, {"id": "a"}, {"name": "b"}, {"id": "a"}, {"id": ""}]}')))
    return A.table(s, d, "benchmark").select("item_id", T.digest(contracts.message_content(reply)).alias("content"), F.array_join(contracts.model_ids(models), ",").alias("models"))


def _typed(s, d):
    """Answers of the three kinds from drafts: ``kind, value, p, selected, probabilities, score, lower, upper``."""
    x = A.drafts(s, d).withColumn("k", F.col("h") % 3)
    q = F.round(F.col("p"), 4)
    probabilities = F.create_map(F.lit("x"), q, F.lit("y"), F.round((1 - q) * 0.5, 5), F.lit("z"), F.round((1 - q) * 0.5, 5))
    return x.select(
        "doc_id", "provider", "h", F.when(F.col("k") == 0, "boolean").when(F.col("k") == 1, "choice").otherwise("score").alias("kind"), "value", q.alias("p"), F.when(q >= 0.5, "x").otherwise("y").alias("selected"), probabilities.alias("probabilities"),
        q.alias("score"), F.greatest(F.lit(0.0), F.round(q - 0.05, 4)).alias("lower"), F.least(F.lit(1.0), F.round(q + 0.1, 4)).alias("upper"), "abstained",
    )


def _answers(s, d):
    x = _typed(s, d)
    kind, value, p, selected, probabilities, score, lower, upper = (F.col(c) for c in ("kind", "value", "p", "selected", "probabilities", "score", "lower", "upper"))
    shown, doc = answers.label(kind, value, selected, score), F.col("doc_id")
    return x.select(
        "doc_id", "provider", F.round(answers.confidence(kind, p, selected, probabilities, lower, upper), 6).alias("confidence"), answers.target(kind, value, selected, score).alias("target"),
        shown.alias("shown"), answers.reviewed_value(F.when(doc % 4 == 0, shown).when(doc % 4 == 1, F.lit(" ")), F.when(doc % 4 <= 2, shown)).alias("reviewed"), answers.signature(kind, value, selected, score).alias("signature"), answers.accepted(kind, value, p, selected, probabilities, F.col("abstained"), 0.92, 0.08, 0.9).alias("accepted"),
    )


def _blended(s, d):
    x = _typed(s, d).withColumns({"kind": F.element_at(F.array(*map(F.lit, ("boolean", "choice", "score"))), (F.col("doc_id") % 3 + 1).cast("int"))})
    side = lambda p: x.filter(F.col("provider") == p).select("doc_id", "kind", *(F.col(c).alias(f"{c}_{p}") for c in ("value", "p", "probabilities", "score")))
    both = side("a").join(side("b").drop("kind"), "doc_id")
    pair = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
    return both.select("doc_id", "kind", answers.soft_target(F.col("kind"), pair("value"), pair("p"), pair("probabilities"), pair("score")).alias("t")).select(
        "doc_id", "kind", "t.probability", F.array_join(F.transform(F.map_entries("t.probabilities"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"]))), ",").alias("probabilities"), F.col("t.score").alias("score")
    )


_TEXTS = ("true", " Yes", "N", "no", "maybe", "X", "y ", "0.25", "1.5", "abc", "", None)


_KINDS = ("boolean", "choice", "score")
_one = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _corrections(s, d):
    """A reviewer's words as corrections, for each kind: an event says one of them."""
    i = F.col("id")
    rows = A.event_numbers(s, d).select(i.alias("event_id"), _one(_KINDS, F.floor(i / len(_TEXTS))).alias("kind"), _one(_TEXTS, i).alias("said"))
    c = answers.correction(F.col("kind"), F.col("said"), F.array(*map(F.lit, ("x", "y", "z"))))
    rows = rows.select("event_id", "kind", c.alias("c"))
    return rows.select("event_id", "kind", "c.value", "c.selected", F.array_join(F.transform(F.map_entries("c.probabilities"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string"))), ",").alias("probabilities"), "c.score", "c.error")


_SAID = {"a": "APPROACH", "H": "HOLD", "i": "INTERACT", "m": "MOVE", "s": "STOP", "ro": "ROTATE", "rt": "RETREAT", " RC ": "RECOVER", "move": "MOVE", "Stop": "STOP", "q": None, "": None}


def _aliases(s, d):
    rows = A.event_numbers(s, d).select(F.col("id").alias("event_id"), _one(tuple(_SAID), F.col("id")).alias("said"))
    return rows.select("event_id", "said", answers.skill_of(F.col("said")).alias("skill"))


def _abstentions(s, d):
    kind = _one(_KINDS, F.col("id"))
    rows = A.event_numbers(s, d).select(F.col("id").alias("event_id"), kind.alias("kind"), F.when(kind == "choice", F.array(*map(F.lit, "xyzw"))).otherwise(F.array().cast("array<string>")).alias("candidates"))
    return rows.select("event_id", "kind", answers.abstention(F.col("kind"), F.col("candidates")).alias("x")).select(
        "event_id", "kind", "x.value", F.round("x.probability", 6).alias("probability"), "x.selected", F.array_join(F.transform(F.map_values("x.probabilities"), lambda v: v.cast("string")), ",").alias("probabilities"), "x.score", "x.lower", "x.upper", "x.abstained"
    )


def _questions(s, d):
    e = A.table(s, d, "events").select("event_id", (F.col("event_id") % 6).alias("k"))
    k = F.col("k")
    ids = F.when(k == 0, "q 1").when(k == 1, F.lit("-q")).when(k == 2, F.lit("a" * 129)).otherwise(F.concat(F.lit("q."), F.col("event_id").cast("string")))
    task = F.when(k == 3, "Memory@1").when(k == 4, "memory.type@0").otherwise("memory.type@1")
    candidates = F.when(k == 5, F.array(F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y")))
    route = F.element_at(F.array(*map(F.lit, ("rule", "student", "mock", "human", "mixed", "none"))), (k + 1).cast("int"))
    return e.select(
        "event_id", F.array_join(contracts.question_errors(ids, task, candidates), ",").alias("question"),
        F.array_join(contracts.response_errors(route, F.when(k == 1, -1.0).when(k == 4, F.lit(None)).otherwise(2.0), F.when(k == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("r")))), ",").alias("response"),
    )


def _bands(s, d):
    e = A.table(s, d, "embeddings").filter("embedding is not null").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("w"))
    band = stats.score_interval(F.col("x") * 3 + 0.5, F.col("w"))
    return e.select("vec_id", band.alias("b")).select("vec_id", *(F.round(f"b.{c}", 6).alias(c) for c in ("value", "lower", "upper")))


QUERIES = {
    "phrase_skill_cases": lambda s, d: A.event_numbers(s, d).withColumn("case_id", F.col("id") % len(CASES)).join(F.broadcast(_cases(s)), "case_id").select(F.col("id").alias("event_id"), "case_id", F.coalesce(K.explicit_stop(F.col("state")), F.lit(False)).alias("stop"), K.phrase_skill(F.col("state")).alias("skill")),
    "control_decide": _decided,
    "control_latency": lambda s, d: K.latency_report(A.observations(s, d).select((F.col("now_ms") - F.col("timestamp_ms")).alias("age"), "emergency_stop"), "age", 100.0),
    "memory_context": _memories,
    "control_contracts": _bounds,
    "message_content": _contents,
    "typed_answers": _answers,
    "soft_target_blend": _blended,
    "review_corrections": _corrections,
    "skill_aliases": _aliases,
    "abstentions": _abstentions,
    "question_contracts": _questions,
    "score_bands": _bands,
}

W = "WITH "
_q = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"
TOLD = "told AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_q(c[0])}, {_q(c[1])}, {_q(c[2])})" for i, c in enumerate(CASES)) + ") v(case_id, state, stop, rule))"
_SAFE = "'STOP', 'safety', {0}, 50, 1.0, true"
DECIDED = V.OBSERVATIONS + ", " + TOLD + f""", o AS (SELECT ob.*, stop, rule, [{', '.join(map(_q, _SKILLS))}][{V.keyed('observation_id', 'skill', 10)} + 1] AS skill,
 CASE {V.keyed('observation_id', 'none', 20)} WHEN 1 THEN 1.5 WHEN 0 THEN NULL ELSE confidence END AS said FROM ob JOIN told ON told.case_id = {V.keyed('observation_id', 'case', len(CASES))}),
 w AS (SELECT *, CASE WHEN emergency_stop THEN 'emergency_stop' WHEN now_ms < timestamp_ms THEN 'invalid_clock' WHEN now_ms - timestamp_ms > 100 THEN 'stale_observation' WHEN stop THEN '1' WHEN rule IS NOT NULL THEN '2'
  WHEN skill IS NULL OR skill = 'JUMP' OR said > 1 OR ttl_ms < 1 THEN 'control_inference_error' WHEN abstained THEN 'student_abstained' WHEN coalesce(said, 0) < .9 THEN 'confidence_below_control_threshold' WHEN ttl_ms > 100 THEN 'action_ttl_exceeded' ELSE '3' END AS y FROM o)"""
_BLANKED = "CASE WHEN {0} IS NULL OR NOT regexp_matches({0}, '\\S') THEN '{1}' END"
_errors = lambda *xs: "array_to_string(list_filter([" + ", ".join(xs) + "], lambda x: x IS NOT NULL), ',')"
TYPED = V.DRAFTS + """, ty AS (SELECT doc_id, provider, h, ['boolean', 'choice', 'score'][h % 3 + 1] AS kind, value, round(p, 4) AS p, CASE WHEN round(p, 4) >= .5 THEN 'x' ELSE 'y' END AS selected, round((1 - round(p, 4)) * .5, 5) AS py, round((1 - round(p, 4)) * .5, 5) AS pz,
 greatest(0, round(round(p, 4) - .05, 4)) AS lower, least(1, round(round(p, 4) + .1, 4)) AS upper, abstained FROM drafts)"""
SQL = {
    "phrase_skill_cases": W + TOLD + f" SELECT event_id, case_id, stop, rule AS skill FROM events JOIN told ON told.case_id = event_id % {len(CASES)}",
    "control_decide": W + DECIDED + """ SELECT observation_id, CASE y WHEN '2' THEN rule WHEN '3' THEN skill ELSE 'STOP' END AS skill, CASE y WHEN '1' THEN 'safety-rule' WHEN '2' THEN 'control-rule' WHEN '3' THEN 'control-student' ELSE 'safety' END AS source,
 CASE y WHEN '1' THEN 'explicit_collision_signal' WHEN '2' THEN 'high_precision_' || lower(rule) || '_signal' WHEN '3' THEN NULL ELSE y END AS reason, CASE y WHEN '3' THEN ttl_ms ELSE 50 END::INT AS ttl_ms, CASE y WHEN '3' THEN said ELSE 1.0 END::DOUBLE AS confidence, y NOT IN ('1', '2', '3') AS abstained FROM w""",
    "control_latency": W + V.OBSERVATIONS + """, r AS (SELECT now_ms - timestamp_ms AS x, row_number() OVER (ORDER BY now_ms - timestamp_ms) - 1 AS k, count(*) OVER () AS n FROM ob)
 SELECT count(*) AS n, round(max(x) FILTER (k = n // 2), 3) AS p50, round(quantile_disc(x, .95), 3) AS p95, round(quantile_disc(x, .99), 3) AS p99, round(max(x), 3) AS max, round(avg(x), 3) AS mean, quantile_disc(x, .95) <= 100 AS passed FROM r""",
    "memory_context": f"""WITH m AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN [text] ELSE string_split(text, ' ')[1:doc_id % 10] END AS m, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE source END AS source FROM documents)
 SELECT doc_id, {_errors("CASE WHEN m IS NOT NULL AND trim(source) = '' THEN 'source' END", "CASE WHEN len(m) > 8 THEN 'count' END", "CASE WHEN len(list_filter(m, lambda x: x IS NULL OR NOT regexp_matches(x, '[^ \\t\\n\\r\\f\\v]'))) > 0 THEN 'blank' END", "CASE WHEN list_sum([length(x) for x in m]) > 2048 THEN 'length' END")} AS errors,
 sha256(CASE WHEN m IS NULL THEN 'a state' ELSE 'a state' || chr(10) || 'Relevant memory context (' || source || '):' || chr(10) || array_to_string(['- ' || x for x in m], chr(10)) END) AS rendered,
 CASE WHEN regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') THEN least(2048, length(regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g'))) END AS summary FROM m""",
    "control_contracts": W + V.OBSERVATIONS + f""", b AS (SELECT observation_id AS id, {V.keyed('observation_id', 'id', 9)} AS a, {V.keyed('observation_id', 'state', 9)} AS b, ttl_ms, confidence * 1.5 AS c, {V.keyed('observation_id', 'x', 31)} / 10.0::DOUBLE - 1.5 AS x FROM ob)
 SELECT id, {_errors("CASE WHEN a = 0 THEN 'observation_id' END", "CASE WHEN b = 0 THEN 'state' END", "CASE WHEN b = 1 THEN 'domain' END", "CASE WHEN a IN (3, 4, 5) THEN 'timestamp_ms' END")} AS observation,
 {_errors("CASE WHEN a = 0 THEN 'skill' END", "CASE WHEN ttl_ms < 1 THEN 'ttl_ms' END", "CASE WHEN b <= 1 OR c > 1 THEN 'confidence' END", "CASE WHEN b = 0 OR x NOT BETWEEN -1 AND 1 THEN 'parameters' END")} AS action,
 {_errors("CASE WHEN x NOT BETWEEN 0 AND 1 THEN 'minimum_confidence' END", "CASE WHEN x + 1 < 0 THEN 'max_observation_age_ms' END", "CASE WHEN ttl_ms < 1 THEN 'max_action_ttl_ms' END")} AS policy FROM b""",
    "message_content": """SELECT item_id, sha256(CASE item_id % 7 WHEN 1 THEN text || ' end' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE text END) AS content, CASE WHEN item_id % 7 = 4 THEN NULL ELSE 'm' || item_id % 7 || ',a' END AS models FROM benchmark""",
    "typed_answers": W + TYPED + """ SELECT doc_id, provider, round(CASE kind WHEN 'boolean' THEN p WHEN 'choice' THEN CASE selected WHEN 'x' THEN p ELSE py END ELSE greatest(0, 1 - (upper - lower)) END, 6) AS confidence,
 CASE kind WHEN 'boolean' THEN value::VARCHAR WHEN 'choice' THEN selected ELSE printf('%.6f', p) END AS target, CASE kind WHEN 'boolean' THEN value::VARCHAR WHEN 'choice' THEN selected ELSE p::VARCHAR END AS shown,
 CASE WHEN doc_id % 4 = 0 THEN CASE kind WHEN 'boolean' THEN value::VARCHAR WHEN 'choice' THEN selected ELSE p::VARCHAR END || ' (configured)' WHEN doc_id % 4 <= 2 THEN CASE kind WHEN 'boolean' THEN value::VARCHAR WHEN 'choice' THEN selected ELSE p::VARCHAR END || ' (teacher draft)' ELSE 'not provided' END AS reviewed, kind || ':' || CASE kind WHEN 'boolean' THEN value::VARCHAR WHEN 'choice' THEN selected ELSE printf('%.6f', p) END AS signature,
 NOT abstained AND CASE kind WHEN 'boolean' THEN p >= .92 WHEN 'choice' THEN CASE selected WHEN 'x' THEN p ELSE py END >= .9 ELSE true END AS accepted FROM ty""",
    "soft_target_blend": W + TYPED + """, b AS (SELECT a.doc_id, ['boolean', 'choice', 'score'][a.doc_id % 3 + 1] AS kind, a.p AS pa, b.p AS pb, a.value AS va, b.value AS vb, a.py AS ya, b.py AS yb, a.pz AS za, b.pz AS zb FROM ty a JOIN ty b ON a.doc_id = b.doc_id AND a.provider = 'a' AND b.provider = 'b')
 SELECT doc_id, kind, CASE kind WHEN 'boolean' THEN round((CASE WHEN va THEN pa ELSE 1 - pa END + CASE WHEN vb THEN pb ELSE 1 - pb END) / 2, 6) END AS probability,
 CASE kind WHEN 'choice' THEN printf('x=%.6f,y=%.6f,z=%.6f', round((pa + pb) / 2, 6), round((ya + yb) / 2, 6), round((za + zb) / 2, 6)) END AS probabilities, CASE kind WHEN 'score' THEN round((pa + pb) / 2, 6) END AS score FROM b""",
    "review_corrections": """WITH t AS (SELECT * FROM (VALUES (0, true, NULL, NULL), (1, true, NULL, NULL), (2, false, NULL, NULL), (3, false, NULL, NULL), (4, NULL, NULL, NULL), (5, NULL, 'x', NULL), (6, true, 'y', NULL), (7, NULL, NULL, .25), (8, NULL, NULL, NULL), (9, NULL, NULL, NULL), (10, NULL, NULL, NULL), (11, NULL, NULL, NULL)) v(case_id, b, c, s)), k AS (SELECT unnest(['boolean', 'choice', 'score']) AS kind)
 SELECT event_id, kind, CASE kind WHEN 'boolean' THEN b END AS value, CASE kind WHEN 'choice' THEN c END AS selected, CASE WHEN kind = 'choice' AND c = 'x' THEN 'x=1,y=0,z=0' WHEN kind = 'choice' AND c = 'y' THEN 'x=0,y=1,z=0' END AS probabilities, CASE kind WHEN 'score' THEN s END::DOUBLE AS score,
 CASE WHEN CASE kind WHEN 'boolean' THEN b IS NULL WHEN 'choice' THEN c IS NULL ELSE s IS NULL END THEN kind END AS error FROM events JOIN t ON case_id = event_id % 12 JOIN k ON kind = ['boolean', 'choice', 'score'][(event_id // 12) % 3 + 1]""",
    "skill_aliases": "SELECT event_id, said, skill FROM events JOIN (VALUES " + ", ".join(f"({k}, {_q(a)}, {_q(b)})" for k, (a, b) in enumerate(_SAID.items())) + ") v(k, said, skill) ON k = event_id % 12",
    "abstentions": """SELECT event_id, v.* FROM events JOIN (VALUES ('boolean', false, .5::DOUBLE, NULL, NULL, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, true), ('choice', NULL, .25, 'x', '0.25,0.25,0.25,0.25', NULL, NULL, NULL, true), ('score', NULL, NULL, NULL, NULL, .5, 0, 1, true)) v(kind, value, probability, selected, probabilities, score, lower, upper, abstained) ON kind = ['boolean', 'choice', 'score'][event_id % 3 + 1]""",
    "question_contracts": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'id' WHEN 1 THEN 'id' WHEN 2 THEN 'id' WHEN 3 THEN 'task' WHEN 4 THEN 'task' ELSE 'candidates' END AS question, CASE event_id % 6 WHEN 1 THEN 'latency_ms' WHEN 2 THEN 'route' WHEN 3 THEN 'results' WHEN 4 THEN 'latency_ms' WHEN 5 THEN 'route' ELSE '' END AS response FROM events""",
    "score_bands": """WITH e AS (SELECT vec_id, least(1, greatest(0, embedding[1]::DOUBLE * 3 + .5)) AS v, .5 / (1 + exp(-embedding[2]::DOUBLE)) AS w FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, round(v, 6) AS value, round(greatest(0, v - w), 6) AS lower, round(least(1, v + w), 6) AS upper FROM e""",
}
