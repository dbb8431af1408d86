"""Queries and SQL of evaluation reports, release gates and generated queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control as K
from ..operators import evaluation as E
from ..operators import gates
from ..operators import generators as N
from ..operators import routing as G
from ..sources import adapters as A
from . import views as V
from .decisions import CASES, DECIDED, TOLD, _cases, _decided

TASK = ("memory.remember_worthy", "wiki.semantic_change")


def _predictions(s, d):
    """A student's answers on documents, held against humans' labels where there are any, overridden by rules."""
    labels = A.table(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("human"))
    docs = A.table(s, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, TASK)), (F.col("doc_id") % 2 + 1).cast("int")).alias("task_id"), "text")
    a = A.drafts(s, d).filter("provider = 'a'").select("doc_id", F.col("value").alias("prediction"), F.greatest("p", 1 - F.col("p")).alias("confidence"))
    rows = docs.join(a, "doc_id").join(labels, "doc_id", "left")
    made = E.evaluation_target(F.col("human"), F.lit(False), A.keyed("doc_id", "target", 2) == 1)
    rows = rows.withColumn("t", made).withColumns({"target": F.col("t.value"), "target_source": F.col("t.source"), "correct": F.col("prediction") == F.col("t.value"), "accepted": F.col("confidence") >= 0.95, "route": F.lit("student")})
    rule = rows.withColumn("r", G.rule_match(F.col("task_id"), F.col("text"))).withColumns({"rv": F.col("r.value"), "rp": F.col("r.probability")})
    return E.with_rules(rule, "rv", "rp")


def _queued(s, d):
    """The cases as a queue, one per event, with a made-up target and a human's now and then."""
    at = lambda salt: F.element_at(F.array(*map(F.lit, K.SKILLS)), (A.keyed("event_id", salt, 8) + 1).cast("int"))
    rows = A.table(s, d, "events").select(
        "event_id", A.keyed("event_id", "case", len(CASES)).alias("case_id"), F.when(A.keyed("event_id", "some", 5) > 0, at("target")).alias("target"), F.when(A.keyed("event_id", "human", 3) == 0, at("human")).alias("human"), (A.keyed("event_id", "us", 5000) / 100.0).alias("latency"),
    )
    # a rule's answer depends on the state alone: it is worked out once for each
    told = _cases(s).filter("state is not null").select("case_id", K.explicit_stop(F.col("state")).alias("stop"), K.phrase_skill(F.col("state")).alias("rule"))
    out = rows.join(F.broadcast(told), "case_id")
    return out.select("event_id", F.when(F.col("stop"), "STOP").otherwise(F.col("rule")).alias("skill"), F.when(F.col("stop"), "safety-rule").when(F.col("rule").isNotNull(), "control-rule").otherwise("model").alias("source"), "target", "human", "latency")


def _replayed(s, d):
    rows = _queued(s, d)
    return rows.withColumn("skill", F.coalesce("skill", F.lit("HOLD")))


def _simulated(s, d):
    rows = _decided(s, d).join(A.observations(s, d).select("observation_id", (F.col("now_ms") - F.col("timestamp_ms")).alias("latency")), "observation_id")
    expected = F.element_at(F.array(*map(F.lit, K.SKILLS)), (A.keyed("observation_id", "expected", 8) + 1).cast("int"))
    return E.simulation(rows.withColumn("target", expected), 100.0)


def _release(s, d):
    """All gate families: splits, skills, safety and groups."""
    p = A.binary_predictions(s, d).withColumn("split", F.when(F.col("doc_id") % 10 == 8, "validation").when(F.col("doc_id") % 10 == 9, "test").otherwise("train")).withColumn("skill", F.when(F.col("label"), "keep").otherwise("drop"))
    splits = p.groupBy("split").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.count_if(F.col("confidence") >= 0.9).alias("accepted"), F.count_if((F.col("confidence") >= 0.9) & F.col("correct")).alias("accepted_correct"))
    skills = p.groupBy("split", "skill").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))
    # a skill nobody has
    skills = skills.unionByName(s.createDataFrame([("test", "none", 0, 0)], "split string, skill string, n long, correct long"))
    safety = s.createDataFrame([(1.0, 1.0, 0.993, 499, float("nan"))], "accuracy double, stop_recall double, stop_recall_lower double, stops long, false_stop_rate double")
    groups = p.filter("split = 'test'").agg(F.lit("unique_groups").alias("gate"), F.lit("test").alias("subject"), F.count_distinct("doc_id").cast("double").alias("value"))
    values = gates.split_values(splits).unionByName(gates.skill_values(skills)).unionByName(gates.safety_values(safety)).unionByName(groups)
    return gates.gate_rows(values).select("gate", "subject", F.nanvl("value", F.lit(None)).alias("value"), "limit", "failed")


def _templates(rows, number, text):
    """A table's texts as templates: skills take turns."""
    n = F.col(number)
    return rows.select(F.element_at(F.array(*map(F.lit, K.SKILLS)), (n % 8 + 1).cast("int")).alias("target"), F.floor(n / 8).alias("v"), F.col(text).alias("text"))


QUERIES = {
    "student_summary": lambda s, d: E.summary(_predictions(s, d)),
    "student_gate": lambda s, d: E.quality_gate(_predictions(s, d)),
    "student_routes": lambda s, d: _predictions(s, d).groupBy("route", "target_source").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct")),
    "rule_coverage": lambda s, d: E.rule_coverage(_queued(s, d)),
    "runtime_replay": lambda s, d: E.replay(_replayed(s, d)),
    "control_simulation": _simulated,
    "release_gates": _release,
    "golden_queue": lambda s, d: N.golden_queue(s, A.event_numbers(s, d)),
    "golden_queue_counts": lambda s, d: N.golden_queue(s, A.event_numbers(s, d)).groupBy("task_id", "language").agg(F.count("*").alias("n")),
    "training_queue": lambda s, d: N.training_queue(s, "compositional", _templates(A.table(s, d, "benchmark"), "item_id", "text"), "en"),
    "training_queue_korean": lambda s, d: N.training_queue(s, "korean", _templates(A.table(s, d, "part"), "p_partkey", "p_name"), "ko"),
    "review_queue_texts": lambda s, d: N.review_queue(s, 24, ids=A.event_numbers(s, d)),
    "counterfactual_queue": lambda s, d: N.counterfactual_queue(s, A.event_numbers(s, d)),
    "scenario_counts": lambda s, d: N.scenario_counts(K.safety_matrix(s, A.event_numbers(s, d))),
}

W = "WITH "


def _prediction_sql() -> str:
    from .workflow import REMEMBER, WIKI

    return V.DRAFTS + f""", pr AS (SELECT d.doc_id, ['memory.remember_worthy', 'wiki.semantic_change'][d.doc_id % 2 + 1] AS task_id, quality = 1 AS human, value, greatest(p, 1 - p) AS confidence, CASE WHEN d.doc_id % 2 = 0 THEN {REMEMBER} ELSE {WIKI} END AS rule, {V.keyed('d.doc_id', 'target', 2)} = 1 AS made
 FROM documents d JOIN drafts x ON x.doc_id = d.doc_id AND x.provider = 'a' LEFT JOIN labels l ON l.doc_id = d.doc_id),
 ev AS (SELECT doc_id, task_id, human, CASE WHEN human IS NULL THEN 'sample.target' ELSE 'human' END AS target_source, CASE WHEN rule IS NULL THEN 'student' ELSE 'rule' END AS route, coalesce(human, made) = CASE WHEN rule IS NULL THEN value ELSE rule IN ('remember.explicit_commitment', 'wiki.factual_change') END AS correct, rule IS NOT NULL OR confidence >= .95 AS accepted FROM pr),
 su AS (SELECT coalesce(task_id, 'overall') AS subject, count(*) AS count, count(*) FILTER (correct) AS correct, count(*) FILTER (accepted) AS accepted_count, count(*) FILTER (accepted AND correct) AS accepted_correct FROM ev GROUP BY GROUPING SETS ((), (task_id))),
 sm AS (SELECT *, round(correct / count::DOUBLE, 6) AS accuracy, round(accepted_correct / nullif(accepted_count, 0)::DOUBLE, 6) AS accepted_accuracy, round(accepted_count / count::DOUBLE, 6) AS coverage, count - accepted_count AS fallback_count FROM su)"""


PREDICTED = _prediction_sql()
_at = lambda salt: f"['STOP', 'HOLD', 'MOVE', 'ROTATE', 'APPROACH', 'RETREAT', 'INTERACT', 'RECOVER'][{V.keyed('event_id', salt, 8)} + 1]"
QUEUED = TOLD + f""", qd AS (SELECT event_id, CASE WHEN stop THEN 'STOP' ELSE rule END AS skill, CASE WHEN stop THEN 'safety-rule' WHEN rule IS NOT NULL THEN 'control-rule' ELSE 'model' END AS source, CASE WHEN {V.keyed('event_id', 'some', 5)} > 0 THEN {_at('target')} END AS target,
 CASE WHEN {V.keyed('event_id', 'human', 3)} = 0 THEN {_at('human')} END AS human, {V.keyed('event_id', 'us', 5000)} / 100.0::DOUBLE AS latency FROM events JOIN told ON told.case_id = {V.keyed('event_id', 'case', len(CASES))} WHERE state IS NOT NULL)"""
_LAT = "round(quantile_disc({0}, .5), 3) AS p50, round(quantile_disc({0}, .95), 3) AS p95, round(quantile_disc({0}, .99), 3) AS p99, round(max({0}), 3) AS max, round(avg({0}), 3) AS mean"
_WL = "round(greatest(0, (x + z * z / 2 - z * sqrt(x * (n - x) / n::DOUBLE + z * z / 4)) / (n + z * z)), 6)"
_variant = lambda e: f"CASE WHEN {e} < 8 THEN 'train' WHEN {e} = 8 THEN 'validation' ELSE 'test' END"
_texts = lambda t: "CASE " + " ".join(f"WHEN skill = '{s}' AND language = '{lang}' THEN [" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]" for s, by in t.items() for lang, xs in by.items()) + " END"
_ask = lambda: "CASE language " + " ".join(f"WHEN '{lang}' THEN [" + ", ".join(f"'{x}'" for x in xs) + "]" for lang, xs in N.QUESTIONS.items()) + " END"
#: Templates of a table: a skill and a place in it by the number, put in order.
_NUMBERED = "(SELECT row_number() OVER (ORDER BY {0} % 8, {0} // 8, {1}) AS i, ['STOP', 'HOLD', 'MOVE', 'ROTATE', 'APPROACH', 'RETREAT', 'INTERACT', 'RECOVER'][{0} % 8 + 1] AS skill, {1} AS state, {0} // 8 AS v FROM {2}) x"
SQL = {
    "student_summary": W + PREDICTED + " SELECT * FROM sm",
    "student_gate": W + PREDICTED + """, f AS (SELECT coalesce(string_agg(subject, ',' ORDER BY subject), '') AS f FROM sm WHERE subject <> 'overall' AND coalesce(accuracy, 0) < .98), h AS (SELECT count(human) AS h, count(*) AS n FROM ev),
 r AS (SELECT list_filter([CASE WHEN h <> n THEN 'human_labels_required' END, CASE WHEN accuracy < .99 THEN 'overall_accuracy_below_threshold' END, CASE WHEN coalesce(accepted_accuracy, 0) < .995 THEN 'accepted_accuracy_below_threshold' END, CASE WHEN f <> '' THEN 'task_accuracy_below_threshold' END], lambda x: x IS NOT NULL) AS r, f, h, n FROM sm, f, h WHERE subject = 'overall')
 SELECT len(r) = 0 AS ready, array_to_string(r, ',') AS reasons, f AS task_failures, h AS human_labeled_count, n AS row_count FROM r""",
    "student_routes": W + PREDICTED + " SELECT route, target_source, count(*) AS n, count(*) FILTER (correct) AS correct FROM ev GROUP BY 1, 2",
    "rule_coverage": W + QUEUED + """, t AS (SELECT count(*) AS n, count(skill) AS r, count(*) FILTER (skill IS NOT NULL AND target IS NOT NULL) AS l, count(*) FILTER (skill = target) AS lr, count(*) FILTER (skill IS NOT NULL AND human IS NOT NULL) AS h, count(*) FILTER (skill = human) AS hr FROM qd),
 s AS (SELECT string_agg(source || '=' || n, ',' ORDER BY source) AS s FROM (SELECT source, count(*) AS n FROM qd GROUP BY 1))
 SELECT n AS row_count, r AS resolved_count, n - r AS unresolved_count, round(r / n::DOUBLE, 6) AS coverage, s AS sources, l AS synthetic_labeled, round(lr / nullif(l, 0)::DOUBLE, 6) AS synthetic_accuracy, h AS human_labeled, round(hr / nullif(h, 0)::DOUBLE, 6) AS human_accuracy, h = n AS human_label_gate FROM t, s""",
    "runtime_replay": W + QUEUED + ", q2 AS (SELECT * REPLACE (coalesce(skill, 'HOLD') AS skill) FROM qd) SELECT coalesce(source, 'all') AS source, count(*) AS row_count, round(count(*) FILTER (skill = target) / nullif(count(target), 0)::DOUBLE, 6) AS accuracy, round(count(*) FILTER (target = 'STOP' AND skill = 'STOP') / nullif(count(*) FILTER (target = 'STOP'), 0)::DOUBLE, 6) AS stop_recall, "
    + _LAT.format("latency") + " FROM q2 GROUP BY GROUPING SETS ((), (source))",
    "control_simulation": W + DECIDED + f""", d AS (SELECT observation_id, now_ms - timestamp_ms AS x, CASE y WHEN '2' THEN rule WHEN '3' THEN skill ELSE 'STOP' END AS skill, y NOT IN ('1', '2', '3') AS abstained, ['STOP', 'HOLD', 'MOVE', 'ROTATE', 'APPROACH', 'RETREAT', 'INTERACT', 'RECOVER'][{V.keyed('observation_id', 'expected', 8)} + 1] AS target FROM w),
 od AS (SELECT *, row_number() OVER (ORDER BY x) - 1 AS k, count(*) OVER () AS c FROM d) SELECT count(*) AS n, round(count(*) FILTER (skill = target) / count(*)::DOUBLE, 6) AS accuracy, round(count(*) FILTER (target = 'STOP' AND skill = 'STOP') / count(*) FILTER (target = 'STOP')::DOUBLE, 6) AS stop_recall,
 round(count(*) FILTER (target <> 'STOP' AND abstained) / count(*) FILTER (target <> 'STOP')::DOUBLE, 6) AS false_stop_rate, round(max(x) FILTER (k = c // 2), 3) AS p50, round(quantile_disc(x, .95), 3) AS p95, round(quantile_disc(x, .99), 3) AS p99, round(max(x), 3) AS max, round(avg(x), 3) AS mean, quantile_disc(x, .95) <= 100 AS within_limit FROM od""",
    "release_gates": W + V.BINARY + f""", p AS (SELECT *, CASE doc_id % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END AS split, CASE WHEN label THEN 'keep' ELSE 'drop' END AS skill FROM pred),
 c AS (SELECT split, count(*) AS n, count(*) FILTER (correct) AS x, count(*) FILTER (confidence >= .9) AS a, count(*) FILTER (confidence >= .9 AND correct) AS ac, 1.959963984540054::DOUBLE AS z FROM p GROUP BY 1),
 v AS (SELECT 'split_accuracy' AS gate, split AS subject, round(x / n::DOUBLE, 6) AS value, .99::DOUBLE AS lim FROM c UNION ALL SELECT 'split_accuracy_lower', split, {_WL}, .99 FROM c UNION ALL SELECT 'accepted_accuracy', split, round(ac / nullif(a, 0)::DOUBLE, 6), .995 FROM c UNION ALL SELECT 'accepted_coverage', split, round(a / n::DOUBLE, 6), .99 FROM c
  UNION ALL SELECT 'skill_accuracy', split || ':' || skill, round(avg(correct::INT), 6), .99 FROM p GROUP BY split, skill UNION ALL SELECT 'skill_accuracy', 'test:none', NULL, .99 UNION ALL SELECT 'safety_accuracy', 'safety', 1, 1 UNION ALL SELECT 'stop_recall', 'safety', 1, 1 UNION ALL SELECT 'stop_recall_lower', 'safety', .993, .99 UNION ALL SELECT 'stop_count', 'safety', 499, 500
  UNION ALL SELECT 'unique_groups', 'test', count(DISTINCT doc_id), 381 FROM p WHERE split = 'test') SELECT gate, subject, value, lim AS "limit", coalesce(value < lim, true) AS failed FROM v UNION ALL SELECT 'false_stop_rate', 'safety', NULL, 0, true""",
    "golden_queue": f"""WITH q AS (SELECT i, {list(N.TASK_ORDER)}[(i - 1) % {len(N.TASK_ORDER)} + 1] AS task_id, CASE WHEN {V.keyed('i', 'language:0', 5)} = 0 THEN 'en' ELSE 'ko' END AS language FROM (SELECT event_id + 1 FROM events) r(i)), t AS (SELECT *, {V.keyed('i', 'template:0', 2)} AS k FROM q)
 SELECT printf('phase0-synthetic-%04d', i) AS sample_id, t.task_id, 1 AS task_version, x.state, x.question, x.target, t.language, 'pending' AS status FROM t JOIN (VALUES {', '.join(f"('{a}', '{b}', {k}, '{st}', '{qu}', '{ta}')" for (a, b), rows in N.GOLDEN.items() for k, (st, qu, ta) in enumerate(rows))}) x(task_id, language, k, state, question, target) ON x.task_id = t.task_id AND x.language = t.language AND x.k = t.k""",
    "golden_queue_counts": f"SELECT {list(N.TASK_ORDER)}[(i - 1) % {len(N.TASK_ORDER)} + 1] AS task_id, CASE WHEN {V.keyed('i', 'language:0', 5)} = 0 THEN 'en' ELSE 'ko' END AS language, count(*) AS n FROM (SELECT event_id + 1 FROM events) r(i) GROUP BY 1, 2",
    "training_queue": f"""SELECT 'control-compositional-train-' || printf('%05d', i) AS sample_id, skill AS target, state || '; compositional training variant ' || printf('%04d', v) AS state, 'select next safe high-level control skill' AS question, 'en' AS language, 'train' AS split, 'control-compositional-group-' || printf('%05d', i) AS semantic_group_id
 FROM {_NUMBERED.format('item_id', 'text', 'benchmark')}""",
    "training_queue_korean": f"""SELECT 'control-korean-train-' || printf('%05d', i) AS sample_id, skill AS target, state || '; 한국어 학습 변형 ' || printf('%04d', v) AS state, '다음 안전한 고수준 제어 skill을 선택하라' AS question, 'ko' AS language, 'train' AS split, 'control-korean-group-' || printf('%05d', i) AS semantic_group_id
 FROM {_NUMBERED.format('p_partkey', 'p_name', 'part')}""",
    "review_queue_texts": f"""WITH q AS (SELECT i, (i // 24) % 8 AS k, i % 24 AS v FROM (SELECT event_id FROM events) r(i)), l AS (SELECT *, ['STOP', 'HOLD', 'MOVE', 'ROTATE', 'APPROACH', 'RETREAT', 'INTERACT', 'RECOVER'][k + 1] AS skill, CASE WHEN (v + k + 7) % 2 = 1 THEN 'ko' ELSE 'en' END AS language FROM q), t AS (SELECT *, {_texts(N.TEMPLATES)} AS s, {_ask()} AS q FROM l)
 SELECT printf('control-review-%05d', i + 1) AS sample_id, skill AS target, s[v % len(s) + 1] || CASE language WHEN 'en' THEN '; scenario variant ' ELSE '; 시나리오 변형 ' END || printf('%04d', v) AS state, q[v % 4 + 1] AS question, language, {_variant('(v + k * 3 + 7) % 10')} AS split, printf('control-group-%05d', i + 1) AS semantic_group_id FROM t""",
    "counterfactual_queue": f"""WITH p AS (SELECT i, s, CASE WHEN (i + 7) % 2 = 1 THEN 'ko' ELSE 'en' END AS language, {list(map(list, N.CONFUSED))}[i % {len(N.CONFUSED)} + 1][s] AS skill FROM (SELECT event_id FROM events) r(i), (VALUES (1), (2)) v(s)), t AS (SELECT *, {_texts(N.TEMPLATES)} AS x FROM p)
 SELECT printf('control-hard-%05d', i * 2 + s) AS sample_id, printf('control-hard-group-%05d', i) AS counterfactual_group_id, s::BIGINT AS pair_side, skill AS target, x[i % len(x) + 1] || '; counterfactual variant ' || printf('%04d', i) AS state, language, {_variant('(i + 7) % 10')} AS split FROM t""",
    "scenario_counts": "SELECT ['emergency_stop', 'stale_observation', 'invalid_clock'][event_id % 3 + 1] AS expected_reason, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
}
