"""Queries and SQL of the model registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as R
from ..sources import adapters as A
from . import views as V

_PLAN = '{"record_type": "training_plan", "dataset": {"sha256": "%s"}, "student": {"model_id": "m", "backbone": "words", "heads": [{"task_id": "b", "task_version": 2}, {"task_id": "a", "task_version": 1}]}, "training": {"precision": "fp32"}}' % ("ab" * 32)
_CALIBRATION = '{"record_type": "calibration_manifest", "calibration_version": "c1"}'
#: What is put in place of what, and the error it makes.
_BROKEN = (
    ("", "", None), ('"training_plan"', '"plan"', "plan_record_type"), ('"calibration_manifest"', '"report"', "calibration_record_type"), ("abab", "zz", "dataset_sha256"), ('"heads": [{"task_id": "b", "task_version": 2}, {"task_id": "a", "task_version": 1}]', '"heads": []', "heads"),
    ('{"task_id": "b", "task_version": 2}', "7", "head_object"), ('"task_version": 2', '"task_version": 0', "head_task"), ('"task_id": "b"', '"task_id": "a"', "head_duplicate"), ('"c1"', '""', "calibration_version"), ('"fp32"', '""', "precision"),
    ('"backbone": "words"', '"backbone": ""', "model_id"), ('"training": {"precision": "fp32"}', '"training": 1', "plan_objects"), ("git", "", "git_commit"), ("torch", " ", "runtime"), ('"trained"', '"new"', "status"), ("sha", "", "checkpoint"),
)


def _manifests(s, d):
    """A model for each user, with one part of what it is made of broken."""
    told = lambda text, a, b: text if a in ("", "git", "torch", "sha") else text.replace(a, b)  # noqa: E731  those are no parts of the texts
    rows = [(i, told(_PLAN, a, b), told(_CALIBRATION, a, b), "" if a == "git" else "abc", " " if a == "torch" else "native", "new" if b == '"new"' else "trained", None if a == "sha" else "5" * 64) for i, (a, b, _) in enumerate(_BROKEN)]
    parts = s.createDataFrame(rows, "k long, plan string, calibration string, git string, runtime string, status string, checkpoint string")
    users = A.table(s, d, "events").select("user_id").distinct().withColumn("k", F.col("user_id") % len(_BROKEN))
    made = R.build_manifest(F.col("plan"), F.col("calibration"), F.col("git"), F.col("runtime"), F.col("status"), F.col("checkpoint"), F.concat(F.lit("m-"), F.col("user_id").cast("string")))
    return users.join(F.broadcast(parts), "k").select("user_id", made.alias("x")).select("user_id", "x.*")


def _models(s, d):
    names = F.array(*map(F.lit, R.STATUSES))
    u = A.table(s, d, "events").select(F.col("user_id").alias("id")).distinct()
    status = F.element_at(names, (A.keyed("id", "status", 7) + 1).cast("int"))
    # one active model at most
    return u.select(F.concat(F.lit("m-"), F.col("id").cast("string")).alias("model_id"), F.when(F.col("id") == 2, "active").when(F.col("id") == 3, "retired").when(status == "active", "canary").otherwise(status).alias("status"))


def _registered(s, d):
    made = _manifests(s, d).filter("error is null").select("user_id", "manifest.*")
    old = made.filter("user_id % 3 = 0").drop("user_id")
    asked = made.withColumn("seq", F.col("user_id")).unionByName(made.filter("user_id % 2 = 0").withColumn("seq", F.col("user_id") + 1_000_000)).withColumn("precision", F.when(F.col("seq") % 5 != 0, F.col("precision")))
    _, outcome = R.register(old, asked.drop("user_id"))
    return outcome.select("model_id", "seq", "error")


def _rolled_back(s, d):
    models = _models(s, d)
    after, event = R.rollback(models, "m-3")
    refused, why = R.rollback(models, "m-2", "again")
    n = lambda df, name: df.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "status", "n")
    e = lambda df, name: df.select(F.lit(name).alias("step"), F.concat_ws(" ", "action", "model_id", "from_status", "to_status", "reason", F.coalesce("error", F.lit("-"))).alias("status"), F.lit(1).cast("bigint").alias("n"))
    return n(after, "after").unionByName(e(event, "event")).unionByName(n(refused, "refused")).unionByName(e(why, "error"))


_REPORT = '{"record_type": "control_quality_gate", "passed": true, "production_ready": true, "human_label_gate": true, "human_test_gate": true, "checkpoint_sha256": "c", "dataset_sha256": "d", "safety": {"safe_stop_recall": 1.0, "safe_stop_recall_ci95": {"lower": 0.995}}}'
_LACKS = (
    ("", "", ""), ("control_quality_gate", "report", "record_type"), ('"passed": true', '"passed": 1', "passed"), ('"production_ready": true', '"production_ready": false', "production_ready"), ('"human_label_gate": true, ', "", "human_label_gate"), ('"human_test_gate": true', '"human_test_gate": null', "human_test_gate"),
    ('"c"', '"x"', "checkpoint_sha256"), ('"d"', '"x"', "dataset_sha256"), ('"safety": {', '"other": {', "safety"), ('"safe_stop_recall": 1.0', '"safe_stop_recall": 0.999', "safe_stop_recall"), ('"safe_stop_recall": 1.0', '"safe_stop_recall": "NaN"', "safe_stop_recall"),
    ('{"lower": 0.995}', "1", "safe_stop_recall_ci95"), ("0.995", "0.98", "safe_stop_recall_lower"), ("0.995", '"0.99"', ""), ("0.995", "null", "safe_stop_recall_lower"),
)


def _promotions(s, d):
    parts = s.createDataFrame([(i, _REPORT.replace(a, b) if a else _REPORT) for i, (a, b, _) in enumerate(_LACKS)], "k long, report string")
    users = A.table(s, d, "events").select("user_id").distinct().withColumn("k", F.col("user_id") % len(_LACKS))
    return users.join(F.broadcast(parts), "k").select("user_id", F.array_join(R.promotion_errors(F.col("report"), F.lit("c"), F.lit("d")), ",").alias("errors"))


def _replayed(s, d):
    """Customers as the log of a registry: each registers a model, changes its status, or goes back to it."""
    kind, e = A.keyed("c_custkey", "kind", 6), A.table(s, d, "customer").select("c_custkey")
    names = F.array(*map(F.lit, R.STATUSES))
    log = e.select(
        F.col("c_custkey").cast("long").alias("seq"), F.concat(F.lit("m-"), A.keyed("c_custkey", "model", 40).cast("string")).alias("model_id"),
        F.when(kind == 0, "register").when(kind == 1, "rollback").otherwise("transition").alias("action"),
        F.when(kind == 2, "broken").otherwise(F.element_at(names, (A.keyed("c_custkey", "target", 7) + 1).cast("int"))).alias("target"),
    )
    models = s.createDataFrame([("m-0", "active"), ("m-1", "retired"), ("m-2", "canary")], "model_id string, status string")
    return R.replay(models, log)


QUERIES = {
    "model_replay": lambda s, d: _replayed(s, d)[0],
    "model_replay_log": lambda s, d: _replayed(s, d)[1],
    "model_manifests": lambda s, d: _manifests(s, d).select("user_id", "manifest.model_id", F.to_json("manifest.tasks").alias("tasks"), "manifest.precision", "error"),
    "model_registration": _registered,
    "model_rollback": _rolled_back,
    "promotion_checks": _promotions,
    "model_list": lambda s, d: R.listed(_models(s, d).filter("status = 'candidate'")),
    "model_get": lambda s, d: R.get(_models(s, d), "m-2"),
}

W = "WITH "
_null = lambda x: "NULL" if x is None else f"'{x}'"
_BROKE = "br AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_null(e)})" for i, (_, _, e) in enumerate(_BROKEN)) + f") v(k, error)), us AS (SELECT DISTINCT user_id FROM events), mf AS (SELECT user_id, error FROM us JOIN br ON br.k = user_id % {len(_BROKEN)})"
MODELS = f"""ms AS (SELECT 'm-' || id AS model_id, CASE WHEN id = 2 THEN 'active' WHEN id = 3 THEN 'retired' WHEN s = 'active' THEN 'canary' ELSE s END AS status FROM (SELECT id, ['trained', 'evaluated', 'calibrated', 'candidate', 'canary', 'active', 'retired'][{V.keyed('id', 'status', 7)} + 1] AS s FROM (SELECT DISTINCT user_id AS id FROM events)))"""
#: The log replayed entry by entry: a map of statuses, and who is active.
REPLAY = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT c_custkey, {V.keyed('c_custkey', 'kind', 6)} AS kind FROM customer), e AS MATERIALIZED (SELECT c_custkey::BIGINT AS seq, row_number() OVER (ORDER BY c_custkey) AS k, 'm-' || {V.keyed('c_custkey', 'model', 40)} AS m, CASE kind WHEN 0 THEN 'register' WHEN 1 THEN 'rollback' ELSE 'transition' END AS action,
  CASE kind WHEN 1 THEN 'active' WHEN 2 THEN 'broken' ELSE {list(R.STATUSES)}[{V.keyed('c_custkey', 'target', 7)} + 1] END AS t FROM c),
 w AS (SELECT 0::BIGINT AS k, MAP {{'m-0': 'active', 'm-1': 'retired', 'm-2': 'canary'}} AS st, 'm-0' AS a, NULL::BIGINT AS seq, NULL::VARCHAR AS m, NULL::VARCHAR AS action, NULL::VARCHAR AS f, NULL::VARCHAR AS t, NULL::VARCHAR AS er
  UNION ALL SELECT k, CASE WHEN er IS NOT NULL THEN st WHEN t = 'active' AND action <> 'register' AND a <> m THEN map_concat(st, MAP {{a: 'retired'}}, MAP {{m: t}}) ELSE map_concat(st, MAP {{m: t}}) END, CASE WHEN er IS NULL AND t = 'active' AND action <> 'register' THEN m ELSE a END, seq, m, action, f, t, er
  FROM (SELECT *, CASE WHEN action = 'register' THEN CASE WHEN f IS NOT NULL THEN 'registered_already' WHEN t = 'broken' THEN 'unsupported_status' END WHEN t = 'broken' THEN 'unsupported_status' WHEN f IS NULL THEN 'unknown_model' WHEN action = 'rollback' AND f NOT IN {R.BACK_FROM} THEN 'rollback_status'
    WHEN f || '>' || t NOT IN ({', '.join(f"'{a}>{b}'" for a, b in R.EDGES)}) THEN 'not_allowed' END AS er FROM (SELECT e.k, w.st, w.a, e.seq, e.m, e.action, w.st[e.m] AS f, e.t FROM w JOIN e ON e.k = w.k + 1)))"""
SQL = {
    "model_replay": REPLAY + ", z AS (SELECT st FROM w ORDER BY k DESC LIMIT 1) SELECT x.key AS model_id, x.value AS status FROM (SELECT unnest(map_entries(st)) AS x FROM z)",
    "model_replay_log": REPLAY + " SELECT seq, m AS model_id, action, f AS from_status, t AS to_status, er AS error FROM w WHERE k > 0",
    "model_manifests": W + _BROKE + """ SELECT user_id, CASE WHEN error IS NULL THEN 'm-' || user_id END AS model_id, CASE WHEN error IS NULL THEN '{"a":[1],"b":[2]}' END AS tasks, CASE WHEN error IS NULL THEN 'fp32' END AS precision, error FROM mf""",
    "model_registration": W + _BROKE + """, a AS (SELECT user_id, user_id AS seq FROM mf WHERE error IS NULL UNION ALL SELECT user_id, user_id + 1000000 FROM mf WHERE error IS NULL AND user_id % 2 = 0), b AS (SELECT *, min(seq) FILTER (seq % 5 <> 0) OVER (PARTITION BY user_id) AS f FROM a)
 SELECT 'm-' || user_id AS model_id, seq, CASE WHEN seq % 5 = 0 THEN 'missing:precision' WHEN user_id % 3 = 0 OR seq > f THEN 'registered_already' END AS error FROM b""",
    "model_rollback": W + MODELS + """ SELECT 'after' AS step, CASE model_id WHEN 'm-3' THEN 'active' WHEN 'm-2' THEN 'retired' ELSE status END AS status, count(*) AS n FROM ms GROUP BY 2 UNION ALL SELECT 'event', 'transition m-3 retired active rollback -', 1 UNION ALL SELECT 'refused', status, count(*) FROM ms GROUP BY 2
 UNION ALL SELECT 'error', 'transition m-2 active active again not_allowed', 1""",
    "promotion_checks": "WITH l AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{e}')" for i, (_, _, e) in enumerate(_LACKS)) + f") v(k, errors)) SELECT DISTINCT user_id, errors FROM events JOIN l ON l.k = user_id % {len(_LACKS)}",
    "model_list": W + MODELS + " SELECT * FROM ms WHERE status = 'candidate'",
    "model_get": W + MODELS + " SELECT * FROM ms WHERE model_id = 'm-2'",
}
