"""Queries and SQL of review, routing, traffic and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import review as R
from ..operators import routing as G
from ..sources import adapters as A
from ..streaming import flows
from . import views as V

FOCUS = ["true"]


def _queue(s, d):
    """Users as review items, a third of the events' correction log as feedback."""
    users = A.table(s, d, "events").select(F.col("user_id").alias("sample_id")).distinct()
    return users.withColumn("split", T.split_of(F.concat(F.lit("u"), F.col("sample_id").cast("string"))))


def _log(s, d):
    return A.feedback(s, d).filter("sample_id % 3 <> 0")


def _adjudicated(s, d):
    return A.table(s, d, "labels").select("doc_id", F.col("quality").alias("label")).filter(A.keyed("doc_id", "ruled", 10) > 0)


def _duplicates(s, d):
    """Documents with the label of one reviewer, grouped by equal text."""
    rv = A.reviews(s, d).select("doc_id", "a")
    return A.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("k")).join(rv, "doc_id", "left")


def _items(s, d):
    """Review items of two drafts per document: group = source, signature of draft a."""
    x = A.drafts(s, d)
    a = x.filter("provider = 'a'").select("doc_id", "schema_valid", "repaired", "value", F.greatest("p", 1 - F.col("p")).alias("confidence"))
    b = x.filter("provider = 'b'").select("doc_id", F.col("value").alias("student"), F.col("p").alias("student_confidence"))
    docs = A.table(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("group"))
    return docs.join(a, "doc_id").join(b, "doc_id").select(
        F.col("doc_id").alias("sample_id"), "group", F.when(F.col("schema_valid"), F.col("value").cast("string")).alias("signature"), F.col("value").cast("string").alias("action"), "schema_valid", "repaired", "confidence", "student_confidence",
        (F.col("value") != F.col("student")).alias("student_disagrees"),
    )


def _priority(s, d):
    cols = ["not_collision", "not_focus", "not_disagreeing", "least_confidence"]
    out = R.review_priority(_items(s, d), focus=FOCUS)
    return out.select("position", "sample_id", *[F.col(c).cast("bigint") for c in cols[:3]], F.round(cols[3], 6).alias(cols[3]))


def _requests(s, d):
    return A.table(s, d, "conversations").select("conv_id", "turn", "text")


def _cascade(s, d):
    """Questions of labelled documents through rule, two teachers and a human."""
    x = A.drafts(s, d)
    side = lambda p: x.filter(F.col("provider") == p).select("doc_id", F.col("value").alias(f"v_{p}"), F.greatest("p", 1 - F.col("p")).alias(f"p_{p}"), F.col("abstained").alias(f"x_{p}"), F.col("schema_valid").alias(f"ok_{p}"))
    # the rule is a column of its own: it is named several times below
    rows = A.table(s, d, "documents").select("doc_id", "source", G.rule_match(F.lit("memory.remember_worthy"), F.col("text")).alias("rule")).join(side("a"), "doc_id").join(side("b"), "doc_id")
    rule = F.col("rule")
    ok = lambda p: F.col(f"ok_{p}") & ~F.col(f"x_{p}") & G.accepted_boolean(F.col(f"v_{p}"), F.col(f"p_{p}"))
    answer = lambda p: F.when(F.col(f"ok_{p}"), F.col(f"v_{p}"))
    out = G.cascade([("rule", rule["value"], rule.isNotNull() & G.accepted_boolean(rule["value"], rule["probability"])), ("qwen", answer("a"), ok("a")), ("gemma", answer("b"), ok("b"))])
    return rows.select("doc_id", "source", out.alias("o")).select("doc_id", "source", "o.route", F.col("o.value").alias("value"), "o.abstained")


def _shadow(s, d):
    x = A.drafts(s, d).filter("schema_valid")
    side = lambda p: x.filter(F.col("provider") == p).select("doc_id", F.col("value").cast("string").alias("signature"))
    return G.shadow(side("a"), side("b"), ["doc_id"])


def _windows(s, d):
    t = A.traffic(s, d).withColumn("day", F.to_date("ts"))
    return t.filter("day < date '2024-01-16'"), t.filter("day >= date '2024-01-16'")


def _acceptance(s, d):
    x = A.drafts(s, d)
    return x.select("doc_id", "provider", G.accepted(F.lit("boolean"), F.col("value"), F.greatest("p", 1 - F.col("p")), F.col("abstained"), 0.90, 0.10).alias("accepted"), G.accepted_by_confidence(F.lit("boolean"), F.greatest("p", 1 - F.col("p")), 0.95).alias("confident"))


QUERIES = {
    "latest_feedback": lambda s, d: R.latest_feedback(A.feedback(s, d)).select("sample_id", "seq", "correction", "reviewer"),
    "apply_feedback": lambda s, d: R.apply_feedback(_queue(s, d), _log(s, d)).select("sample_id", "split", "label", "status"),
    "pending_items": lambda s, d: R.pending(_queue(s, d), _log(s, d)).select("sample_id"),
    "reviewed_items": lambda s, d: R.reviewed(_queue(s, d), _log(s, d)).select("sample_id"),
    "review_status": lambda s, d: R.review_status(_queue(s, d), _log(s, d)),
    "review_actions": lambda s, d: R.review_actions(_queue(s, d), _log(s, d), "correction"),
    "review_readiness": lambda s, d: R.readiness(_queue(s, d), _log(s, d)),
    "dual_review_status": lambda s, d: R.dual_counts(A.reviews(s, d)),
    "dual_review_pairs": lambda s, d: R.dual_pairs(A.reviews(s, d)),
    "dual_review_actions": lambda s, d: R.action_summary(R.dual_actions(A.reviews(s, d))),
    "dual_review_gate": lambda s, d: R.dual_gate(A.reviews(s, d)),
    "focus_actions": lambda s, d: R.focus_actions(R.dual_actions(A.reviews(s, d))).select("action", "rate"),
    "finalize_reviews": lambda s, d: R.finalize(A.reviews(s, d), _adjudicated(s, d), "doc_id"),
    "unruled_reviews": lambda s, d: R.unruled(A.reviews(s, d), _adjudicated(s, d), "doc_id").select("doc_id"),
    "teacher_adjudication": lambda s, d: _adjudication(s, d),
    "propagate_duplicate_label": lambda s, d: R.propagate(_duplicates(s, d), ["k"], "doc_id", "a").select("doc_id", "a", "propagated"),
    "collision_groups": lambda s, d: R.collisions(_items(s, d), "group", "signature").select(F.col("group").alias("k"), "members"),
    "review_priority": _priority,
    "review_batch": lambda s, d: R.batch_of_groups(_items(s, d), "group", 20, 10).select("sample_id"),
    "resume_index": lambda s, d: R.first_pending(R.apply_feedback(_queue(s, d), _log(s, d)), "sample_id"),
    "task_acceptance": lambda s, d: _acceptance(s, d).groupBy("provider", "accepted").agg(F.count("*").alias("n")),
    "confidence_acceptance": lambda s, d: _acceptance(s, d).groupBy("provider", "confident").agg(F.count("*").alias("n")),
    "rule_match": lambda s, d: _requests(s, d).select(
        "conv_id", "turn", G.rule_match(F.lit("memory.remember_worthy"), F.col("text"))["rule_id"].alias("remember_rule"), G.rule_match(F.lit("wiki.semantic_change"), F.col("text"))["rule_id"].alias("wiki_rule")
    ),
    "router_cascade": _cascade,
    "request_route": lambda s, d: G.request_route(_cascade(s, d), "source", "route"),
    "ingestion_gate": lambda s, d: _cascade(s, d).join(A.table(s, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", G.ingestion(F.col("text"), F.col("abstained"), F.col("value")).alias("disposition")),
    "shadow_compare": _shadow,
    "traffic_snapshot": lambda s, d: G.traffic_snapshot(A.traffic(s, d)),
    "traffic_routes": lambda s, d: G.traffic_snapshot(A.traffic(s, d), ["route"]),
    "traffic_daily_window": lambda s, d: flows.traffic_windows(A.traffic(s, d).withColumn("ts", F.col("ts").cast("timestamp"))).select(F.to_date("start").cast("string").alias("day"), "route", "requests", "abstained", F.round("confidence", 3).alias("confidence")),
    "drift_compare": lambda s, d: G.drift(*_windows(s, d)),
}


def _adjudication(s, d):
    x = A.drafts(s, d)
    sig = R.signature(F.lit("boolean"), F.col("value"), F.lit(None).cast("string"), F.lit(None).cast("double"))
    valid = x.withColumn("sig", F.when(F.col("schema_valid") & ~F.col("abstained"), sig))
    side = lambda p: valid.filter(F.col("provider") == p).select("doc_id", F.col("sig").alias(f"sig_{p}"))
    return side("a").join(side("b"), "doc_id").select("doc_id", R.adjudicate(F.col("sig_a"), F.col("sig_b")).alias("status"))


W = "WITH "
_split = lambda g: f"CASE WHEN {V.H.format('chr(34) || ' + g + ' || chr(34)')} % 100 < 80 THEN 'train' WHEN {V.H.format('chr(34) || ' + g + ' || chr(34)')} % 100 < 90 THEN 'validation' ELSE 'test' END"
QUEUE = f"q AS (SELECT DISTINCT user_id AS sample_id, {_split(chr(39) + 'u' + chr(39) + ' || user_id')} AS split FROM events), {V.FEEDBACK}, lg AS (SELECT * FROM fb WHERE sample_id % 3 <> 0)"
ITEMS = V.DRAFTS + """, it AS (SELECT d.doc_id AS sample_id, sha256(coalesce(text, '')) AS grp, CASE WHEN a.schema_valid THEN a.value::VARCHAR END AS signature, a.value AS action, a.schema_valid, a.repaired, greatest(a.p, 1 - a.p) AS confidence, b.p AS student_confidence,
 a.value <> b.value AS dis FROM documents d JOIN drafts a ON a.doc_id = d.doc_id AND a.provider = 'a' JOIN drafts b ON b.doc_id = d.doc_id AND b.provider = 'b')"""


def _any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '" + t.replace("'", "''") + "')" for t in terms) + ")"


LOW = "lower(trim(text))"
REMEMBER = f"CASE WHEN {_any(LOW, G.NEGATED)} THEN 'remember.explicit_rejection' WHEN {_any(LOW, G.GREETING)} AND NOT {_any(LOW, G.COMMITMENT)} AND length(trim(text)) <= 120 THEN 'remember.greeting_only' WHEN {_any(LOW, G.COMMITMENT)} THEN 'remember.explicit_commitment' END"
WIKI = f"CASE WHEN {_any(LOW, G.STYLE)} THEN 'wiki.style_only' WHEN regexp_matches(trim(text), '(?i)(?:에서\\s+.+?\\s*로\\s*(?:변경|바꾸|바뀌|수정)|\\b(?:changed|change|updated|update)\\b)') THEN 'wiki.factual_change' END"
CASCADE = V.DRAFTS + f""", m AS (SELECT d.doc_id, d.source, d.text, {REMEMBER} AS rule, a.schema_valid AS oka, a.value AS va, a.schema_valid AND NOT a.abstained AND greatest(a.p, 1 - a.p) >= .92 AS aa, b.schema_valid AS okb, b.value AS vb,
 b.schema_valid AND NOT b.abstained AND greatest(b.p, 1 - b.p) >= .92 AS ab FROM documents d JOIN drafts a ON a.doc_id = d.doc_id AND a.provider = 'a' JOIN drafts b ON b.doc_id = d.doc_id AND b.provider = 'b'),
 cs AS (SELECT doc_id, source, text, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN aa THEN 'qwen' WHEN ab THEN 'gemma' ELSE 'human' END AS route,
 CASE WHEN rule IS NOT NULL THEN rule = 'remember.explicit_commitment' WHEN aa THEN va WHEN ab THEN vb WHEN okb THEN vb WHEN oka THEN va END AS value, NOT (rule IS NOT NULL OR aa OR ab) AS abstained FROM m)"""
SNAP = "count(*) AS requests, count(*) FILTER (abstained) AS abstained, round(avg(abstained::INT), 6) AS abstain_rate, round(avg(confidence), 6) AS mean_confidence FROM tr"
SQL = {
    "latest_feedback": W + V.FEEDBACK + " SELECT sample_id, max(seq) AS seq, arg_max(correction, seq) AS correction, arg_max(reviewer, seq) AS reviewer FROM fb GROUP BY 1",
    "apply_feedback": W + QUEUE + ", l AS (SELECT sample_id, arg_max(correction, seq) AS label FROM lg GROUP BY 1) SELECT q.sample_id, split, label, CASE WHEN l.sample_id IS NULL THEN 'pending' ELSE 'reviewed' END AS status FROM q LEFT JOIN l ON l.sample_id = q.sample_id",
    "pending_items": W + QUEUE + " SELECT sample_id FROM q WHERE sample_id NOT IN (SELECT sample_id FROM lg)",
    "reviewed_items": W + QUEUE + " SELECT sample_id FROM q WHERE sample_id IN (SELECT sample_id FROM lg)",
    "review_status": W + QUEUE + ", c AS (SELECT split, count(*) AS n, count(*) FILTER (sample_id IN (SELECT sample_id FROM lg)) AS reviewed FROM q GROUP BY 1) SELECT split, n, reviewed, n - reviewed AS pending, round(reviewed / n::DOUBLE, 6) AS coverage, n = reviewed AS complete FROM c",
    "review_actions": W + QUEUE + ", l AS (SELECT sample_id, arg_max(correction, seq) AS correction FROM lg GROUP BY 1) SELECT correction, count(*) AS n FROM q JOIN l ON l.sample_id = q.sample_id GROUP BY 1",
    "review_readiness": W + QUEUE + ", p AS (SELECT split, count(*) FILTER (sample_id NOT IN (SELECT sample_id FROM lg)) AS k FROM q GROUP BY 1) SELECT bool_and(k = 0) AS all_splits, coalesce(bool_or(k = 0) FILTER (split = 'test'), false) AS test, sum(k)::BIGINT AS pending FROM p",
    "dual_review_status": W + V.REVIEWS + " SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'missing_both' WHEN a IS NULL THEN 'missing_a' WHEN b IS NULL THEN 'missing_b' WHEN a = b THEN 'agreed' ELSE 'disagreement' END AS status, count(*) AS n FROM rv GROUP BY 1",
    "dual_review_pairs": W + V.REVIEWS + " SELECT a || '->' || b AS pair, count(*) AS n FROM rv WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1",
    "dual_review_actions": W + V.REVIEWS + """, e AS (SELECT a AS action, a = b AS same FROM rv WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT b, false FROM rv WHERE a <> b)
, f AS (SELECT action, count(*) FILTER (same) AS agreed, count(*) FILTER (NOT same) AS disagreed, round(avg(same::INT), 6) AS rate FROM e GROUP BY 1) SELECT *, row_number() OVER (ORDER BY rate, disagreed DESC, action) AS position FROM f""",
    "dual_review_gate": W + V.REVIEWS + """, c AS (SELECT count(*) AS n, count(*) FILTER (a IS NULL OR b IS NULL) AS missing, count(*) FILTER (a = b) AS agreed FROM rv) SELECT n, missing, agreed, round(agreed / nullif(n - missing, 0)::DOUBLE, 6) AS rate,
 missing = 0 AND agreed / nullif(n - missing, 0)::DOUBLE >= .98 AS passed FROM c""",
    "focus_actions": W + V.REVIEWS + ", e AS (SELECT a AS action, a = b AS same FROM rv WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT b, false FROM rv WHERE a <> b) SELECT action, round(avg(same::INT), 6) AS rate FROM e GROUP BY 1 HAVING avg(same::INT) < .98",
    "finalize_reviews": W + V.REVIEWS + f" SELECT doc_id, a AS label, 'agreed' AS source FROM rv WHERE a = b UNION ALL SELECT r.doc_id, l.quality, 'adjudicated' FROM rv r JOIN labels l ON l.doc_id = r.doc_id WHERE a <> b AND {V.keyed('r.doc_id', 'ruled', 10)} > 0",
    "unruled_reviews": W + V.REVIEWS + f" SELECT doc_id FROM rv WHERE a <> b AND {V.keyed('doc_id', 'ruled', 10)} = 0",
    "teacher_adjudication": W + V.DRAFTS + ", x AS (SELECT doc_id, provider, CASE WHEN schema_valid AND NOT abstained THEN value END AS v FROM drafts) SELECT a.doc_id, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'invalid_or_abstained' WHEN a.v = b.v THEN 'agreed' ELSE 'disagreement' END AS status FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.provider = 'a' AND b.provider = 'b'",
    "propagate_duplicate_label": W + V.REVIEWS + ", g AS (SELECT d.doc_id, sha256(text) AS k, a FROM documents d LEFT JOIN rv ON rv.doc_id = d.doc_id), m AS (SELECT k, arg_max(a, doc_id) FILTER (a IS NOT NULL) AS l FROM g GROUP BY 1) SELECT doc_id, a, coalesce(a, l) AS propagated FROM g JOIN m ON m.k = g.k",
    "collision_groups": W + ITEMS + " SELECT grp AS k, count(*) AS members FROM it GROUP BY 1 HAVING count(*) > 1 AND count(signature) = count(*) AND count(DISTINCT signature) = 1",
    "review_priority": W + ITEMS + """, r AS (SELECT *, {'l': CASE WHEN NOT schema_valid THEN 0 WHEN repaired THEN 1 ELSE 2 END, 'c': CASE WHEN schema_valid AND NOT repaired THEN confidence ELSE 0 END, 'i': sample_id} AS rk FROM it),
 g AS (SELECT grp, CASE WHEN count(*) > 1 AND count(signature) = count(*) AND count(DISTINCT signature) = 1 THEN 0 ELSE 1 END AS nc, min(CASE WHEN action THEN 0 ELSE 1 END) AS nf, min(CASE WHEN dis AND signature IS NOT NULL THEN 0 ELSE 1 END) AS nd, min(student_confidence) AS lc, min(rk) AS lr FROM r GROUP BY 1)
 SELECT row_number() OVER (ORDER BY nc, nf, nd, lc, lr, r.grp, rk) AS position, sample_id, nc::BIGINT AS not_collision, nf::BIGINT AS not_focus, nd::BIGINT AS not_disagreeing, round(lc, 6) AS least_confidence FROM r JOIN g ON g.grp = r.grp""",
    "review_batch": W + ITEMS + " SELECT sample_id FROM it WHERE grp IN (SELECT DISTINCT grp FROM it ORDER BY grp LIMIT 10 OFFSET 20)",
    "resume_index": W + QUEUE + " SELECT min(sample_id) AS resume_at FROM q WHERE sample_id NOT IN (SELECT sample_id FROM lg)",
    "task_acceptance": W + V.DRAFTS + " SELECT provider, NOT abstained AND greatest(p, 1 - p) >= .90 AS accepted, count(*) AS n FROM drafts GROUP BY 1, 2",
    "confidence_acceptance": W + V.DRAFTS + " SELECT provider, greatest(p, 1 - p) >= .95 AS confident, count(*) AS n FROM drafts GROUP BY 1, 2",
    "rule_match": f"SELECT conv_id, turn, {REMEMBER} AS remember_rule, {WIKI} AS wiki_rule FROM conversations",
    "router_cascade": W + CASCADE + " SELECT doc_id, source, route, value, abstained FROM cs",
    "request_route": W + CASCADE + " SELECT source, CASE WHEN count(DISTINCT route) = 1 THEN min(route) ELSE 'mixed' END AS route, count(*) AS questions FROM cs GROUP BY 1",
    "ingestion_gate": W + CASCADE + " SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'ignored' WHEN length(text) > 12000 THEN 'retain_raw' WHEN abstained THEN 'review' WHEN value THEN 'extract' ELSE 'retain_raw' END AS disposition FROM cs",
    "shadow_compare": W + V.DRAFTS + ", x AS (SELECT doc_id, provider, value::VARCHAR AS v FROM drafts WHERE schema_valid) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.v AS primary_signature, b.v AS shadow_signature, coalesce(a.v = b.v, false) AS agree FROM (SELECT * FROM x WHERE provider = 'a') a FULL JOIN (SELECT * FROM x WHERE provider = 'b') b ON a.doc_id = b.doc_id",
    "traffic_snapshot": W + V.TRAFFIC + " SELECT " + SNAP,
    "traffic_routes": W + V.TRAFFIC + " SELECT route, " + SNAP + " GROUP BY 1",
    "traffic_daily_window": W + V.TRAFFIC + " SELECT strftime(ts, '%Y-%m-%d') AS day, route, count(*) AS requests, count(*) FILTER (abstained) AS abstained, round(sum(confidence), 3) AS confidence FROM tr GROUP BY 1, 2",
    "drift_compare": W + V.TRAFFIC + """, x AS (SELECT *, ts >= TIMESTAMP '2024-01-16' AS cur FROM tr), n AS (SELECT cur, count(*)::DOUBLE AS n, avg(abstained::INT) AS r FROM x GROUP BY 1), s AS (SELECT route, sum(CASE WHEN x.cur THEN 1 / n ELSE -1 / n END) AS d FROM x JOIN n ON n.cur = x.cur GROUP BY 1),
 u AS (SELECT 'abstain_rate' AS measure, sum(CASE WHEN cur THEN r ELSE -r END) AS d FROM n UNION ALL SELECT 'route:' || route, d FROM s) SELECT measure, round(d, 6) AS shift, abs(d) > .1 AS drifted FROM u""",
}
