"""Queries and SQL of integrity checks, group and id rules, nested redaction and per-class calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers
from ..functions import text as T
from ..operators import dataset as D
from ..operators import metrics
from ..operators import review as R
from ..sources import adapters as A
from ..sources.catalog import TASKS
from . import views as V
from .dataset import FOLD, REDACT, SAMPLES, samples

QUESTION = "Is this text worth keeping?"


def _cover(s, d):
    """A queue against drafts of which some are missing, unknown or there twice."""
    x = A.drafts(s, d).filter("provider = 'a'").select("doc_id", "h")
    some = x.filter("h % 29 <> 0")
    extra = x.filter("h % 31 = 1").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "h")
    return D.cover(A.table(s, d, "documents").select("doc_id"), some.unionByName(some.filter("h % 37 = 2")).unionByName(extra), "doc_id")


def _groups(s, d):
    """Splits by the first of four fields that says something, else by the content."""
    i = F.col("doc_id")
    rows = A.table(s, d, "documents").select(
        "doc_id", F.when(i % 5 == 0, F.concat(F.lit("g"), F.floor(i / 20).cast("string"))).when(i % 5 == 1, "").alias("split_group"), F.when(i % 3 == 0, F.concat(F.lit("d"), F.floor(i / 6).cast("string"))).alias("document_id"),
        F.when(i % 7 == 0, "e1").alias("entity_id"), F.when(i % 11 == 0, "s1").alias("source_id"), F.col("source").alias("state"),
    )
    content = T.json_object(question=T.json_string(F.lit(QUESTION)), state=T.json_string("state"))
    group = T.split_group(["split_group", "document_id", "entity_id", "source_id"], content)
    return rows.select("doc_id", group.alias("group")).select("doc_id", "group", T.split_of_json(F.col("group")).alias("split"))


def _ids(s, d):
    return A.table(s, d, "conversations").select("conv_id", "turn", T.short_id(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("mock_id"), T.short_id(F.col("conv_id").cast("string"), "cal-", 12).alias("calibration_id"))


def _signatures(s, d):
    """Answers of two providers by the hash of their canonical JSON, and whether they agree."""
    x = A.drafts(s, d).filter("schema_valid")
    key = answers.signature_key(F.lit("boolean"), F.col("value"), F.lit(None).cast("string"), F.lit(None).cast("double"))
    return x.groupBy("doc_id").agg(F.min(key).alias("least"), F.max(key).alias("most"), F.count("*").alias("n")).select("doc_id", "least", (F.col("least") == F.col("most")).alias("agree"), "n")


def _dual(s, d):
    """The queue joined to both reviewers' logs, which hold only what was reviewed."""
    r = A.reviews(s, d)
    queue = A.table(s, d, "documents").select("doc_id")
    log = lambda c: r.filter(F.col(c).isNotNull()).select("doc_id", c)
    return R.dual_counts(queue.join(log("a"), "doc_id", "left").join(log("b"), "doc_id", "left"))


def _tasks(s, d):
    k = F.col("doc_id") % 12
    rows = A.table(s, d, "documents").select(F.when(k % 4 == 0, "wiki.semantic_change").when(k % 4 == 1, "control.skill").otherwise("memory.remember_worthy").alias("task_id"), F.when(k < 8, "train").when(k < 10, "validation").when(k == 10, "test").otherwise("all").alias("split"))
    return D.coverage(rows)


def _skills(s, d):
    """Drafts per skill of the sample's target: valid, correct, repaired, and the interpolated median of their latency."""
    skills = F.array(*map(F.lit, ("STOP", "HOLD", "MOVE", "ROTATE", "APPROACH", "RETREAT", "INTERACT", "RECOVER")))
    rows = A.drafts(s, d).filter("provider = 'a'").withColumn("skill", F.element_at(skills, (F.col("doc_id") % 8 + 1).cast("int"))).withColumn("said", F.element_at(skills, (F.col("h") % 8 + 1).cast("int")))
    right = F.col("schema_valid") & (F.col("said") == F.col("skill"))
    n = rows.groupBy("skill").agg(F.count("*").alias("n"), F.count_if("schema_valid").alias("valid"), F.count_if(right).alias("correct"), F.count_if("repaired").alias("repaired"), F.round(F.percentile("latency_ms", 0.5), 3).alias("median_latency"))
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return n.withColumns({"coverage": share("valid", "n"), "accuracy_on_valid": share("correct", "valid")})


def _nested(s, d):
    rows = A.table(s, d, "documents").select("doc_id", F.struct(F.array("source", "text").alias("texts"), F.create_map(F.lit("me@mail.example.com"), F.struct(F.col("text").alias("inner"), F.col("doc_id").alias("n"))).alias("bag")).alias("v"))
    out = T.redact_nested(F.col("v"), rows.schema["v"].dataType, phone=False)
    return rows.select("doc_id", out.alias("r")).select("doc_id", T.digest(F.col("r.texts")[1]).alias("text_sha256"), T.digest(F.col("r.bag")["me@mail.example.com"]["inner"]).alias("inner_sha256"), F.col("r.bag")["me@mail.example.com"]["n"].alias("n"), F.map_keys("r.bag")[0].alias("key"))


def _chosen(s, d):
    """Adaptive error of the chosen class's probability."""
    rows = metrics.choice_rows(A.choice_predictions(s, d), ["event_id"])
    return metrics.adaptive_ece(rows.select(F.lit("all").alias("provider"), "event_id", (F.col("selected") == F.col("label")).alias("label"), F.col("confidence").alias("p")), ["provider"], ["event_id"])


QUERIES = {
    "exact_cover": _cover,
    "split_groups": _groups,
    "short_ids": _ids,
    "signature_keys": _signatures,
    "dual_review_join": _dual,
    "task_coverage": _tasks,
    "draft_quality_by_skill": _skills,
    "redact_nested": _nested,
    "class_calibration": lambda s, d: metrics.class_calibration(A.choice_predictions(s, d)),
    "choice_adaptive_ece": _chosen,
    "control_features": lambda s, d: A.table(s, d, "benchmark").select("item_id", F.array_join(F.transform(T.features("control", F.col("text"), F.lit(QUESTION)), lambda x: x.cast("string")), " ").alias("ids")),
    "language_filter": lambda s, d: samples(s, d).join(F.broadcast(TASKS.frame(s).select("task_id", "languages")), "task_id").filter(F.array_contains("languages", F.col("language"))).groupBy("language").agg(F.count("*").alias("n")),
}

W = "WITH "
SQL = {
    "exact_cover": W + V.DRAFTS + """, x AS (SELECT doc_id, h FROM drafts WHERE provider = 'a') SELECT count(*) FILTER (h % 29 = 0) AS missing, count(*) FILTER (h % 31 = 1) AS unknown, count(*) FILTER (h % 29 <> 0 AND h % 37 = 2) AS repeated FROM x""",
    "split_groups": f"""WITH g AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN 'g' || doc_id // 20 END, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id // 6 END, CASE WHEN doc_id % 7 = 0 THEN 'e1' END, CASE WHEN doc_id % 11 = 0 THEN 's1' END) AS k, source FROM documents),
 j AS (SELECT doc_id, coalesce('"' || k || '"', '{{"question": "{QUESTION}", "state": "' || source || '"}}') AS "group" FROM g) SELECT doc_id, "group", CASE WHEN {V.H.format('"group"')} % 100 < 80 THEN 'train' WHEN {V.H.format('"group"')} % 100 < 90 THEN 'validation' ELSE 'test' END AS split FROM j""",
    "short_ids": "SELECT conv_id, turn, substr(sha256(conv_id || '/' || turn), 1, 16) AS mock_id, 'cal-' || substr(sha256(conv_id::VARCHAR), 1, 12) AS calibration_id FROM conversations",
    "signature_keys": W + V.DRAFTS + """, k AS (SELECT doc_id, sha256('{"answer": "' || value || '", "type": "boolean"}') AS k FROM drafts WHERE schema_valid) SELECT doc_id, min(k) AS least, count(DISTINCT k) = 1 AS agree, count(*) AS n FROM k GROUP BY 1""",
    "dual_review_join": W + V.REVIEWS + " SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'missing_both' WHEN a IS NULL THEN 'missing_a' WHEN b IS NULL THEN 'missing_b' WHEN a = b THEN 'agreed' ELSE 'disagreement' END AS status, count(*) AS n FROM documents d LEFT JOIN rv ON rv.doc_id = d.doc_id GROUP BY 1",
    "task_coverage": """WITH r AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'wiki.semantic_change' WHEN 1 THEN 'control.skill' ELSE 'memory.remember_worthy' END AS t, CASE WHEN doc_id % 12 < 8 THEN 'train' WHEN doc_id % 12 < 10 THEN 'validation' WHEN doc_id % 12 = 10 THEN 'test' ELSE 'invalid' END AS s FROM documents)
 SELECT 'task' AS kind, t AS name, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'split', s, count(*) FROM r GROUP BY 2""",
    "draft_quality_by_skill": W + V.DRAFTS + """, x AS (SELECT *, ['STOP', 'HOLD', 'MOVE', 'ROTATE', 'APPROACH', 'RETREAT', 'INTERACT', 'RECOVER'][doc_id % 8 + 1] AS skill, schema_valid AND h % 8 = doc_id % 8 AS r FROM drafts WHERE provider = 'a')
 SELECT skill, count(*) AS n, count(*) FILTER (schema_valid) AS valid, count(*) FILTER (r) AS correct, count(*) FILTER (repaired) AS repaired, round(quantile_cont(latency_ms, .5), 3) AS median_latency, round(avg(schema_valid::INT), 6) AS coverage, round(count(*) FILTER (r) / nullif(count(*) FILTER (schema_valid), 0)::DOUBLE, 6) AS accuracy_on_valid FROM x GROUP BY 1""",
    "redact_nested": f"SELECT doc_id, sha256({REDACT.format('text')}) AS text_sha256, sha256({REDACT.format('text')}) AS inner_sha256, doc_id AS n, 'me@mail.example.com' AS key FROM documents",
    "class_calibration": W + V.CHOICE + ", b AS (SELECT class, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg((label = class)::INT) AS a FROM lng GROUP BY 1, 2) SELECT class, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b GROUP BY 1",
    "choice_adaptive_ece": W + V.CHOICE + """, r AS (SELECT *, row_number() OVER (ORDER BY confidence, event_id) AS r, count(*) OVER () AS n FROM rws), b AS (SELECT (r * least(10, n) - 1) // n AS bin, count(*) AS k, avg(confidence) AS c, avg((selected = label)::INT) AS a FROM r GROUP BY 1)
 SELECT 'all' AS provider, round(sum(k * abs(a - c)) / sum(k), 6) AS adaptive_ece FROM b""",
    "control_features": f"WITH t AS (SELECT item_id, regexp_extract_all({FOLD.format('text')}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')[:1024] AS w FROM benchmark) SELECT item_id, array_to_string([2 + {V.H.format('x')} % 4094 for x in w], ' ') AS ids FROM t",
    "language_filter": W + SAMPLES + " SELECT language, count(*) AS n FROM smp WHERE language IN ('ko', 'en') GROUP BY 1",
}
