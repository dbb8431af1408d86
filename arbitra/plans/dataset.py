"""Queries and SQL of the dataset factory, text functions and hashing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dataset as D
from ..operators import models
from ..sources import adapters as A
from ..sources import jsonl
from . import views as V

QUESTION = "Is this text worth keeping?"


def _docs(s, d):
    return A.table(s, d, "documents")


def samples(s, d):
    """Canonical samples of documents, with a human label where there is one."""
    labels = A.table(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("human"))
    kind = A.keyed("doc_id", "kind", 20)
    return _docs(s, d).join(labels, "doc_id", "left").select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("sample_id"), F.lit("memory.remember_worthy").alias("task_id"), F.lit(1).alias("task_version"), F.col("text").alias("state"), F.col("lang").alias("language"),
        F.col("source").alias("domain"), F.when(kind == 0, "user").otherwise("document").alias("kind"), F.when(kind == 1, "Secret").otherwise("public").alias("sensitivity"), "human",
    )


def built(s, d):
    """Samples with redacted state, duplicate mark, both drafts and the outcome."""
    rows = samples(s, d).withColumn("redacted", T.redact("state", phone=False))
    is_private, invalid = D.private(F.col("sensitivity"), F.col("kind")), F.coalesce(F.trim("state"), F.lit("")) == ""
    key = D.dedup_key(F.col("task_id"), F.col("task_version"), F.col("redacted"), F.lit(QUESTION))
    kept = D.mark_duplicates(rows.filter(~is_private & ~invalid).select("doc_id", key.alias("key")), ["key"], "doc_id").select("doc_id", "duplicate")
    drafts = A.drafts(s, d).withColumn("c", F.greatest("p", 1 - F.col("p")))
    # both drafts of a sample in one row, by one aggregate
    of = lambda p, c, out: F.max(F.when(F.col("provider") == p, F.col(c))).alias(f"{out}_{p}")
    sides = drafts.groupBy("doc_id").agg(*(of(p, c, out) for p in "ab" for c, out in (("value", "value"), ("p", "p"), ("schema_valid", "valid"), ("p", "c"))))
    joined = rows.join(kept, "doc_id", "left").join(sides, "doc_id", "left")
    return joined.withColumn(
        "outcome",
        D.outcome(is_private, invalid, F.coalesce("duplicate", F.lit(False)), F.col("human"), F.coalesce(F.col("valid_a") & F.col("valid_b"), F.lit(False)), F.col("value_a") == F.col("value_b"), F.col("c_a"), F.col("c_b")),
    )


def _split(s, d):
    return samples(s, d).select("sample_id", "task_id", "doc_id", "language", "domain", "state", T.split_of(F.col("sample_id")).alias("split"))


def _leak_queue(s, d):
    """Splits by sample, so that copies of a text fall into several."""
    return _split(s, d).withColumn("task_version", F.lit(1)).withColumn("question", F.lit(QUESTION))


def _leaks(s, d):
    q = _leak_queue(s, d)
    key = D.exact_key("task_id", "task_version", "language", "domain", "state", "question")
    # the same text in another source is no leak by this key
    keyed = q.select("sample_id", "split", F.sha2(F.concat_ws("\u0001", *[k.cast("string") for k in key]), 256).alias("k"))
    groups = q.select("sample_id", "split", "domain")
    return D.leaks(keyed, ["k"], "exact").unionByName(D.leaks(groups, ["domain"], "episode"))


def _merged(s, d):
    q = _split(s, d)
    out, repeated = D.merge(q.filter("split = 'train'"), q.filter("split <> 'train'"), q.filter("split = 'test'"))
    return out.agg(F.count("*").alias("n")).crossJoin(repeated.agg(F.count("*").alias("repeated")))


def _head(s, d):
    rows = samples(s, d).join(A.table(s, d, "labels").select("doc_id", "quality"), "doc_id").select("sample_id", "state", F.col("quality").cast("string").alias("target"))
    rows = rows.withColumn("split", T.split_of(F.col("sample_id")))
    return models.predict_choice(models.train_choice(rows.filter("split = 'train'"), features=2048, iterations=10), rows.filter("split <> 'train'")).select("sample_id", "target", "selected", "confidence")


def _joined(ids, sep=" "):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), sep)


def _marked(s, d):
    """Documents as rows of a control dataset: some without a split, a scenario, an episode or a semantic group, or of another task."""
    i = F.col("doc_id")
    return A.table(s, d, "documents").join(A.table(s, d, "labels"), "doc_id", "left").select(
        i.cast("string").alias("sample_id"), F.when(i % 13 == 0, "other").when(i % 10 < 8, "train").when(i % 10 == 8, "validation").otherwise("test").alias("split"), F.when(i % 17 == 0, "memory.importance").otherwise("control.skill").alias("task_id"),
        F.when(i % 19 != 0, F.concat(F.lit("s"), i.cast("string"))).alias("scenario_id"), F.when(i % 23 == 0, "").otherwise(F.concat(F.lit("e"), F.floor(i / 3).cast("string"))).alias("episode_id"), F.concat(F.lit("g"), F.floor(i / 7).cast("string")).alias("semantic_group_id"),
        F.col("quality").cast("string").alias("human"), F.lit("0").alias("target"),
    )


def _control_leaks(s, d):
    """Episodes and semantic groups that lie in several splits."""
    rows = _marked(s, d).where("split <> 'other'")
    return D.leaks(rows.where("episode_id <> ''"), ["episode_id"], "episode").unionByName(D.leaks(rows, ["semantic_group_id"], "semantic"))


def _reviewed(s, d, broken):
    rows = _marked(s, d).where("human is not null")
    i = F.col("sample_id").cast("long")
    flaw = lambda k, value, other: F.when((i % 29 == k) & F.lit(broken), F.lit(value)).otherwise(F.lit(other))
    reviews = rows.select("sample_id", F.col("human").alias("label"), flaw(1, "pending", "reviewed").alias("status"), flaw(2, " ", "two people").alias("reviewer"), flaw(3, "alone", "control dual-review agreed").alias("reason"))
    return D.materialize_reviewed(rows, reviews.where((i % 29 != 4) | F.lit(not broken)))


QUERIES = {
    "control_quality_errors": lambda s, d: D.quality_errors(_marked(s, d), "control.skill", human=True),
    "control_leaks": _control_leaks,
    "dual_materialize": lambda s, d: _reviewed(s, d, False)[0].select("sample_id", "target", "materialized_from", "target_source"),
    "dual_materialize_errors": lambda s, d: _reviewed(s, d, True)[1],
    "privacy_filter": lambda s, d: samples(s, d).filter(~D.private(F.col("sensitivity"), F.col("kind"))).groupBy("kind", "sensitivity").agg(F.count("*").alias("n")),
    "dataset_outcomes": lambda s, d: D.outcome_counts(built(s, d)),
    "dataset_records": lambda s, d: built(s, d).filter(F.col("outcome").startswith("accepted")).select(
        "sample_id", "outcome", F.coalesce("human", "value_a").alias("target"), D.soft_boolean(F.col("value_a"), F.greatest("p_a", 1 - F.col("p_a")), F.col("value_b"), F.greatest("p_b", 1 - F.col("p_b"))).alias("soft_target"), T.split_of(F.col("domain")).alias("split"), T.digest("redacted").alias("state_sha256"),
    ),
    "dataset_split": lambda s, d: _split(s, d).select("sample_id", "split"),
    "dataset_coverage": lambda s, d: D.coverage(_split(s, d), "language"),
    "golden_gate": lambda s, d: D.golden_gate(samples(s, d), 500),
    "first_wins_dedup": lambda s, d: D.first_wins(_docs(s, d).select("doc_id", F.sha2("text", 256).alias("k")), ["k"], "doc_id"),
    "exact_group_counts": lambda s, d: _split(s, d).agg(F.count_distinct("language", "domain", "state").alias("exact_groups"), F.count_distinct("domain").alias("episodes"), F.count("*").alias("n")),
    "cross_split_leaks": _leaks,
    "merge_datasets": _merged,
    "materialize_labels": lambda s, d: D.materialize_labels(
        samples(s, d).select("sample_id", F.lit(None).cast("int").alias("target"), "language"), A.table(s, d, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("sample_id"), F.col("quality").alias("label"))
    ),
    "class_balance": lambda s, d: D.balance(A.table(s, d, "labels").select("doc_id", "quality"), "quality", "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.sum("copy").cast("bigint").alias("copies"), F.sum("doc_id").cast("bigint").alias("ids")),
    "hard_negative_weights": lambda s, d: A.table(s, d, "events").groupBy(F.when(F.col("event_type") == "error", F.concat(F.lit("group-"), F.col("user_id").cast("string"))).isNotNull().alias("hard")).agg(
        F.sum(D.loss_weight(F.when(F.col("event_type") == "error", F.concat(F.lit("group-"), F.col("user_id").cast("string"))))).alias("weight")
    ),
    "soft_targets": lambda s, d: A.drafts(s, d).groupBy("doc_id").agg(F.round(F.avg("p"), 6).alias("soft_target")),
    "redact_secret_email": lambda s, d: _docs(s, d).select("doc_id", T.redact("text", phone=False).alias("redacted"), (T.redact("text", phone=False) != F.col("text")).alias("changed")),
    "redact_phone": lambda s, d: _docs(s, d).select("doc_id", T.redact("text").alias("redacted")),
    "normalize_state": lambda s, d: _docs(s, d).select("doc_id", T.digest(T.normalize_state("text")).alias("state_sha256")),
    "casefold_normalize": lambda s, d: _docs(s, d).select("doc_id", T.digest(T.normalize_prompt("text")).alias("prompt_sha256")),
    "state_cache_key": lambda s, d: _docs(s, d).select("doc_id", T.state_cache_key(F.lit("m1"), "text").alias("key")),
    "result_cache_key": lambda s, d: _docs(s, d).select(
        "doc_id", T.result_cache_key(F.lit("m1"), F.lit("c1"), T.state_cache_key(F.lit("m1"), "text"), T.question_cache_key(F.lit("memory.type@1"), F.lit(QUESTION), F.array(F.lit("x"), F.lit("y")))).alias("key")
    ),
    "request_ids": lambda s, d: A.table(s, d, "conversations").select("conv_id", "turn", T.request_id(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))).alias("request_id")),
    "hashed_tokens": lambda s, d: A.table(s, d, "benchmark").select("item_id", F.posexplode(T.word_features("text", 4096)).alias("pos", "token")).select("item_id", F.col("pos").cast("bigint").alias("pos"), F.col("token").cast("bigint").alias("token")),
    "byte_features": lambda s, d: A.table(s, d, "benchmark").select("item_id", _joined(T.padded(T.byte_features("text"), 1024)).alias("ids"), _joined(T.attention(T.byte_features("text"), 1024)).alias("mask")),
    "char_ngram_features": lambda s, d: A.table(s, d, "benchmark").select("item_id", _joined(T.char_features("text")).alias("ids")),
    "hybrid_features": lambda s, d: A.table(s, d, "benchmark").select("item_id", _joined(T.hybrid_features("text")).alias("ids")),
    "segmented_features": lambda s, d: A.table(s, d, "benchmark").select("item_id", _joined(T.segmented_features("text", F.lit(QUESTION))).alias("ids")),
    "table_digest": lambda s, d: jsonl.table_digest(A.table(s, d, "labels")),
    "ml_choice_head": _head,
}

W = "WITH "
_H = V.H.format
KIND = V.keyed("doc_id", "kind", 20)
SAMPLES = f"""smp AS (SELECT d.doc_id, 'doc-' || d.doc_id AS sample_id, d.text AS state, d.lang AS language, d.source AS domain, CASE WHEN {V.keyed('d.doc_id', 'kind', 20)} = 0 THEN 'user' ELSE 'document' END AS kind,
 CASE WHEN {V.keyed('d.doc_id', 'kind', 20)} = 1 THEN 'Secret' ELSE 'public' END AS sensitivity, l.quality = 1 AS human FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
REDACT = r"""regexp_replace(regexp_replace({0}, '\b(?:sk-[A-Za-z0-9_-]{{12,}}|gh[pousr]_[A-Za-z0-9_]{{12,}}|Bearer\s+[A-Za-z0-9._-]+)\b', '[SECRET]', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b', '[EMAIL]', 'g')"""
SPLIT = lambda g: f"CASE WHEN {_H('chr(34) || ' + g + ' || chr(34)')} % 100 < 80 THEN 'train' WHEN {_H('chr(34) || ' + g + ' || chr(34)')} % 100 < 90 THEN 'validation' ELSE 'test' END"
SPL = SAMPLES + f", spl AS (SELECT *, {SPLIT('sample_id')} AS split FROM smp)"
NORMAL = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
FOLD = "replace(replace(lower({0}), 'ß', 'ss'), 'ς', 'σ')"
JSON = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), chr(34), '\\' || chr(34)), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
STATE_KEY = "sha256('{\"kind\": \"state\", \"model_version\": \"m1\", \"state\": \"' || " + JSON.format(NORMAL.format("text")) + " || '\"}')"
QUESTION_KEY = f"sha256('{{\"candidates\": [\"x\", \"y\"], \"kind\": \"question\", \"question\": \"{QUESTION}\", \"task\": \"memory.type@1\"}}')"
BUILT = SAMPLES + f""", red AS (SELECT *, {REDACT.format('state')} AS redacted, NOT (lower(sensitivity) = 'secret' OR lower(kind) = 'user') AND trim(coalesce(state, '')) <> '' AS ok FROM smp),
 ded AS (SELECT doc_id, row_number() OVER (PARTITION BY redacted ORDER BY doc_id) > 1 AS duplicate FROM red WHERE ok), {V.DRAFTS},
 bld AS (SELECT r.*, a.value AS value_a, a.p AS p_a, b.value AS value_b, b.p AS p_b, CASE WHEN trim(coalesce(state, '')) = '' THEN 'review_invalid_seed' WHEN NOT ok THEN 'excluded_privacy' WHEN e.duplicate THEN 'excluded_duplicate' WHEN human IS NOT NULL THEN 'accepted_human'
  WHEN NOT (a.schema_valid AND b.schema_valid) THEN 'review_schema_invalid' WHEN a.p < .5 AND b.p < .5 THEN 'excluded_low_confidence' WHEN a.value <> b.value OR abs(a.p - b.p) > .35 THEN 'review_disagreement' ELSE 'accepted_silver' END AS outcome
  FROM red r LEFT JOIN ded e ON e.doc_id = r.doc_id LEFT JOIN drafts a ON a.doc_id = r.doc_id AND a.provider = 'a' LEFT JOIN drafts b ON b.doc_id = r.doc_id AND b.provider = 'b')"""
MARKED = """mk AS (SELECT d.doc_id, d.doc_id::VARCHAR AS sample_id, CASE WHEN d.doc_id % 13 = 0 THEN 'other' WHEN d.doc_id % 10 < 8 THEN 'train' WHEN d.doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split, CASE WHEN d.doc_id % 17 = 0 THEN 'memory.importance' ELSE 'control.skill' END AS task_id,
 CASE WHEN d.doc_id % 23 = 0 THEN '' ELSE 'e' || d.doc_id // 3 END AS episode_id, 'g' || d.doc_id // 7 AS semantic_group_id, quality::VARCHAR AS human FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_LEAK = "SELECT '{0}' AS kind, min(sample_id) AS first_id, count(*) AS members, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM mk WHERE split <> 'other' AND {1} <> '' GROUP BY {1} HAVING count(DISTINCT split) > 1"
SQL = {
    "control_quality_errors": W + MARKED + """ SELECT sample_id, 'invalid_split' AS reason, split AS value FROM mk WHERE split = 'other' UNION ALL SELECT sample_id, 'unexpected_task', task_id FROM mk WHERE task_id <> 'control.skill' UNION ALL SELECT sample_id, 'missing_scenario_id', '' FROM mk WHERE doc_id % 19 = 0
 UNION ALL SELECT sample_id, 'missing_episode_id', '' FROM mk WHERE episode_id = '' UNION ALL SELECT sample_id, 'human_label_required', 'null' FROM mk WHERE human IS NULL""",
    "control_leaks": W + MARKED + " " + _LEAK.format("episode", "episode_id") + " UNION ALL " + _LEAK.format("semantic", "semantic_group_id"),
    "dual_materialize": W + MARKED + " SELECT sample_id, human AS target, '0' AS materialized_from, 'human_review' AS target_source FROM mk WHERE human IS NOT NULL",
    "dual_materialize_errors": W + MARKED + " SELECT sample_id, ['status', 'reviewer', 'reason', 'label'][doc_id % 29] AS error FROM mk WHERE human IS NOT NULL AND doc_id % 29 BETWEEN 1 AND 4",
    "privacy_filter": W + SAMPLES + " SELECT kind, sensitivity, count(*) AS n FROM smp WHERE NOT (lower(sensitivity) = 'secret' OR lower(kind) = 'user') GROUP BY 1, 2",
    "dataset_outcomes": W + BUILT + " SELECT outcome, count(*) AS n FROM bld GROUP BY 1",
    "dataset_records": W + BUILT + f" SELECT sample_id, outcome, coalesce(human, value_a) AS target, round((p_a + p_b) / 2, 6) AS soft_target, {SPLIT('domain')} AS split, sha256(redacted) AS state_sha256 FROM bld WHERE outcome LIKE 'accepted%'",
    "dataset_split": W + SPL + " SELECT sample_id, split FROM spl",
    "dataset_coverage": W + SPL + " SELECT CASE WHEN grouping(language) = 0 THEN 'task' ELSE 'split' END AS kind, coalesce(language, split) AS name, count(*) AS n FROM spl GROUP BY GROUPING SETS ((language), (split))",
    "golden_gate": W + SAMPLES + " SELECT count(*) AS n, count(human) AS human, greatest(0, 500 - count(*))::BIGINT AS missing, count(*) >= 500 AND count(human) = count(*) AS passed FROM smp",
    "first_wins_dedup": "SELECT min(doc_id) AS doc_id, sha256(text) AS k FROM documents GROUP BY 2",
    "exact_group_counts": W + SPL + " SELECT (SELECT count(*) FROM (SELECT DISTINCT language, domain, state FROM spl)) AS exact_groups, count(DISTINCT domain) AS episodes, count(*) AS n FROM spl",
    "cross_split_leaks": W + SPL + f""", g AS (SELECT 'exact' AS kind, sample_id, split, language || domain || {NORMAL.format(FOLD.format('state'))} AS k FROM spl UNION ALL SELECT 'episode', sample_id, split, domain FROM spl)
 SELECT kind, min(sample_id) AS first_id, count(*) AS members, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM g GROUP BY kind, k HAVING count(DISTINCT split) > 1""",
    "merge_datasets": W + SPL + " SELECT (SELECT count(*) FROM spl) + (SELECT count(*) FROM spl WHERE split = 'test') AS n, (SELECT count(*) FROM spl WHERE split = 'test') AS repeated",
    "materialize_labels": "SELECT 'doc-' || d.doc_id AS sample_id, quality AS target, lang AS language, 'human' AS target_source FROM documents d JOIN labels l ON l.doc_id = d.doc_id",
    "class_balance": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels), m AS (SELECT max(n) AS most FROM r),
 c AS (SELECT quality, doc_id, unnest(range(0, most // n + CASE WHEN k < most % n THEN 1 ELSE 0 END)) AS copy FROM r, m) SELECT quality, count(*) AS n, sum(copy)::BIGINT AS copies, sum(doc_id)::BIGINT AS ids FROM c GROUP BY 1""",
    "hard_negative_weights": "SELECT event_type = 'error' AS hard, sum(CASE WHEN event_type = 'error' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM events GROUP BY 1",
    "soft_targets": W + V.DRAFTS + " SELECT doc_id, round(avg(p), 6) AS soft_target FROM drafts GROUP BY 1",
    "redact_secret_email": f"SELECT doc_id, {REDACT.format('text')} AS redacted, {REDACT.format('text')} <> text AS changed FROM documents",
    "normalize_state": f"SELECT doc_id, sha256({NORMAL.format('text')}) AS state_sha256 FROM documents",
    "casefold_normalize": f"SELECT doc_id, sha256({NORMAL.format(FOLD.format('text'))}) AS prompt_sha256 FROM documents",
    "state_cache_key": f"SELECT doc_id, {STATE_KEY} AS key FROM documents",
    "result_cache_key": f"SELECT doc_id, sha256('{{\"calibration_version\": \"c1\", \"kind\": \"result\", \"model_version\": \"m1\", \"question_key\": \"' || {QUESTION_KEY} || '\", \"state_key\": \"' || {STATE_KEY} || '\"}}') AS key FROM documents",
    "request_ids": "SELECT conv_id, turn, 'req-' || substr(sha256(conv_id || '/' || turn), 1, 24) AS request_id FROM conversations",
    "hashed_tokens": f"""WITH t AS (SELECT item_id, regexp_extract_all({FOLD.format('text')}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')[:1024] AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS pos FROM t)
 SELECT item_id, pos, 2 + {_H('w')} % 4094 AS token FROM u""",
}

_words = lambda t: f"regexp_extract_all({FOLD.format(t)}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')"
_fid = lambda t, v: f"(2 + {_H(t)} % {v - 2})"
_GRAMS = "flatten([flatten([[substr('^' || w || '$', i, n) for i in range(1, length(w) + 4 - n)] for n in [2, 3, 4, 5]]) for w in w])"
_SPACED = "array_to_string(({0})[:1024], ' ')"
SQL |= {
    "byte_features": """WITH b AS (SELECT item_id, hex(encode(text)) AS h, least(1024, octet_length(encode(text))) AS n FROM benchmark), i AS (SELECT item_id, n, [2 + ('0x' || substr(h, 2 * k + 1, 2))::INT % 256 for k in range(n)] AS ids FROM b)
 SELECT item_id, array_to_string(list_concat(ids, [0 for k in range(1024 - n)]), ' ') AS ids, array_to_string(list_concat([1 for k in range(n)], [0 for k in range(1024 - n)]), ' ') AS mask FROM i""",
    "char_ngram_features": f"WITH t AS (SELECT item_id, {_words('text')} AS w FROM benchmark), g AS (SELECT item_id, {_GRAMS} AS g FROM t) SELECT item_id, " + _SPACED.format(f"[{_fid('x', 4096)} for x in g]") + " AS ids FROM g",
    "hybrid_features": f"WITH t AS (SELECT item_id, {_words('text')} AS w FROM benchmark), g AS (SELECT item_id, w, {_GRAMS} AS g FROM t) SELECT item_id, "
    + _SPACED.format(f"list_concat([{_fid(chr(39) + 'w:' + chr(39) + ' || x', 2048)} for x in w], [{_fid(chr(39) + 'c:' + chr(39) + ' || x', 2048)} + 2046 for x in g])") + " AS ids FROM g",
    "segmented_features": f"WITH t AS (SELECT item_id, {_words('text')} AS w, {_words(chr(39) + QUESTION + chr(39))} AS q FROM benchmark) SELECT item_id, "
    + _SPACED.format(f"list_concat([{_fid(chr(39) + 's:' + chr(39) + ' || x', 2048)} for x in w], [{_fid(chr(39) + 'q:' + chr(39) + ' || x', 2048)} + 2046 for x in q])") + " AS ids FROM t",
}
