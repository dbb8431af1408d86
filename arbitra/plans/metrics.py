"""Queries and SQL of quality, calibration and selective-prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, metrics
from ..sources import adapters as A
from . import views as V

BY = ["provider"]


def _choice(spark, d):
    return metrics.choice_rows(A.choice_predictions(spark, d), ["event_id"])


def _accepted(spark, d):
    return A.binary_predictions(spark, d).withColumn("accepted", F.col("confidence") >= 0.9)


QUERIES = {
    "binary_metrics": lambda s, d: metrics.binary_metrics(A.binary_predictions(s, d), BY),
    "binary_ece": lambda s, d: metrics.ece(A.binary_predictions(s, d), BY),
    "binary_adaptive_ece": lambda s, d: metrics.adaptive_ece(A.binary_predictions(s, d), BY, ["doc_id"]),
    "binary_auroc": lambda s, d: metrics.auroc(A.binary_predictions(s, d), BY),
    "binary_auprc": lambda s, d: metrics.auprc(A.binary_predictions(s, d), BY, ["doc_id"]),
    "risk_coverage_curve": lambda s, d: metrics.risk_coverage_curve(A.binary_predictions(s, d), BY, ["doc_id"]),
    "threshold_risk_coverage": lambda s, d: metrics.threshold_risk_coverage(A.binary_predictions(s, d), BY),
    "choice_metrics": lambda s, d: metrics.choice_metrics(_choice(s, d), []),
    "choice_class_report": lambda s, d: metrics.class_report(_choice(s, d)),
    "choice_macro_f1": lambda s, d: metrics.macro_f1(_choice(s, d)),
    "skill_confusion": lambda s, d: metrics.confusion(_choice(s, d), A.EVENT_TYPES),
    "score_metrics": lambda s, d: metrics.score_metrics(A.score_predictions(s, d), ["grp"]),
    "score_spearman": lambda s, d: metrics.spearman(A.score_predictions(s, d), ["grp"]),
    "latency_percentiles": lambda s, d: metrics.latency_report(A.drafts(s, d), BY),
    "summary_grouping_sets": lambda s, d: metrics.accuracy_summary(_accepted(s, d), "provider"),
    "wilson_interval": lambda s, d: gates.accuracy_with_bounds(A.binary_predictions(s, d), BY),
    "provider_health": lambda s, d: A.drafts(s, d).groupBy("provider").agg(
        F.count("*").alias("records"), F.count_if("schema_valid").alias("schema_valid"), F.count_if(~F.col("schema_valid")).alias("errors"),
        F.round(F.avg(F.col("schema_valid").cast("double")), 4).alias("valid_rate"), F.sum("tokens").cast("bigint").alias("tokens"),
    ),
    "provider_agreement": lambda s, d: _agreement(A.drafts(s, d)),
    "teacher_draft_quality": lambda s, d: _draft_quality(s, d),
}


def _agreement(drafts):
    """Of samples with two valid providers, the share whose results are all equal."""
    n = drafts.filter("schema_valid").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("value").alias("k")).filter("n >= 2")
    return n.agg(F.count("*").alias("samples"), F.count_if(F.col("k") == 1).alias("agreed")).withColumn(
        "rate", F.round(F.coalesce(F.try_divide(F.col("agreed").cast("double"), F.col("samples").cast("double")), F.lit(0.0)), 6)
    )


def _draft_quality(spark, d):
    """Per provider: valid, correct and repaired drafts of labelled documents; interpolated median latency."""
    labels = A.table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("label"))
    right = F.col("schema_valid") & (F.col("value") == F.col("label"))
    n = A.drafts(spark, d).join(labels, "doc_id").groupBy("provider").agg(
        F.count("*").alias("n"), F.count_if("schema_valid").alias("valid"), F.count_if(right).alias("correct"), F.count_if("repaired").alias("repaired"), F.round(F.percentile("latency_ms", 0.5), 3).alias("median_latency"),
    )
    return n.withColumn("accuracy_on_valid", F.round(F.try_divide(F.col("correct").cast("double"), F.col("valid").cast("double")), 6))


W = "WITH "
SQL = {
    "binary_metrics": W + V.BINARY + """, c AS (SELECT provider, count(*) AS n, count(*) FILTER (p >= .5 AND label) AS tp, count(*) FILTER (p >= .5 AND NOT label) AS fp, count(*) FILTER (p < .5 AND label) AS fn,
 count(*) FILTER (p < .5 AND NOT label) AS tn, round(avg(power(p - label::INT, 2)), 6) AS brier, round(avg(-ln(greatest(CASE WHEN label THEN p ELSE 1 - p END, 1e-12))), 6) AS nll FROM pred GROUP BY 1)
 SELECT provider, n, round((tp + tn) / n::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, brier, nll FROM c""",
    "binary_ece": W + V.BINARY + """, b AS (SELECT provider, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg(label::INT) AS a FROM pred GROUP BY 1, 2)
 SELECT provider, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b GROUP BY 1""",
    "binary_adaptive_ece": W + V.BINARY + """, r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY p, doc_id) AS r, count(*) OVER (PARTITION BY provider) AS n FROM pred),
 b AS (SELECT provider, (r * least(10, n) - 1) // n AS bin, count(*) AS k, avg(p) AS c, avg(label::INT) AS a FROM r GROUP BY 1, 2) SELECT provider, round(sum(k * abs(a - c)) / sum(k), 6) AS adaptive_ece FROM b GROUP BY 1""",
    "binary_auroc": W + V.BINARY + """ SELECT a.provider, round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auroc FROM pred a JOIN pred b ON a.provider = b.provider AND a.label AND NOT b.label GROUP BY 1""",
    "binary_auprc": W + V.BINARY + """, r AS (SELECT provider, label::INT AS y, row_number() OVER o AS r, sum(label::INT) OVER o AS c FROM pred WINDOW o AS (PARTITION BY provider ORDER BY p DESC, doc_id))
 SELECT provider, round(sum(y * c / r::DOUBLE) / sum(y), 6) AS auprc FROM r GROUP BY 1""",
    "risk_coverage_curve": W + V.BINARY + """ SELECT provider, doc_id, row_number() OVER o AS position, round(row_number() OVER o / (count(*) OVER (PARTITION BY provider))::DOUBLE, 6) AS coverage,
 round(1 - (sum(correct::INT) OVER o) / (row_number() OVER o)::DOUBLE, 6) AS risk, round(confidence, 6) AS threshold FROM pred WINDOW o AS (PARTITION BY provider ORDER BY confidence DESC, doc_id)""",
    "threshold_risk_coverage": W + V.BINARY + """, t AS (SELECT unnest([0.5, 0.7, 0.8, 0.9, 0.95, 0.99])::DOUBLE AS threshold), c AS (SELECT provider, threshold, count(*) AS n, count(*) FILTER (confidence >= threshold) AS accepted,
 count(*) FILTER (confidence >= threshold AND correct) AS r FROM pred, t GROUP BY 1, 2) SELECT provider, threshold, accepted, round(accepted / n::DOUBLE, 6) AS coverage, round(r / nullif(accepted, 0)::DOUBLE, 6) AS accuracy,
 round(1 - round(r / nullif(accepted, 0)::DOUBLE, 6), 6) AS risk FROM c""",
    "choice_metrics": W + V.CHOICE + """ SELECT count(*) AS n, round(avg((selected = label)::INT), 6) AS accuracy, round(avg((selected = label OR second = label)::INT), 6) AS top2_accuracy, round(avg(squares), 6) AS brier,
 round(avg(-ln(greatest(coalesce(p_label, 0), 1e-12))), 6) AS nll FROM rws""",
    "choice_class_report": W + V.CHOICE + """, c AS (SELECT class, sum(l)::BIGINT AS support, sum(s)::BIGINT AS predicted, sum(h)::BIGINT AS hits FROM (SELECT label AS class, 1 AS l, 0 AS s, (label = selected)::INT AS h FROM rws UNION ALL SELECT selected, 0, 1, 0 FROM rws) GROUP BY 1)
 SELECT class, support, predicted, hits, round(coalesce(hits / nullif(predicted, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(hits / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(2 * hits / (support + predicted)::DOUBLE, 6) AS f1 FROM c""",
    "choice_macro_f1": W + V.CHOICE + """, c AS (SELECT class, sum(l) AS support, sum(s) AS predicted, sum(h) AS hits FROM (SELECT label AS class, 1 AS l, 0 AS s, (label = selected)::INT AS h FROM rws UNION ALL SELECT selected, 0, 1, 0 FROM rws) GROUP BY 1)
 SELECT count(*) AS classes, round(avg(2 * hits / (support + predicted)::DOUBLE), 6) AS macro_f1 FROM c""",
    "skill_confusion": W + V.CHOICE + """, k AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS c) SELECT t.c AS target, s.c AS predicted, count(r.event_id) AS n FROM k t CROSS JOIN k s LEFT JOIN rws r ON r.label = t.c AND r.selected = s.c GROUP BY 1, 2""",
    "score_metrics": W + V.SCORE + """ SELECT grp, count(*) AS n, round(avg(abs(value - target)), 6) AS mae, round(sqrt(avg(power(value - target, 2))), 6) AS rmse, round(avg((target BETWEEN lower AND upper)::INT), 6) AS interval_coverage,
 round(avg(upper - lower), 6) AS mean_width FROM sc GROUP BY 1""",
    "score_spearman": W + V.SCORE + """, r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY target) + (count(*) OVER (PARTITION BY grp, target) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY grp ORDER BY value) + (count(*) OVER (PARTITION BY grp, value) - 1) / 2.0::DOUBLE AS b FROM sc)
 SELECT grp, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""",
    "latency_percentiles": W + V.DRAFTS + """ SELECT provider, count(*) AS n, round(quantile_disc(latency_ms, 0.5), 3) AS p50, round(quantile_disc(latency_ms, 0.95), 3) AS p95, round(quantile_disc(latency_ms, 0.99), 3) AS p99, round(max(latency_ms), 3) AS max,
 round(avg(latency_ms), 3) AS mean FROM drafts GROUP BY 1""",
    "summary_grouping_sets": W + V.BINARY + """, g AS (SELECT coalesce(provider, 'all') AS grp, count(*) AS n, count(*) FILTER (correct) AS r, count(*) FILTER (confidence >= .9) AS a, count(*) FILTER (confidence >= .9 AND correct) AS ar FROM pred GROUP BY GROUPING SETS ((provider), ()))
 SELECT grp, n, round(r / n::DOUBLE, 6) AS accuracy, round(a / n::DOUBLE, 6) AS coverage, round(ar / nullif(a, 0)::DOUBLE, 6) AS accepted_accuracy FROM g""",
    "wilson_interval": W + V.BINARY + """, c AS (SELECT provider, count(*) AS n, count(*) FILTER (correct) AS x, 1.959963984540054::DOUBLE AS z FROM pred GROUP BY 1) SELECT provider, n, x AS "right", round(x / n::DOUBLE, 6) AS accuracy,
 round(greatest(0, (x + z * z / 2 - z * sqrt(x * (n - x) / n::DOUBLE + z * z / 4)) / (n + z * z)), 6) AS lower, round(least(1, (x + z * z / 2 + z * sqrt(x * (n - x) / n::DOUBLE + z * z / 4)) / (n + z * z)), 6) AS upper FROM c""",
    "provider_health": W + V.DRAFTS + """ SELECT provider, count(*) AS records, count(*) FILTER (schema_valid) AS schema_valid, count(*) FILTER (NOT schema_valid) AS errors, round(avg(schema_valid::INT), 4) AS valid_rate, sum(tokens)::BIGINT AS tokens FROM drafts GROUP BY 1""",
    "provider_agreement": W + V.DRAFTS + """, g AS (SELECT doc_id, count(DISTINCT value) AS k FROM drafts WHERE schema_valid GROUP BY 1 HAVING count(*) >= 2) SELECT count(*) AS samples, count(*) FILTER (k = 1) AS agreed, round(count(*) FILTER (k = 1) / count(*)::DOUBLE, 6) AS rate FROM g""",
    "teacher_draft_quality": W + V.DRAFTS + """ SELECT provider, count(*) AS n, count(*) FILTER (schema_valid) AS valid, count(*) FILTER (schema_valid AND value = (quality = 1)) AS correct, count(*) FILTER (repaired) AS repaired, round(quantile_cont(latency_ms, 0.5), 3) AS median_latency,
 round(count(*) FILTER (schema_valid AND value = (quality = 1)) / nullif(count(*) FILTER (schema_valid), 0)::DOUBLE, 6) AS accuracy_on_valid FROM drafts d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""",
}
