"""Hand-computed values of the metrics."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arbitra.functions import stats
from arbitra.operators import gates, metrics
from arbitra.operators.ranking import ranked

ROWS = [(0, True, 0.9), (1, False, 0.8), (2, True, 0.6), (3, False, 0.3)]


@pytest.fixture
def binary(spark):
    df = spark.createDataFrame(ROWS, "id int, label boolean, p double")
    return df.withColumn("g", F.lit("x")).withColumn("confidence", F.greatest("p", 1 - F.col("p"))).withColumn("correct", (F.col("p") >= 0.5) == F.col("label"))


def one(df):
    return df.drop("g").first().asDict()


def test_binary(binary):
    got = one(metrics.binary_metrics(binary, ["g"]))
    assert got == {"n": 4, "accuracy": 0.75, "precision": 0.666667, "recall": 1.0, "f1": 0.8, "brier": 0.225, "nll": 0.645575}
    assert one(metrics.ece(binary, ["g"]))["ece"] == 0.4
    assert one(metrics.auroc(binary, ["g"]))["auroc"] == 0.75
    assert one(metrics.auprc(binary, ["g"], ["id"]))["auprc"] == 0.833333
    assert metrics.risk_coverage_curve(binary, ["g"], ["id"]).count() == 4


def test_one_class_has_no_auroc(binary):
    assert one(metrics.auroc(binary.filter("label"), ["g"]))["auroc"] is None
    assert metrics.auroc(binary.filter("false"), ["g"]).count() == 0


def test_adaptive_bins_hold_equal_numbers(spark):
    n, b = 7, 3
    df = spark.createDataFrame([(i, i / 10, True) for i in range(n)], "id int, p double, label boolean").withColumn("g", F.lit(1))
    at = ranked(df, ["g"], "p", ["id"], ascending=True)
    sizes = at.withColumn("bin", F.floor((F.col("rank") * b - 1) / F.col("of"))).groupBy("bin").count().orderBy("bin").collect()
    assert [r["count"] for r in sizes] == [2, 2, 3]


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101 / 101.0).alias("p"), "id", (F.col("id") % 2).alias("v"))
    results = []
    for n in ("1", "3", "16"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, ranked(df, ["g"], "p", ["id"], "v").select("id", "rank", "cumulative", "of").collect())))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_thresholds(spark):
    df = spark.createDataFrame([(True, 0.99), (False, 0.95), (True, 0.75), (False, 0.40)], "correct boolean, confidence double").withColumn("g", F.lit(1))
    rows = {r["threshold"]: r for r in metrics.threshold_risk_coverage(df, ["g"], (0.5, 0.9, 0.99, 1.0)).collect()}
    assert (rows[0.5]["coverage"], rows[0.5]["accuracy"], rows[0.5]["risk"]) == (0.75, 0.666667, 0.333333)
    assert (rows[0.9]["accepted"], rows[0.9]["accuracy"]) == (2, 0.5)
    assert (rows[0.99]["accepted"], rows[0.99]["accuracy"]) == (1, 1.0)
    assert (rows[1.0]["accepted"], rows[1.0]["accuracy"]) == (0, None)


def test_choice(spark):
    maps = [("a", {"a": 0.8, "b": 0.1, "c": 0.1}), ("b", {"a": 0.1, "b": 0.4, "c": 0.5}), ("c", {"a": 0.2, "b": 0.6, "c": 0.2})]
    df = spark.createDataFrame([(i, y, k, p) for i, (y, m) in enumerate(maps) for k, p in m.items()], "id int, label string, class string, p double")
    rows = metrics.choice_rows(df, ["id"])
    got = metrics.choice_metrics(rows, []).first()
    assert (got["accuracy"], got["top2_accuracy"]) == (0.333333, 0.666667)
    assert metrics.macro_f1(rows).first()["macro_f1"] == 0.333333
    assert metrics.confusion(rows, ("a", "b", "c")).count() == 9


def test_score(spark):
    df = spark.createDataFrame([(0.5, 0.4, 0.3, 0.55), (0.9, 0.8, 0.7, 0.95)], "target double, value double, lower double, upper double").withColumn("g", F.lit(1))
    got = metrics.score_metrics(df, ["g"]).first()
    assert (got["mae"], got["rmse"], got["interval_coverage"], got["mean_width"]) == (0.1, 0.1, 1.0, 0.25)
    assert metrics.spearman(df, ["g"]).first()["spearman"] == 1.0
    assert metrics.spearman(df.withColumn("value", F.lit(0.5)), ["g"]).first()["spearman"] is None


@pytest.mark.parametrize(("x", "n", "lower"), [(384, 384, 0.990095), (383, 384, 0.985398), (500, 500, 0.992376), (0, 0, None)])
def test_wilson(spark, x, n, lower):
    assert spark.range(1).select(stats.wilson(F.lit(x), F.lit(n))[0].alias("l")).first()["l"] == lower


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "latency_ms double").withColumn("g", F.lit(1))
    got = metrics.latency_report(df, ["g"]).first()
    assert (got["p50"], got["p95"], got["max"], got["mean"]) == (3.0, 5.0, 5.0, 3.0)


def test_temperature(spark):
    df = spark.createDataFrame([([3.0, 0.0], 0), ([2.0, 0.0], 0), ([0.2, 1.0], 1), ([0.0, 2.0], 1)], "logits array<double>, label int")
    got = gates.fit_temperature(df, []).first()
    assert got["temperature"] == 0.25 and got["status"] == "fitted"
    assert gates.fit_temperature(df, [], minimum_samples=5).first()["temperature"] is None


def test_gates_fail_closed(spark):
    df = spark.createDataFrame([("split_accuracy", "a", 0.995), ("split_accuracy", "b", None), ("split_accuracy", "c", float("nan")), ("false_stop_rate", "d", 0.01), ("unknown", "e", 1.0)], "gate string, subject string, value double")
    assert {r["subject"]: r["failed"] for r in gates.gate_rows(df).collect()} == {"a": False, "b": True, "c": True, "d": True, "e": True}
