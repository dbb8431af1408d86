"""Dataset gates, review and routing on tiny tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.operators import control as K
from arbitra.operators import dataset as D
from arbitra.operators import gates, models, registry
from arbitra.operators import review as R
from arbitra.operators import routing as G


def test_outcomes(spark):
    # private, invalid, duplicate, human, schema_ok, same, confidence a, confidence b
    rows = [
        (False, False, False, None, True, True, 0.9, 0.9, "accepted_silver"), (False, False, True, None, True, True, 0.9, 0.9, "excluded_duplicate"), (False, False, False, None, True, False, 0.9, 0.9, "review_disagreement"),
        (False, False, False, True, False, False, 0.1, 0.1, "accepted_human"), (True, False, False, True, True, True, 0.9, 0.9, "excluded_privacy"), (False, False, False, None, True, True, 0.4, 0.49, "excluded_low_confidence"),
        (False, False, False, None, True, True, 0.55, 0.95, "review_disagreement"), (False, False, False, None, False, True, 0.9, 0.9, "review_schema_invalid"), (True, True, False, None, True, True, 0.9, 0.9, "review_invalid_seed"),
    ]
    df = spark.createDataFrame(rows, "p boolean, i boolean, d boolean, h boolean, s boolean, l boolean, a double, b double, want string")
    got = df.select("want", D.outcome(*map(F.col, ("p", "i", "d", "h", "s", "l", "a", "b"))).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_privacy_precedence(spark):
    df = spark.createDataFrame([("SECRET", "document", True), ("public", "user", True), ("public", None, False), (None, None, False)], "s string, k string, want boolean")
    assert all(r["want"] == r["got"] for r in df.select("want", D.private(F.col("s"), F.col("k")).alias("got")).collect())
    assert df.select(D.private(F.col("s"), F.col("k"), True).alias("x")).filter("x").count() == 1


def test_leaks(spark):
    df = spark.createDataFrame([("1", "train", "same state"), ("2", "test", "  SAME   STATE "), ("3", "train", "other")], "sample_id string, split string, state string")
    got = D.leaks(df.withColumn("k", D.normalize_prompt("state")), ["k"], "exact").collect()
    assert [(r["first_id"], r["members"], r["splits"]) for r in got] == [("1", 2, "test,train")]


def test_balance(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "id long, y string")
    n = {r["y"]: r["n"] for r in D.balance(df, "y", "id").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 7, "b": 7}


def test_soft_targets(spark):
    df = spark.createDataFrame([({"a": 0.6, "b": 0.4}, {"a": 0.2, "c": 0.8})], "x map<string,double>, y map<string,double>")
    assert df.select(D.soft_choice(F.col("x"), F.col("y")).alias("s")).first()["s"] == {"a": 0.4, "b": 0.2, "c": 0.4}


def test_latest_and_first(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 3, "z"), (1, 2, "y"), (2, 5, None)], "sample_id int, seq int, v string")
    assert sorted(map(tuple, R.latest_feedback(df).collect())) == [(1, 3, "z"), (2, 5, None)]
    assert sorted(map(tuple, D.first_wins(df, ["sample_id"], "seq").collect())) == [(1, 1, "x"), (2, 5, None)]


def test_priority_order(spark):
    rows = [("high", "g1", True, False, 0.9), ("low", "g2", True, False, 0.3), ("fixed", "g3", True, True, 0.9), ("bad", "g4", False, False, 0.9)]
    df = spark.createDataFrame(rows, "sample_id string, group string, schema_valid boolean, repaired boolean, confidence double").withColumns(
        {"signature": F.lit("boolean:true"), "action": F.lit(None).cast("string"), "student_confidence": F.lit(1.0), "student_disagrees": F.lit(False)}
    )
    assert [r["sample_id"] for r in R.review_priority(df).collect()] == ["bad", "fixed", "low", "high"]


def test_dual_review(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, None, "b"), (4, None, None)], "sample_id int, a string, b string")
    assert {r["status"]: r["n"] for r in R.dual_counts(df).collect()} == {"agreed": 1, "disagreement": 1, "missing_a": 1, "missing_both": 1}
    assert {r["action"]: (r["agreed"], r["disagreed"], r["rate"]) for r in R.dual_actions(df).collect()} == {"a": (1, 1, 0.5), "b": (0, 1, 0.0)}
    assert R.dual_gate(df).first()["passed"] is False
    ruled = spark.createDataFrame([(2, "b")], "sample_id int, label string")
    assert sorted(map(tuple, R.finalize(df, ruled).collect())) == [(1, "a", "agreed"), (2, "b", "adjudicated")]


def test_rules(spark):
    texts = [
        ("memory.remember_worthy", "I don't want this", "remember.explicit_rejection"), ("memory.remember_worthy", "hello there", "remember.greeting_only"), ("memory.remember_worthy", "hello, I prefer tea", "remember.explicit_commitment"),
        ("memory.remember_worthy", "which way", "remember.greeting_only"), ("memory.remember_worthy", "zzz", None), ("wiki.semantic_change", "new title", "wiki.style_only"), ("wiki.semantic_change", "It was updated", "wiki.factual_change"),
        ("wiki.semantic_change", "exchanged", None), ("other", "hello", None),
    ]
    df = spark.createDataFrame(texts, "task string, state string, want string")
    rows = df.select("want", G.rule_match(F.col("task"), F.col("state"))["rule_id"].alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_cascade(spark):
    rows = [(True, True, False, True, "first", True, False), (True, False, False, True, "second", False, False), (True, False, True, False, "human", True, True), (None, False, None, False, "human", None, True)]
    df = spark.createDataFrame(rows, "v1 boolean, a1 boolean, v2 boolean, a2 boolean, route string, value boolean, abstained boolean")
    out = df.withColumn("o", G.cascade([("first", F.col("v1"), F.col("a1")), ("second", F.col("v2"), F.col("a2"))])).collect()
    assert [(r["o"]["route"], r["o"]["value"], r["o"]["abstained"]) for r in out] == [(r["route"], r["value"], r["abstained"]) for r in out]


def test_drift(spark):
    schema = "route string, abstained boolean, confidence double"
    got = {r["measure"]: r for r in G.drift(spark.createDataFrame([("rule", False, 0.9)], schema), spark.createDataFrame([("human", True, 0.1)], schema)).collect()}
    assert got["abstain_rate"]["shift"] == 1.0 and all(r["drifted"] for r in got.values())
    assert G.drift(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).first()["shift"] == 0.0


def test_safety_chain(spark):
    rows = [(1100.0, 1000.0, False, False, 0.95, 50, None), (1101.0, 1000.0, False, False, 0.95, 50, "stale_observation"), (999.0, 1000.0, True, False, 0.95, 50, "invalid_clock"), (1001.0, 1000.0, True, True, 0.1, 500, "emergency_stop"), (1001.0, 1000.0, False, False, 0.95, 101, "action_ttl_exceeded"), (float("nan"), 1000.0, False, False, 0.95, 50, "invalid_clock")]
    df = spark.createDataFrame(rows, "n double, t double, e boolean, a boolean, c double, l int, want string")
    got = df.select("want", K.safety_policy(*map(F.col, "nteacl")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_phrases(spark):
    rows = [("The Corridor is  CLEAR for forward motion", "MOVE"), ("clear path but the path is blocked", None), ("press the button and grasp the handle", "INTERACT"), ("clear path; wait in place until sensors refresh", None), ("plain", None)]
    df = spark.createDataFrame(rows, "s string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", K.phrase_skill(F.col("s")).alias("got")).collect())


def test_matrices(spark):
    stops = K.safety_matrix(spark, 500)
    reasons = stops.select(K.decide(F.lit("plain"), F.col("now_ms"), F.col("timestamp_ms"), F.col("emergency_stop"), F.lit("HOLD"), F.lit(0.99), F.lit(False)).alias("d"), "expected_reason")
    assert reasons.filter("d.skill <> 'STOP' or d.reason <> expected_reason").count() == 0
    near = K.near_miss_matrix(spark, 500)
    got = near.select(K.decide(F.col("state"), F.col("now_ms"), F.col("timestamp_ms"), F.lit(False), F.lit("STOP"), F.lit(0.99), F.lit(False)).alias("d"), "expected_skill")
    assert got.filter("d.skill <> expected_skill").count() == 0
    assert K.review_queue(spark, 10).groupBy("target").count().filter("count = 10").count() == 8


def test_lifecycle(spark):
    df = spark.createDataFrame([("m", "canary", "active"), ("n", "trained", "active")], "model_id string, status string, to_status string")
    got = {r["model_id"]: r["allowed"] for r in gates.transitions(df.select("model_id", "status"), df.select("model_id", "to_status")).collect()}
    assert got == {"m": True, "n": False}
    after, event = registry.change(spark.createDataFrame([("m", "canary"), ("o", "active")], "model_id string, status string"), "m", "active")
    assert {r["model_id"]: r["status"] for r in after.collect()} == {"m": "active", "o": "retired"} and event.first()["error"] is None


def test_heads(spark):
    rows = [(f"go forward {i}", "MOVE", 0.9) for i in range(20)] + [(f"stay still {i}", "HOLD", 0.1) for i in range(20)]
    df = spark.createDataFrame(rows, "state string, target string, y double")
    out = models.predict_choice(models.train_choice(df, features=256), df)
    assert out.filter("selected <> target").count() == 0
    scored = models.predict_score(models.train_score(df, target="y", features=256), df)
    assert scored.filter("abs(score - y) > 0.3").count() == 0
