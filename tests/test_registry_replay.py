"""A registry's log replayed at once against one entry after the other."""

from __future__ import annotations

import random

import pytest

from arbitra.operators import registry as R


def one_by_one(models, log):
    status = dict(models)
    active = next((m for m, s in models if s == "active"), None)
    out = []
    for seq, m, action, target in sorted(log):
        now, error = status.get(m), None
        target = "active" if action == "rollback" else target
        if action == "register":
            error = "registered_already" if now else "unsupported_status" if target not in R.STATUSES else None
        elif target not in R.STATUSES:
            error = "unsupported_status"
        elif now is None:
            error = "unknown_model"
        elif action == "rollback" and now not in R.BACK_FROM:
            error = "rollback_status"
        elif (now, target) not in R.EDGES:
            error = "not_allowed"
        if error is None:
            if target == "active" and action != "register":
                if active not in (None, m):
                    status[active] = "retired"
                active = m
            status[m] = target
        out.append((seq, m, action, now, target, error))
    return status, out


@pytest.mark.parametrize("seed", [1])
def test_equals_one_by_one(spark, seed):
    r = random.Random(seed)
    names = [f"m{i}" for i in range(7)]
    models = [("m0", "active"), ("m1", "retired"), ("m2", "canary"), ("m3", "candidate")]
    log = [(i * 3, r.choice(names), r.choice(["register", "transition", "transition", "rollback", "rollback"]), r.choice([*R.STATUSES, "active", "canary", "odd", None])) for i in range(250)]
    status, want = one_by_one(models, log)
    df = spark.createDataFrame(log, "seq long, model_id string, action string, target string").repartition(5)
    after, outcomes = R.replay(spark.createDataFrame(models, "model_id string, status string"), df)
    assert {r["model_id"]: r["status"] for r in after.collect()} == status
    assert sorted(map(tuple, outcomes.collect())) == want
    assert sum(s == "active" for s in status.values()) >= 1 and sum(x[5] is None for x in want) > 30


def test_empty(spark):
    none = spark.createDataFrame([], "seq long, model_id string, action string, target string")
    after, outcomes = R.replay(spark.createDataFrame([("a", "trained")], "model_id string, status string"), none)
    assert list(map(tuple, after.collect())) == [("a", "trained")] and outcomes.count() == 0


@pytest.mark.parametrize("chunk", [1, 60, 100_000])
def test_rounds(spark, chunk):
    """However the log is cut, a long one takes few tables: a round settles a chunk at least."""
    r = random.Random(chunk)
    names = [f"m{i}" for i in range(9)] + [None]
    models = [("m0", "active"), ("m1", "canary"), ("away", "candidate")]
    log = [(i * 2, r.choice(names), r.choice(["register", "transition", "transition", "rollback"]), r.choice([*R.STATUSES, "active", "canary", "odd", None])) for i in range(3000)]
    status, want = one_by_one(models, log)
    df = spark.createDataFrame(r.sample(log, len(log)), "seq long, model_id string, action string, target string").repartition(3)
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    before = jobs()
    after, outcomes = R.replay(spark.createDataFrame(models, "model_id string, status string"), df, chunk)
    assert jobs() - before < 90
    assert {x["model_id"]: x["status"] for x in after.collect()} == status
    assert sorted(map(tuple, outcomes.collect())) == want


def test_one_chunk(spark):
    """A log of one chunk is carried out in one go: counted once, then read where it is."""
    models = spark.createDataFrame([("m0", "active"), ("m1", "canary"), ("away", "candidate")], "model_id string, status string")
    log = [(i * 2, f"m{i % 5}", ("register", "transition", "rollback")[i % 3], (*R.STATUSES, "odd")[i * 5 % 8]) for i in range(200)]
    status, want = one_by_one([("m0", "active"), ("m1", "canary"), ("away", "candidate")], log)
    df = spark.createDataFrame(log[::-1], "seq long, model_id string, action string, target string").repartition(3)
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    before = jobs()
    after, outcomes = R.replay(models, df, len(log))
    assert jobs() - before < 4
    assert {x["model_id"]: x["status"] for x in after.collect()} == status
    assert sorted(map(tuple, outcomes.collect())) == want
