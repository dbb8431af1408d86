"""A run that is stopped and started again gives what one whole run gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arbitra.operators.drafting import Drafts


def queue(spark, n=60):
    return spark.range(n).select(F.concat(F.lit("s"), F.col("id")).alias("sample_id"), (F.col("id") % 3).alias("lang"))


class Teacher:
    """Every third answer is invalid, but never a third one; counts what it is asked for."""

    def __init__(self, fail_at=None):
        self.asked, self.calls, self.fail_at = [], 0, fail_at

    def __call__(self, rows):
        self.calls += 1
        if self.calls == self.fail_at:
            raise RuntimeError("teacher lost")
        self.asked += [(r["sample_id"], r["attempt"]) for r in rows.select("sample_id", "attempt").collect()]
        h = F.pmod(F.xxhash64("sample_id", "attempt"), F.lit(3))
        return rows.select("sample_id", "attempt", ((h != 0) | (F.col("attempt") == 3)).alias("schema_valid"), F.concat("sample_id", F.lit("/"), "attempt").alias("answer"))


def result(d):
    return sorted(map(tuple, d.drafts().select("sample_id", "attempt", "schema_valid", "answer").collect()))


def test_stopped_and_started_again(spark, tmp_path):
    q = queue(spark)
    whole, teacher = Drafts(spark, f"{tmp_path}/whole", "t", "answer string"), Teacher()
    whole.run(q, teacher, attempts=3, chunks=4)
    assert len(set(teacher.asked)) == len(teacher.asked) and {a for _, a in teacher.asked} == {1, 2, 3}
    assert whole.summary(q).first().asDict() == {"samples": 60, "valid": 60, "invalid": 0, "pending": 0}
    asked = []
    for fail_at in (3, 2, None):
        part, teacher = Drafts(spark, f"{tmp_path}/part", "t", "answer string"), Teacher(fail_at)
        if fail_at:
            with pytest.raises(RuntimeError):
                part.run(q, teacher, attempts=3, chunks=4)
        else:
            part.run(q, teacher, attempts=3, chunks=4)
        asked += teacher.asked
    assert result(part) == result(whole) and sorted(asked) == sorted(set(asked))
    assert part.run(q, Teacher(1), attempts=3, chunks=4) == 0  # nothing is left to ask for


def test_bounds_and_bindings(spark, tmp_path):
    q, path = queue(spark, 12), f"{tmp_path}/d"
    d = Drafts(spark, path, "t", "answer string")
    assert d.summary(q).first()["pending"] == 12
    assert d.run(q, Teacher(), attempts=1, chunks=3, stop_after=1) == 1 and 0 < d.drafts().count() < 12
    with pytest.raises(ValueError, match="another queue"):
        Drafts(spark, path, "t", "answer string").run(queue(spark, 13), Teacher())
    with pytest.raises(ValueError, match="another provider"):
        Drafts(spark, path, "u", "answer string").run(q, Teacher())
    with pytest.raises(ValueError):
        d.run(q, Teacher(), attempts=0)
    d.run(q, Teacher(), attempts=1, chunks=3)
    once = result(d)
    assert {r[1] for r in once} == {1} and any(not r[2] for r in once)
    d.run(q.unionByName(q.limit(0)), Teacher(), attempts=3)
    assert all(r[2] for r in result(d)) and [r for r in result(d) if r[1] == 1] == [r for r in once if r[2]]


def test_empty_queue(spark, tmp_path):
    d = Drafts(spark, f"{tmp_path}/e", "t", "answer string")
    assert d.run(queue(spark, 0), Teacher()) == 0 and d.drafts().count() == 0
