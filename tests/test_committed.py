"""Appends that appear whole or not at all."""

from __future__ import annotations

import glob
import json

import pytest
from pyspark.sql import functions as F

from arbitra.sources import committed as C

SCHEMA = "a string, b long, c string"


def rows(spark, low, high, parts=4):
    return spark.range(low, high, 1, parts).select(F.col("id").alias("b"), F.concat(F.lit('x"\n'), F.col("id")).alias("a"), F.when(F.col("id") % 2 == 0, "é").alias("c"))


def read(spark, path, **how):
    return sorted(r["b"] for r in C.read_lines(spark, path, SCHEMA, **how).collect())


def test_append_and_read(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert C.read_lines(spark, path, SCHEMA).count() == 0 and C.commits(path) == []
    C.append_lines(rows(spark, 0, 50), path)
    C.append_lines(rows(spark, 50, 60), path, F.array())
    assert read(spark, path) == list(range(60)) and read(spark, path, last=True) == list(range(50, 60))
    assert [c["order"] for c in C.commits(path)] == [0, 1] and C.damaged(path) == []
    got = C.read_lines(spark, path, SCHEMA).where("b in (0, 1)").orderBy("b").collect()
    assert [tuple(r) for r in got] == [('x"\n0', 0, "é"), ('x"\n1', 1, None)]
    part = C.commits(path)[0]["parts"][0]["name"]
    with open(f"{tmp_path}/log/{part}") as f:
        assert list(json.loads(f.readline())) == ["a", "b", "c"]


def test_nothing_of_a_failed_append_is_seen(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    C.append_lines(rows(spark, 0, 5), path)
    bad = F.array_compact(F.array(F.when(F.col("b") == 93, "number")))
    with pytest.raises(Exception, match="number"):
        C.append_lines(rows(spark, 10, 100, 8), path, bad)
    assert read(spark, path) == [0, 1, 2, 3, 4] and len(C.commits(path)) == 1
    # what other tasks had written is named by no commit
    named = {p["name"] for c in C.commits(path) for p in c["parts"]}
    assert {f.rpartition("/")[2] for f in glob.glob(f"{tmp_path}/log/part-*")} >= named
    C.append_lines(rows(spark, 10, 12), path, bad)
    assert read(spark, path) == [0, 1, 2, 3, 4, 10, 11]


def test_no_rows(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    C.append_lines(rows(spark, 0, 0), path)
    assert len(C.commits(path)) == 1 and read(spark, path) == []


def test_damage_is_told(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    C.append_lines(rows(spark, 0, 9, 1), path)
    name = C.commits(path)[0]["parts"][0]["name"]
    with open(f"{tmp_path}/log/{name}", "a") as f:
        f.write("{}\n")
    assert C.damaged(path) == [name]
