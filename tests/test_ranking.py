"""Two-level ranks and positions against plain sorting."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arbitra.operators import ranking
from arbitra.sources import catalog


def scores(r, kind):
    if kind == "close":  # nine tenths within 1e-4 of each other
        return 0.7 + r.random() * 1e-4 if r.random() < 0.9 else r.random()
    return 1.0 if r.random() < 0.5 else round(r.random(), 2)


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("kind", ["close", "ties"])
def test_ranks_equal_sorting(spark, ascending, kind):
    r = random.Random(4)
    rows = [(i, None if i % 50 == 0 else scores(r, kind), i % 2, "ab"[i % 3 == 0]) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, p double, y int, g string").repartition(6)
    got = {x["id"]: (x["rank"], x["of"], x["cumulative"]) for x in ranking.ranked(df, ["g"], "p", ["id"], "y", ascending).collect()}
    assert len(got) == sum(x[1] is not None for x in rows)
    for g in "ab":
        order = sorted((x for x in rows if x[3] == g and x[1] is not None), key=lambda x: (x[1] if ascending else -x[1], x[0]))
        total = 0
        for k, (i, _, y, _) in enumerate(order, 1):
            total += y
            assert got[i] == (k, len(order), total)


@pytest.mark.parametrize("kind", ["close", "ties"])
def test_partitions_are_even(spark, kind):
    """The longest task has at most twice the mean of the rows, though scores lie close together or are equal."""
    r = random.Random(6)
    df = spark.createDataFrame([(i, scores(r, kind)) for i in range(60_000)], "id long, p double")
    counts = [x["count"] for x in ranking.spread(df, [F.col("p"), F.col("id")]).groupBy("_part").count().collect()]
    assert len(counts) >= 3 and max(counts) <= 2 * sum(counts) / len(counts)


def test_average_ranks(spark):
    r = random.Random(8)
    rows = [(i, round(scores(r, "ties"), 1), 1 + i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, p double, w int").withColumn("g", F.lit("g"))
    for weight in (None, "w"):
        got = {x["id"]: x["r"] for x in ranking.average_rank(df, ["g"], "p", "r", weight).collect()}
        for i, p, _ in rows:
            less = sum((w if weight else 1) for _, q, w in rows if q < p)
            same = sum((w if weight else 1) for _, q, w in rows if q == p)
            assert got[i] == less + (same + 1) / 2
    assert ranking.average_rank(df.where("false"), ["g"], "p", "r").count() == 0


def test_positions(spark):
    r = random.Random(5)
    rows = [(i, r.randint(0, 3), r.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a int, b double")
    out = ranking.positions(df, [F.col("a"), F.col("b"), F.col("id")])
    got = [x["id"] for x in sorted(out.collect(), key=lambda x: x["position"])]
    assert got == [x[0] for x in sorted(rows, key=lambda x: (x[1], x[2], x[0]))]
    assert sorted(x["position"] for x in out.collect()) == list(range(1, 301))
    assert ranking.positions(df.where("false"), [F.col("id")]).count() == 0


def test_catalog_of_files(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "b.yaml").write_text("id: control.skill\nversion: 2\noutput: {type: choice, candidates: [STOP, MOVE]}\nlanguages: [en]\n")
    (tmp_path / "a.yaml").write_text("id: memory.keep\nversion: 1\nthresholds: {auto_true: 0.8}\n")
    loaded = catalog.load(str(tmp_path))
    assert [(t.task_id, t.version, t.output_type, t.auto_true) for t in loaded.tasks] == [("memory.keep", 1, "boolean", 0.8), ("control.skill", 2, "choice", 0.92)]
    (tmp_path / "c.yaml").write_text("id: memory.keep\nversion: 2\n")
    with pytest.raises(ValueError, match="several active"):
        catalog.load(str(tmp_path))


def test_catalog_refuses(tmp_path):
    pytest.importorskip("yaml")
    with pytest.raises(ValueError, match="no tasks"):
        catalog.load(str(tmp_path))
    (tmp_path / "a.yml").write_text("- id\n")
    with pytest.raises(ValueError, match="define a task"):
        catalog.load(str(tmp_path))
    (tmp_path / "a.yml").write_text("id: a.b\nversion: 1\nstatus: retired\n")
    (tmp_path / "b.yaml").write_text("id: a.b\nversion: 2\n")
    with pytest.raises(ValueError, match="several"):
        catalog.load(str(tmp_path))
    (tmp_path / "b.yaml").write_text("id: c.d\nversion: 0\ninput: {max_chars: 0}\nlanguages: []\nteacher_prompt_version: 0\n")
    with pytest.raises(ValueError, match="version.*max_chars.*prompt_version.*languages"):
        catalog.load(str(tmp_path))
