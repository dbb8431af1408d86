"""Typed decisions, repair and request checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arbitra.functions import contracts as C
from arbitra.operators import records
from arbitra.sources import catalog, jsonl

REPLIES = [
    ('{"type": "boolean", "value": true, "probability": 0.9}', None),
    ('{"type": "noul", "value": false, "probability": 1}', None),
    ('{"type": "boolean", "value": "true", "probability": 0.9}', "value"),
    ('{"type": "boolean", "value": true, "probability": true}', "probability"),
    ('{"type": "boolean", "value": true, "probability": "0.5"}', "probability"),
    ('{"type": "boolean", "value": true, "probability": 1.1}', "probability"),
    ('{"type": "choice", "selected": "a", "probabilities": {"a": 0.7, "b": 0.3}}', None),
    ('{"type": "choice", "selected": "a", "probabilities": {"a": 0.7, "b": 0.25}}', "sum"),
    ('{"type": "choice", "selected": "c", "probabilities": {"a": 0.7, "b": 0.3}}', "selected"),
    ('{"type": "choice", "selected": "a", "probabilities": {"a": true, "b": 0.3}}', "probabilities"),
    ('{"type": "score", "value": 0.5, "interval_90": [0.4, 0.6]}', None),
    ('{"type": "score", "value": 0.5, "interval_90": [0.6, 0.4]}', "interval_90"),
    ('{"type": "score", "value": 0.9, "interval_90": [0.4, 0.6]}', "interval_90"),
    ('{"type": "other"}', "type"),
    ("[1]", "not_object"),
    ("not json", "not_json"),
    (None, "not_json"),
]


def test_decisions(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "id int, reply string")
    got = df.select("id", C.parse_decision("reply").alias("d")).orderBy("id").collect()
    assert [r["d"]["error"] for r in got] == [e for _, e in REPLIES]
    assert got[1]["d"]["type"] == "boolean" and got[6]["d"]["probability"] == 0.7


def test_fits_task(spark):
    df = spark.createDataFrame([(REPLIES[6][0], ["a", "b"], True), (REPLIES[6][0], ["a", "b", "c"], False), (REPLIES[6][0], ["a"], False)], "reply string, candidates array<string>, want boolean")
    rows = df.select("want", C.fits_task(C.parse_decision("reply"), F.lit("choice"), F.col("candidates")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


def test_repair(spark):
    df = spark.createDataFrame([({"a": 0.5, "b": 0.45},), ({"a": 0.5, "b": 0.5},), ({"a": 0.2, "b": 0.3},), ({"a": 0.33, "b": 0.33, "c": 0.30},)], "p map<string,double>")
    got = [r["r"] for r in df.select(C.repair_probabilities(F.col("p"), F.map_keys("p")).alias("r")).collect()]
    assert got[0] == {"a": 0.526316, "b": 0.473684} and got[1] is None and got[2] is None
    assert got[3] == {"a": 0.34375, "b": 0.34375, "c": 0.3125}


def test_references_and_replies(spark):
    df = spark.createDataFrame([("memory.type@2", "x {\"a\": 1} y"), ("memory@", "none"), ("A@1", "{broken")], "r string, t string")
    got = df.select(C.task_reference("r").alias("r"), C.json_in("t").alias("j")).collect()
    assert [g["r"] and (g["r"]["id"], g["r"]["version"]) for g in got] == [("memory.type", 2), None, None]
    assert [g["j"] for g in got] == ['{"a": 1}', None, None]


def test_request(spark):
    df = spark.createDataFrame([("ok", ["a", "b"], 5, ""), (" ", ["a", "a"], 0, "state,duplicate_question,deadline"), ("x", [], None, "questions")], "s string, q array<string>, d int, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", F.array_join(C.request_errors(F.col("s"), F.col("q"), F.col("d")), ",").alias("got")).collect())


def test_samples(spark, tmp_path):
    good = '{"sample_id": "1", "task_id": "memory.importance", "task_version": 1, "state": "s", "question": "q", "target": 1, "language": "en", "domain": "d", "source": {}, "labels": {}, "provenance": {"prompt_version": 2}}'
    (tmp_path / "a.jsonl").write_text("\n".join([good, "", good.replace('"1"', '"2"'), good.replace('"s"', '""'), "broken", good]))
    (tmp_path / "b.jsonl").write_text("\n \n")
    lines = jsonl.read_lines(spark, str(tmp_path))
    rows = [(r["at"].rpartition("/")[2], ",".join(r["errors"])) for r in records.canonical(lines, catalog.TASKS.frame(spark)).collect()]
    assert sorted(rows) == [("a.jsonl:1", ""), ("a.jsonl:3", ""), ("a.jsonl:4", "empty:state"), ("a.jsonl:5", "json"), ("a.jsonl:6", "duplicate")]
    assert [r["path"].rpartition("/")[2] for r in records.empty_files(lines).collect()] == ["b.jsonl"]


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        lines = jsonl.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        assert lines.filter("line <> concat('line ', line_no)").count() == 0 and lines.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_run(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"record_type": "manifest", "v": 1}\n{"record_type": "sample"}\n')
    manifest, rest = jsonl.read_run(spark, str(tmp_path / "a.jsonl"))
    assert manifest.count() == 1 and rest.count() == 1
    (tmp_path / "b.jsonl").write_text('{"record_type": "sample"}\n')
    with pytest.raises(jsonl.ContractError, match="first record"):
        jsonl.read_run(spark, str(tmp_path / "b.jsonl"))


def test_log_and_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "")], "n int, reviewer string")
    errors = F.array_compact(F.array(F.when(F.col("reviewer") == "", "reviewer")))
    with pytest.raises(jsonl.ContractError, match="reviewer"):
        jsonl.append_log(rows, str(tmp_path / "log"), errors)
    assert not (tmp_path / "log").exists()
    jsonl.append_log(rows.limit(1), str(tmp_path / "log"), errors)
    jsonl.append_log(rows.limit(1), str(tmp_path / "log"), errors)
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    jsonl.write_report(rows.agg(F.count("*").alias("z"), F.min("n").alias("a")), str(tmp_path / "report"))
    assert "".join(p.read_text() for p in (tmp_path / "report").glob("part-*")).strip() == '{"a":1,"z":2}'


def test_control_characters(spark):
    import json

    from arbitra.functions.text import json_string

    texts = ["".join(map(chr, range(33))), 'q"\\/é\u2028', ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["j"] for r in df.select(json_string("t").alias("j")).collect()] == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_catalog(spark, tmp_path):
    assert catalog.TASKS.frame(spark).count() == len(catalog.TASKS.tasks)
    with pytest.raises(ValueError):
        catalog.Catalog([catalog.Task("a"), catalog.Task("a", 2)])
    with pytest.raises(ValueError):
        catalog.Catalog([catalog.Task("a", output_type="choice", candidates=("x",))])


def test_json_sink_and_digest(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "b int, a string")
    jsonl.write_json(df, str(tmp_path / "out"))
    line = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*")).strip()
    assert line == '{"a":"é","b":1}'
    assert jsonl.content_digest(spark, str(tmp_path / "out")).count() >= 1
    twice = df.union(df)
    assert jsonl.table_digest(df).first() != jsonl.table_digest(twice).first()
