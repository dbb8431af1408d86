"""The stages in a row, and what each must and must not do."""

from __future__ import annotations

import corpus_pipeline
from test_line_dedup import brute as repeated_lines
from test_near_dedup import brute as near

from arbitra.llm.decontaminate import contamination
from arbitra.llm.quality import fit_quality, score_quality
from arbitra.llm.session import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert after.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= ids and after.count() <= before
        docs, before = after, after.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.filter("rate < 0").count() == 0


def test_quality_stage_keeps_what_is_labelled_good(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum((d in kept) == (q == 1) for d, q in marks.items()) >= 0.97 * len(marks)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_stages_against_brute_force(spark):
    """Each stage's decision on its own input: lines and documents by sets, scores and overlaps by their operators, which have brute-force tests."""
    whole = table(spark, SF, "documents")
    rows = [tuple(r) for r in whole.orderBy("doc_id").limit(80).collect()]
    docs = spark.createDataFrame(rows, whole.schema)
    texts = [(r[0], r[1]) for r in rows]
    kept = lambda stage: {r["doc_id"]: r["text"] for r in stage(spark, docs, SF).collect()}

    gone = repeated_lines(texts)
    want = {}
    for d, t in texts:
        lines = [] if t is None else t.split("\n")
        left = [x for k, x in enumerate(lines) if (d, k) not in gone]
        if len(left) == len(lines) or any(x.strip() for x in left):
            want[d] = None if t is None else "\n".join(left)
    assert kept(corpus_pipeline.lines) == want

    assert kept(corpus_pipeline.near_duplicates).keys() == {d for d, (n, _, stays) in near(texts).items() if stays or not n}

    labels = table(spark, SF, "labels")
    good = {r["doc_id"] for r in score_quality(docs, fit_quality(docs, labels)).filter("predicted = 1").collect()}
    assert kept(corpus_pipeline.quality).keys() == good

    leaked = {r["doc_id"] for r in contamination(docs, table(spark, SF, "benchmark")).collect()}
    assert kept(corpus_pipeline.decontamination).keys() == {d for d, _ in texts} - leaked
