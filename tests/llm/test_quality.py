"""Held-out accuracy and the kept-out rows."""

from __future__ import annotations

import zlib

import pytest
from conftest import prose

from arbitra.llm import queries
from arbitra.llm.quality import drop_low_quality, fit_quality, score_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op2_quality_classifier(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in out) >= 0.95 * len(out)


def test_held_out_labels_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality", "toxic")
    some = docs.filter("doc_id < 50")
    a, b = (sorted(map(tuple, score_quality(some, fit_quality(docs, x, 200)).collect())) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)], [(1, 1, 0), (3, 1, 0)], [(1, None, None), (None, 0, 0)]])
def test_nothing_to_learn(spark, odd, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = fit_quality(odd, labels)
    assert not model.learned
    assert score_quality(odd, model).select("score").distinct().count() == 1
    assert drop_low_quality(odd, labels).count() == odd.count()


def test_odd(spark, odd, none, labels):
    texts = [(100 + i, prose(i, 60) if i % 2 else "%%% ### " * 40, "en", "s", 1, "") for i in range(60)]
    docs = odd.union(spark.createDataFrame(texts, odd.schema))
    marks = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(60)], labels.schema)
    model = fit_quality(docs, marks)
    rows = {r["doc_id"]: r for r in score_quality(docs, model).collect()}
    assert all(rows[100 + i]["predicted"] == i % 2 for i in range(60))
    assert rows[0]["score"] == rows[1]["score"] == rows[2]["score"]
    kept = drop_low_quality(docs, marks)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 100").count() == 30
    assert score_quality(none, model).count() == 0


def test_scores_against_brute_force(spark):
    """Token by token: the mean of vectors, a hidden layer, a logistic score at the fitted temperature."""
    import numpy as np

    from arbitra.llm.quality import Tokens, index_vectors

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_quality(docs, labels, 150)
    assert model.learned
    some = docs.orderBy("doc_id").limit(25).unionByName(docs.limit(1).selectExpr("-1L as doc_id", "cast(null as string) as text", "lang", "source", "n_chars"))
    got = {r["doc_id"]: r["score"] for r in score_quality(some, model).collect()}
    known = {int(t): v for t, v in zip(model.pooler.ids, model.pooler.vectors[:-1], strict=True)}
    for r in some.collect():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        cut = Tokens()
        h, rows = cut(data, np.array([0, len(data)]))
        total = np.zeros(model.pooler.vectors.shape[1])
        for token, shape in zip(h, cut.shapes(h, rows, data, np.array([0, len(data)])) if len(h) else [], strict=True):
            total += known.get(int(token), model.pooler.vectors[-1])
            places, signs = index_vectors(np.array([shape], np.uint64))
            for place, sign in zip(places[0], signs[0], strict=True):
                total += sign * model.pooler.shapes[place]
        hidden = np.tanh(total / max(len(h), 1) + model.bias)
        want = 1 / (1 + np.exp(-(hidden @ model.out + model.out_bias) / model.temperature))
        assert abs(got[r["doc_id"]] - want) < 1e-7


def test_repeated_ids(spark):
    """Two texts of one doc_id in the sample: the outcome doesn't depend on which comes first."""
    rows = [(i, prose(i, 30) if i % 2 else "%%% ### " * 9) for i in range(40)] + [(3, "%%% ### " * 9), (4, prose(4, 30))]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    scores = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        scores.append(sorted(tuple(r) for r in score_quality(df, fit_quality(df, labels)).collect()))
    assert scores[0] == scores[1]
