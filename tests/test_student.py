"""Distributed training against one process, held-out accuracy, artefacts, and batch against row-by-row answers."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbitra.operators import student as S

HEADS = [S.Head("keep", 1, "boolean"), S.Head("topic", 2, "choice", ("sea", "hill", "town")), S.Head("weight", 1, "score")]
CONFIG = S.Config(vocabulary=256, hidden=8, steps=25, rate=0.1)
WORDS = {"sea": "wave salt tide boat".split(), "hill": "stone ridge slope fern".split(), "town": "street lamp wall door".split()}


def samples(seed, n):
    r, out = random.Random(seed), []
    for i in range(n):
        topic = r.choice(list(WORDS))
        good = r.random() < 0.3
        words = [r.choice(WORDS[topic]) for _ in range(6)] + (["fine"] * 3 if good else ["poor"] * 3)
        heavy = r.randint(0, 4)
        words += ["lead"] * heavy + ["air"] * (4 - heavy)
        r.shuffle(words)
        text = " ".join(words)
        out += [(i, "keep", text, str(good).lower()), (i, "topic", text, topic), (i, "weight", text, str(heavy / 4))]
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "id long, task_id string, text string, target string").repartition(parts)


def in_one_process(rows, weights):
    """The same steps over all rows at once, without Spark."""
    model = S.Student(HEADS, CONFIG)
    number = {h.task_id: k for k, h in enumerate(HEADS)}
    task = np.array([number[r[1]] for r in rows])
    target = np.array([["false", "true"].index(r[3]) if r[1] == "keep" else HEADS[1].candidates.index(r[3]) if r[1] == "topic" else round(float(r[3]) * S.GRID) for r in rows])
    found = [S.word_counts(r[2], CONFIG.vocabulary) for r in rows]
    ids, counts = (np.concatenate([f[c] for f in found]) for c in range(2))
    offsets = np.cumsum([0] + [len(f[0]) for f in found])
    size = [sum(round(w * S.GRID) for w, t in zip(weights, task, strict=True) if t == k) for k in range(3)]
    total = sum(size) / S.GRID
    weight = np.array(weights) * np.array([total * S.GRID / (3 * s) for s in size])[task]
    adam = S._Adam(model.arrays, CONFIG.rate, CONFIG.decay)
    for _ in range(CONFIG.steps):
        gradient, _ = model.gradient(task, target, weight, ids, counts, offsets)
        two = {"hidden", "head0", "head1", "head2"}
        model = S.Student(HEADS, CONFIG, adam.step({k: g / (total * S.GRID * (S.GRID if k in two else 1)) for k, g in gradient.items()}))
    return model


@pytest.fixture(scope="module")
def fitted(spark):
    return S.train(frame(spark, samples(1, 300)), HEADS, CONFIG)


def test_any_partitioning_gives_the_same(spark, fitted):
    rows = samples(1, 300)
    again, losses = S.train(frame(spark, rows[::-1], 7), HEADS, CONFIG)
    one = in_one_process(rows, [1.0] * len(rows))
    for k, v in fitted[0].arrays.items():
        assert (v == again.arrays[k]).all() and (v == one.arrays[k]).all(), k
    assert losses == fitted[1] and losses[-1] < 0.5 * losses[0]


def test_held_out(spark, fitted):
    rows = frame(spark, samples(2, 200))
    got = S.predict(rows, fitted[0]).join(rows, ["id", "task_id"])
    right = got.where("task_id <> 'weight'").groupBy("task_id").agg(F.avg((F.coalesce(F.col("value").cast("string"), "selected") == F.col("target")).cast("double")).alias("a"))
    assert all(r["a"] >= 0.9 for r in right.collect())
    error = got.where("task_id = 'weight'").agg(F.avg(F.abs(F.col("score") - F.col("target").cast("double")))).first()[0]
    assert error < 0.15


def test_batches_equal_single_rows(spark, fitted):
    model, _ = fitted
    texts = [None, "", "  ", "wave fine tide", "unseen wordings only", "fine " * 5000, "Wave FINE tide"]
    rows = [(i, h.task_id, t) for i, t in enumerate(texts) for h in HEADS] + [(99, "other", "wave"), (100, None, "wave")]
    df = spark.createDataFrame(rows, "id long, task_id string, text string")
    got = {(r["id"], r["task_id"]): r for r in S.predict(df, model, {"topic": 2.0}, 0.6).collect()}
    assert len(got) == len(rows) and got[99, "other"]["confidence"] is None and got[100, None]["abstained"] is None
    for i, name, text in rows[:-2]:
        k = model.number[name]
        ids, counts = S.word_counts(text, CONFIG.vocabulary)
        said = model.output(k, model.hidden(model.pooled(ids, counts, np.array([0, len(ids)]))[0]))[0]
        want = S.answer(model.heads[k], said, 2.0 if name == "topic" else 1.0, 0.6)
        assert {c: got[i, name][c] for c in want} == want
    assert got[3, "topic"]["selected"] == got[6, "topic"]["selected"] == "sea"
    assert got[3, "topic"]["confidence"] < max(S.answer(HEADS[1], np.array(got[3, "topic"]["logits"]), 1.0, 0)["probabilities"])


def test_class_weights(spark):
    df = spark.createDataFrame([("t", "a")] * 6 + [("t", "b")] * 2 + [("u", "a")], "task_id string, target string")
    got = {(r["task_id"], r["target"]): r["weight"] for r in S.class_weights(df).collect()}
    assert got == {("t", "a"): 8 / 12, ("t", "b"): 2.0, ("u", "a"): 1.0}
    rows = samples(3, 60)
    weighted = frame(spark, rows).withColumn("weight", F.when(F.col("task_id") == "keep", 2.0).otherwise(0.5))
    model, _ = S.train(weighted, HEADS, CONFIG)
    one = in_one_process(rows, [2.0 if r[1] == "keep" else 0.5 for r in rows])
    assert all((v == one.arrays[k]).all() for k, v in model.arrays.items())


def test_artefact(spark, fitted, tmp_path):
    model, _ = fitted
    digest = S.save(spark, model, f"{tmp_path}/m")
    loaded = S.load(spark, f"{tmp_path}/m", HEADS[::-1])
    assert all((v == loaded.arrays[k]).all() for k, v in model.arrays.items()) and len(digest) == 64
    with pytest.raises(ValueError, match="bound to other"):
        S.load(spark, f"{tmp_path}/m", [*HEADS[:1], S.Head("topic", 3, "choice", ("sea", "hill", "town")), HEADS[2]])
    rows = [(r["name"], bytes(r["data"])) for r in spark.read.parquet(f"{tmp_path}/m").collect()]
    broken = [(n, d[:-8] + (int.from_bytes(d[-8:], "little", signed=True) + 1).to_bytes(8, "little", signed=True) if n == "shift" else d) for n, d in rows]
    spark.createDataFrame(broken, "name string, data binary").write.parquet(f"{tmp_path}/b")
    with pytest.raises(ValueError, match="digest"):
        S.load(spark, f"{tmp_path}/b")


@pytest.mark.parametrize("bad", [("other", "a b", "true"), ("keep", "a b", "maybe"), ("weight", "a", "1.5"), ("topic", "a", None)])
def test_rows_that_no_head_takes(spark, bad):
    rows = [*samples(4, 3), (0, *bad)]
    with pytest.raises(ValueError, match="each row a head"):
        S.train(frame(spark, rows), HEADS, CONFIG)


def test_heads():
    with pytest.raises(ValueError):
        S.Student([], CONFIG)
    with pytest.raises(ValueError):
        S.Student([S.Head("a", 1, "choice", ("x",))], CONFIG)
    with pytest.raises(ValueError):
        S.Student([HEADS[0], HEADS[0]], CONFIG)


def test_texts_are_counted_once(spark):
    """Rows of one text are packed together, and give what each gives alone."""
    rows = samples(5, 40)
    found = [S.word_counts(r[2], CONFIG.vocabulary) for r in rows]
    task = np.arange(len(rows)) % 3
    target = np.array([len(r[2]) % 2 for r in rows])
    weight = np.linspace(0.5, 2, len(rows))
    flat = lambda some: [np.concatenate([f[c] for f in some]) for c in range(2)] + [np.cumsum([0] + [len(f[0]) for f in some])]
    model = S.Student(HEADS, CONFIG)
    alone, loss = model.gradient(task, target, weight, *flat(found))
    shared, same = model.gradient(task, target, weight, *flat(found[::3]), np.arange(len(rows)) // 3)
    assert loss == same and all((alone[k] == shared[k]).all() for k in alone)
    df = spark.createDataFrame([(h, f"text {i}", t) for i in range(30) for h, t in (("keep", "true"), ("topic", "sea"), ("weight", "0.5"))] + [("keep", "same", "false")] * 40, "task_id string, text string, target string").coalesce(1)
    packed = df.select("task_id", "text", "target", F.lit(1.0).alias("weight")).mapInArrow(S._pack(HEADS, 256), S._PACKED).collect()
    assert len(packed) == 30 + 3 and sum(len(r["task"]) for r in packed) == 130 and max(len(r["task"]) for r in packed) == S.ASKS


def test_weights_leave_texts_where_they_are(spark):
    """No shuffle by class, which would put whole texts in as few tasks as there are classes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = frame(spark, samples(6, 50))
        weighed = S.class_weights(df, scores=("weight",))
        plan = weighed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and not re.search(r"SortMergeJoin \[task_id#\d+, target", plan)
        got = {(r["task_id"], r["target"]): r["weight"] for r in weighed.collect()}
        want = {(r["task_id"], r["target"]): r["weight"] for r in S.class_weights(df).where("task_id <> 'weight'").collect()}
        assert {k: v for k, v in got.items() if k[0] != "weight"} == want and {v for k, v in got.items() if k[0] == "weight"} == {1.0} and weighed.count() == 150
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_answers_count_a_text_once(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    model, seen = S.Student(HEADS, CONFIG), []
    count = S.word_counts
    monkeypatch.setattr(S, "word_counts", lambda text, size: seen.append(text) or count(text, size))
    texts = ["wave fine", None, "stone poor", "wave fine"]
    rows = [(i, h.task_id, t) for i, t in enumerate(texts) for h in HEADS]
    batch = pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], names=["id", "task_id", "text"])
    run = S._answers(SimpleNamespace(value=(model.heads, CONFIG, model.arrays)), {}, 0.0)
    (told,) = run([batch])
    assert seen == ["wave fine", None, "stone poor"]
    alone = [next(run([batch.slice(i, 1)])).to_pylist()[0] for i in range(len(rows))]
    assert told.to_pylist() == alone


def test_words_side_by_side():
    """Words hashed many at a time are those hashed one by one."""
    r = random.Random(11)
    texts = [None, "", "  \t\n", "one", "ÀÉ straße İX\x1cz\x85", "a" * 64 + " " + "b" * 65 + " c " + "é" * 4000, " same same\nSAME ", "\x00 \x00\x00"]
    texts += [" ".join(r.choice(["sea", "Ünder", "x", "日本語", "long" * r.randrange(1, 30)]) + str(r.randrange(40)) for _ in range(r.randrange(300))) for _ in range(90)]
    for size in (1, 7, 2048, 1 << 21):
        told = list(S.words_of(texts[:20] if size > 4096 else texts, size))
        assert told == [np.concatenate(S.word_counts(t, size)).astype(np.int32).tobytes() for t in texts[: len(told)]] and len(told) >= 20


def test_counted_texts(spark):
    """Rows of counted texts give the model and the answers that texts give."""
    rows = frame(spark, samples(8, 60))
    once = S.counted(rows, CONFIG.vocabulary)
    assert "text" not in once.columns
    (model, losses), (same, also) = S.train(rows, HEADS, CONFIG), S.train(once, HEADS, CONFIG)
    assert losses == also and all((model.arrays[k] == same.arrays[k]).all() for k in model.arrays)
    assert sorted(map(str, S.predict(rows, model).collect())) == sorted(map(str, S.predict(once, same).collect()))


def test_documents_are_read_once(spark, monkeypatch):
    """Training, temperatures and answers of a query go by one table of counted texts."""
    from arbitra.plans import student as P

    monkeypatch.setattr(S, "train", lambda rows, heads, config: (S.Student(heads, config), rows.count() * [0.0]))
    read, table = [], P.A.table
    monkeypatch.setattr(P.A, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    for name in ("student_answers", "student_accuracy"):
        out = P.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert read.count("documents") == 1 and not any("documents" in f for f in out.inputFiles())
        assert out.count() > 0
        read.clear()


def test_blocks_of_texts():
    """Packed texts are joined in blocks, in few bytes, and their gradient is that of the texts one by one."""
    from types import SimpleNamespace

    import pyarrow as pa

    rows = samples(9, 400) + [(0, "keep", None, "true"), (0, "topic", "", "sea")] + [(0, "keep", "long " * 70_000, "true")]
    batch = pa.record_batch([pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows]), pa.array(np.linspace(0.5, 2, len(rows)))], names=["task", "text", "target", "weight"])
    (packed,) = S._pack(HEADS, CONFIG.vocabulary)([batch])
    blocks = list(S._in_blocks([packed]))
    assert len(blocks) == -(-packed.num_rows // S.ROWS) and sum(b.column("texts")[0].as_py() for b in blocks) == packed.num_rows
    assert sum(b.column("ids")[0].as_buffer().size for b in blocks) * 4 == sum(len(x) for x in packed.column("ids").to_pylist())
    model = S.Student(HEADS, CONFIG)
    found = [S.word_counts(r[2], CONFIG.vocabulary) for r in rows]
    number = {"false": 0, "true": 1, "sea": 0, "hill": 1, "town": 2}
    target = np.array([number[r[3]] if r[3] in number else round(float(r[3]) * S.GRID) for r in rows])
    alone, loss = model.gradient(np.array([model.number[r[1]] for r in rows]), target, np.linspace(0.5, 2, len(rows)), *(np.concatenate([f[c] for f in found]) for c in range(2)), np.cumsum([0] + [len(f[0]) for f in found]))
    (told,) = S._sum_rows(HEADS, CONFIG, SimpleNamespace(value=model.arrays), [1.0] * 3)(blocks)
    flat = np.concatenate([np.frombuffer(x, np.int64) for x in told.column("sums").to_pylist()])
    assert flat[-1] == loss and (flat[:-1] == S._flat(alone)).all()
