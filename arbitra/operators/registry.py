"""The registry of models: manifests, registration, promotion evidence, status changes and rollback.

Tables: ``models(model_id, status, checkpoint_sha256, dataset_hash, ...)`` and an
append-only ``events(model_id, action, from_status, to_status, reason)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contracts import is_number, json_type
from ..sources.shared import written
from .gates import EDGES
from .ranking import spread

STATUSES = ("trained", "evaluated", "calibrated", "candidate", "canary", "active", "retired")
BACK_FROM = ("retired", "candidate", "canary")
REQUIRED = ("model_id", "base_model", "dataset_hash", "git_commit", "tasks", "calibration_version", "runtime", "precision", "status")


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(json_type(v, path).startswith(kind), F.lit(False))


def build_manifest(plan: Column, calibration: Column, git_commit: Column, runtime: Column, status: Column, checkpoint_sha256: Column, model_id: Column) -> Column:
    """``manifest`` of a training plan and a calibration (JSON texts), or ``error``: the first thing that keeps it from being one."""
    p, c = F.try_parse_json(plan), F.try_parse_json(calibration)
    heads = F.try_variant_get(p, "$.student.heads", "array<variant>")
    head = lambda h: F.struct(F.coalesce(F.try_variant_get(h, "$.task_id", "string"), F.lit("")).alias("key"), F.array(F.coalesce(F.try_variant_get(h, "$.task_version", "int"), F.lit(0))).alias("value"))
    tasks = F.transform(heads, head)
    ids = F.transform(tasks, lambda t: t["key"])
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    chosen = F.coalesce(F.nullif(model_id, F.lit("")), F.nullif(_text(p, "$.student.model_id"), F.lit("")))
    sha = _text(p, "$.dataset.sha256")
    error = (
        F.when(~_is(p, "$", "OBJECT") | ~_is(c, "$", "OBJECT"), "objects")
        .when(_text(p, "$.record_type") != "training_plan", "plan_record_type")
        .when(_text(c, "$.record_type") != "calibration_manifest", "calibration_record_type")
        .when(blank(git_commit), "git_commit")
        .when(blank(runtime), "runtime")
        .when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "status")
        .when(~_is(p, "$.dataset", "OBJECT") | ~_is(p, "$.student", "OBJECT") | ~_is(p, "$.training", "OBJECT"), "plan_objects")
        .when(~F.lower(sha).rlike(r"^[0-9a-f]{64}$"), "dataset_sha256")
        .when(F.coalesce(F.size(heads), F.lit(0)) < 1, "heads")
        .when(F.exists(heads, lambda h: ~F.coalesce(F.schema_of_variant(h).startswith("OBJECT"), F.lit(False))), "head_object")
        .when(F.exists(tasks, lambda t: (t["key"] == "") | (t["value"][0] < 1)), "head_task")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "head_duplicate")
        .when(_text(c, "$.calibration_version") == "", "calibration_version")
        .when(_text(p, "$.training.precision") == "", "precision")
        .when(checkpoint_sha256.isNull(), "checkpoint")
        .when(chosen.isNull() | (_text(p, "$.student.backbone") == ""), "model_id")
    )
    manifest = F.struct(
        chosen.alias("model_id"), _text(p, "$.student.backbone").alias("base_model"), sha.alias("dataset_hash"), git_commit.alias("git_commit"), F.when(error.isNull(), F.map_from_entries(F.array_sort(tasks))).alias("tasks"),
        _text(c, "$.calibration_version").alias("calibration_version"), runtime.alias("runtime"), _text(p, "$.training.precision").alias("precision"), status.alias("status"), checkpoint_sha256.alias("checkpoint_sha256"),
    )
    return F.struct(F.when(error.isNull(), manifest).alias("manifest"), error.alias("error"))


def register(models: DataFrame, asked: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(models with the new ones, outcome of each manifest): ``model_id, seq, error``.

    A manifest needs all fields, a known status and a task, and an id that nobody has;
    of several manifests of one id in a batch the first is taken.
    """
    missing = F.array_compact(F.array(*(F.when(F.col(f).isNull(), f) for f in REQUIRED)))
    first = asked.filter(F.size(missing) == 0).groupBy("model_id").agg(F.min(seq).alias("_first"))
    known = models.select("model_id", F.lit(True).alias("_known"))
    judged = asked.join(first, "model_id", "left").join(known, "model_id", "left").withColumn(
        "error",
        F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(F.array_sort(missing), ",")))
        .when((F.col("model_id") == "") | ~F.col("status").isin(*STATUSES), "model_id_or_status")
        .when(F.size("tasks") < 1, "tasks")
        .when(F.col("_known") | (F.col(seq) > F.col("_first")), "registered_already"),
    )
    new = judged.filter("error is null").select(*models.columns)
    return models.unionByName(new), judged.select("model_id", seq, "error")


def change(models: DataFrame, model_id: str, target: str, reason: str = "") -> tuple[DataFrame, DataFrame]:
    """(models after the change, its event or error): one row of ``model_id, action, from_status, to_status, reason, error``.

    Only changes along the lifecycle happen; who becomes active retires the active model.
    """
    current = models.filter(F.col("model_id") == model_id).agg(F.first("status").alias("_from"))
    pair = F.concat("_from", F.lit(">"), F.lit(target))
    error = F.when(~F.lit(target in STATUSES), "unsupported_status").when(F.col("_from").isNull(), "unknown_model").when(~pair.isin(*(f"{a}>{b}" for a, b in EDGES)), "not_allowed")
    event = current.select(
        F.lit(model_id).alias("model_id"), F.lit("transition").alias("action"), F.col("_from").alias("from_status"), F.lit(target).alias("to_status"), F.lit(reason).alias("reason"), error.alias("error")
    )
    ok = F.broadcast(event.select(F.col("error").isNull().alias("_ok")))
    status = F.when(F.col("model_id") == model_id, F.lit(target)).when(F.lit(target == "active") & (F.col("status") == "active"), F.lit("retired")).otherwise(F.col("status"))
    return models.crossJoin(ok).withColumn("status", F.when(F.col("_ok"), status).otherwise(F.col("status"))).drop("_ok"), event


def rollback(models: DataFrame, model_id: str, reason: str = "rollback") -> tuple[DataFrame, DataFrame]:
    """:func:`change` to active, from a status that can be gone back from."""
    allowed = models.filter((F.col("model_id") == model_id) & F.col("status").isin(*BACK_FROM)).agg((F.count("*") > 0).alias("_can"))
    after, event = change(models, model_id, "active", reason)
    event = event.crossJoin(F.broadcast(allowed)).withColumn("error", F.when(F.col("error").isNull() & ~F.col("_can"), "rollback_status").otherwise(F.col("error"))).drop("_can")
    can = F.broadcast(allowed)
    before = models.select("model_id", F.col("status").alias("_old"))
    kept = after.join(before, "model_id").crossJoin(can).withColumn("status", F.when(F.col("_can"), F.col("status")).otherwise(F.col("_old"))).drop("_old", "_can")
    return kept.select(*models.columns), event


_OUTCOME = "seq long, model_id string, action string, from_status string, to_status string, error string"
#: What a chunk of the log leaves behind: a row for each model that it touched, and one for who became active last.
_LEFT = "chunk int, pointer boolean, model_id string, status string"
_EDGES = frozenset(EDGES)


def _error(now: str | None, action: str, target: str | None) -> str | None:
    """What keeps a model of status ``now`` (none: not registered) from an entry of the log."""
    if action == "register":
        return "registered_already" if now is not None else None if target in STATUSES else "unsupported_status"
    if target not in STATUSES:
        return "unsupported_status"
    if now is None:
        return "unknown_model"
    if action == "rollback" and now not in BACK_FROM:
        return "rollback_status"
    return None if (now, target) in _EDGES else "not_allowed"


class _Chunk:
    """Statuses of the models that a chunk names, and who is active."""

    def __init__(self, number: int) -> None:
        self.number, self.status, self.active, self.handed = number, {}, None, False

    def entry(self, model: str | None, action: str, target: str | None) -> tuple[str | None, str | None, str | None]:
        """(status before, status asked for, error) of an entry, which is carried out."""
        now, target = self.status.get(model), "active" if action == "rollback" else target
        error = _error(now, action, target)
        if error is None:
            if target == "active" and action != "register":
                if self.active not in (None, model):
                    self.status[self.active] = "retired"
                self.active, self.handed = model, True
            self.status[model] = target
        return now, target, error

    def left(self) -> list[tuple]:
        ends = [(self.number, False, m, s) for m, s in self.status.items() if s is not None]
        return ends + [(self.number, True, self.active, None)] if self.handed else ends


def _carried_out(outcomes: bool) -> Callable:
    """Chunk after chunk: rows of what it begins with (kind 0 and 1), then its entries in order. Told are outcomes, or what each chunk leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        schema = pa.schema([("chunk", pa.int32()), ("pointer", pa.bool_()), ("model_id", pa.string()), ("status", pa.string())])
        if outcomes:
            schema = pa.schema([("seq", pa.int64())] + [(c, pa.string()) for c in ("model_id", "action", "from_status", "to_status", "error")])
        for batch in batches:
            out = []
            for number, kind, seq, model, action, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk is None or number != chunk.number:
                    out += chunk.left() if chunk and not outcomes else []
                    chunk = _Chunk(number)
                if kind == 0:
                    chunk.active = model
                elif kind == 1:
                    chunk.status[model] = target
                else:
                    now, to, error = chunk.entry(model, action, target)
                    if outcomes:
                        out.append((seq, model, action, now, to, error))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        if chunk and not outcomes and (out := chunk.left()):
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _begins(left: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with what the chunks before it leave: the model's status, or who is active. A model has a row here for each chunk that names it."""
    held = F.struct("model_id", "status")
    points = left.select("*", held.alias("_held")).unionByName(asked.select("*", F.lit(None).cast("string").alias("status"), F.lit(None).cast(left.select(held.alias("x")).schema["x"].dataType).alias("_held")))
    before = Window.partitionBy("pointer", F.when(~F.col("pointer"), F.col("model_id"))).orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)
    known = points.select("chunk", "pointer", F.col("model_id").alias("_id"), "_held", F.last("_held", ignorenulls=True).over(before).alias("_was"))
    return known.where("_held is null and _was is not null").select("chunk", "pointer", F.when(F.col("pointer"), F.col("_was.model_id")).otherwise(F.col("_id")).alias("model_id"), F.col("_was.status").alias("status"))


def replay(models: DataFrame, log: DataFrame, chunk: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(``model_id, status`` of all models at the end, outcome of each entry: ``seq, model_id, action, from_status, to_status, error``).

    ``models`` has statuses to begin with, one active model at most; ``log`` has seq (unique),
    model_id, action (register, transition, rollback) and target. Entries count in order of
    seq; who becomes active retires the model that was.

    The log is cut along seq in chunks of about ``chunk`` entries, one for each shuffle
    partition at most. All chunks are carried out at once, entry by entry, from an assumed
    beginning; then those again whose beginning turns out to be another, until none does.
    The first chunk's is right, so each round settles one chunk more at least, and usually
    all: after enough entries a model's status doesn't depend on what it once was. A log of
    one chunk begins with ``models`` and needs no rounds and no tables.
    """
    rows, sizes = log.select("seq", "model_id", "action", "target"), [(0, 0)]
    if rows.count() > chunk:
        placed = spread(rows, [F.col("seq")])
        # a row per partition of the order
        sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    else:
        placed = rows.withColumn("_part", F.lit(0))
    starts = [sum(n for _, n in sizes[:i]) for i in range(len(sizes))]
    number = models.sparkSession.createDataFrame([(p, before // chunk) for (p, _), before in zip(sizes, starts, strict=True)], "_part int, chunk int")
    entries = placed.join(F.broadcast(number), "_part").select("chunk", F.lit(2).alias("kind"), "seq", "model_id", "action", "target")

    def carried_out(begins: DataFrame, which: list[int] | None, outcomes: bool) -> DataFrame:
        known = begins.select("chunk", F.when(F.col("pointer"), 0).otherwise(1).alias("kind"), F.lit(None).cast("long").alias("seq"), "model_id", F.lit(None).cast("string").alias("action"), F.col("status").alias("target"))
        rows = known.unionByName(entries)
        rows = rows if which is None else rows.where(F.col("chunk").isin(which))
        return rows.repartition("chunk").sortWithinPartitions("chunk", "kind", "seq").mapInArrow(_carried_out(outcomes), _OUTCOME if outcomes else _LEFT)

    named = entries.select("chunk", F.lit(False).alias("pointer"), "model_id").distinct()
    pointers = number.select("chunk", F.lit(True).alias("pointer"), F.lit(None).cast("string").alias("model_id")).distinct()
    asked = named.unionByName(pointers)
    given = models.select(F.lit(-1).alias("chunk"), F.lit(False).alias("pointer"), "model_id", "status")
    left = given.unionByName(given.where("status = 'active'").select("chunk", F.lit(True).alias("pointer"), "model_id", F.lit(None).cast("string").alias("status")))
    at_end = lambda left: left.where("not pointer and status is not null").groupBy("model_id").agg(F.max_by("status", "chunk").alias("status"))
    numbers, assumed = {before // chunk for before in starts}, None
    if numbers == {0}:
        begins = _begins(left, asked)
        return at_end(left.unionByName(carried_out(begins, None, False))), carried_out(begins, None, True)
    asked, left = written(asked, "named"), written(left, "given")
    while True:
        begins = written(_begins(left, asked), "begins")
        # a row per chunk
        told = {r["chunk"]: (r["n"], r["x"]) for r in begins.groupBy("chunk").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("pointer", "model_id", "status")).alias("x")).collect()}
        stale = [c for c in numbers if assumed is None or assumed.get(c) != told.get(c)]
        if not stale:
            break
        left = written(left.where(~F.col("chunk").isin(stale)).unionByName(carried_out(begins, stale, False)), "left")
        assumed = told
    return at_end(left), carried_out(begins, None, True)


def promotion_errors(report: Column, checkpoint_sha256: Column, dataset_hash: Column) -> Column:
    """What a quality report (JSON text) lacks to promote a model, in order; none if it may be promoted."""
    v = F.try_parse_json(report)
    true = lambda f: F.coalesce(_is(v, f"$.{f}", "BOOLEAN") & F.try_variant_get(v, f"$.{f}", "boolean"), F.lit(False))
    kind = lambda f: json_type(v, f)
    number = lambda f: F.when(is_number(kind(f)), F.try_variant_get(v, f, "double")).when(kind(f) == "STRING", F.try_variant_get(v, f, "string").try_cast("double"))
    within = lambda x, least: F.coalesce(~F.isnan(x) & (x >= least) & (x <= 1.0), F.lit(False))
    same = lambda f, c: F.coalesce(F.try_variant_get(v, f"$.{f}", "string").eqNullSafe(c), F.lit(False))
    has_safety, has_interval = _is(v, "$.safety", "OBJECT"), _is(v, "$.safety.safe_stop_recall_ci95", "OBJECT")
    recall = F.when(kind("$.safety.safe_stop_recall").isNull(), F.lit(0.0)).otherwise(number("$.safety.safe_stop_recall"))
    return F.when(~_is(v, "$", "OBJECT"), F.array(F.lit("object"))).otherwise(
        F.array_compact(
            F.array(
                F.when(_text(v, "$.record_type") != "control_quality_gate", "record_type"), *(F.when(~true(f), f) for f in ("passed", "production_ready", "human_label_gate", "human_test_gate")),
                F.when(~same("checkpoint_sha256", checkpoint_sha256), "checkpoint_sha256"), F.when(~same("dataset_sha256", dataset_hash), "dataset_sha256"), F.when(~has_safety, "safety"),
                F.when(has_safety & ~within(recall, 1.0), "safe_stop_recall"), F.when(has_safety & ~has_interval, "safe_stop_recall_ci95"), F.when(has_interval & ~within(number("$.safety.safe_stop_recall_ci95.lower"), 0.99), "safe_stop_recall_lower"),
            )
        )
    )


def get(models: DataFrame, model_id: str) -> DataFrame:
    """The model's row; an unknown id is an error."""
    row = models.filter(F.col("model_id") == model_id)
    if row.isEmpty():
        raise KeyError(model_id)
    return row


def listed(models: DataFrame) -> DataFrame:
    """All models in the order of their ids."""
    return models.orderBy("model_id")
