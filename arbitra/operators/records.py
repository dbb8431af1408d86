"""Records read from JSON lines: what is wrong with each, and the gates of a training set.

Every scan takes ``lines(path, line_no, line)``, leaves blank lines out and gives each
record its ``at`` (path:line) and ``errors``; a table of violations is a filter of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import SUM_TOLERANCE, fits_task, is_number, json_type, parse_decision
from .dataset import SPLITS

REQUIRED = ("sample_id", "task_id", "task_version", "state", "question", "target", "language", "domain", "source", "labels", "provenance")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("value", f"$.{path}", kind)


def _kind(path: str) -> Column:
    return json_type(F.col("value"), f"$.{path}")


def _is(path: str, kind: str) -> Column:
    return F.coalesce(_kind(path).startswith(kind), F.lit(False))


def _list(*errors: Column) -> Column:
    return F.array_compact(F.array(*errors))


def records(lines: DataFrame) -> DataFrame:
    """``path, line_no, at, value, errors``: lines that aren't blank; ``json`` and ``object`` are the errors so far."""
    rows = lines.filter(F.col("line").rlike(r"\S")).withColumn("value", F.try_parse_json("line"))
    object_ = F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False))
    return rows.select(
        "path", "line_no", F.concat("path", F.lit(":"), F.col("line_no").cast("string")).alias("at"), "value", _list(F.when(F.col("value").isNull(), "json").when(~object_, "object")).alias("errors")
    )


def check(rows: DataFrame, *errors: Column) -> DataFrame:
    """``rows`` with further errors, for records that were objects."""
    return rows.withColumn("errors", F.when(F.exists("errors", lambda e: e.isin("json", "object")), F.col("errors")).otherwise(F.concat("errors", _list(*errors))))


def unique(rows: DataFrame, id: str) -> DataFrame:
    """``rows`` with ``duplicate`` on all but the first valid record of an id."""
    first = rows.filter(F.size("errors") == 0).groupBy(id).agg(F.min(F.struct("path", "line_no")).alias("_first"))
    again = F.col("_first").isNotNull() & (F.size("errors") == 0) & (F.struct("path", "line_no") != F.col("_first"))
    return rows.join(first, id, "left").withColumn("errors", F.when(again, F.array(F.lit("duplicate"))).otherwise(F.col("errors"))).drop("_first")


def empty_files(lines: DataFrame) -> DataFrame:
    """Paths without any record."""
    return lines.groupBy("path").agg(F.count_if(F.col("line").rlike(r"\S")).alias("_n")).filter("_n = 0").select("path")


def identified(lines: DataFrame, id: str, *errors: Column, distinct: bool = True) -> DataFrame:
    """Records that need an id, a distinct one unless said otherwise, as column ``id``."""
    rows = check(records(lines).withColumn("id", F.trim(_get(id))), F.when(F.coalesce(F.trim(_get(id)), F.lit("")) == "", id), *errors)
    return unique(rows, "id") if distinct else rows


def seeds(lines: DataFrame) -> DataFrame:
    """Seeds of a data set: objects; ids may repeat."""
    return identified(lines, "sample_id", distinct=False)


def scenarios(lines: DataFrame) -> DataFrame:
    return identified(lines, "scenario_id")


def queue(lines: DataFrame) -> DataFrame:
    """Rows to be decided on: each has a state that isn't blank; ids may repeat."""
    return check(records(lines).withColumn("id", _get("sample_id")), F.when(~(_is("state", "STRING") & F.coalesce(_get("state").rlike(r"(?U)\S"), F.lit(False))), "state"))


def drafts(lines: DataFrame) -> DataFrame:
    """A teacher's drafts after their manifest, one for each sample."""
    return identified(lines, "sample_id")


def invalid_seed() -> Column:
    """A seed without id, state or question, or whose source is no object."""
    blank = lambda f: F.coalesce(_get(f), F.lit("")) == ""
    return blank("sample_id") | blank("state") | blank("question") | ~_is("source", "OBJECT")


def lineage(fields: tuple[str, ...] = ("kind", "scenario_id", "episode_id", "semantic_group_id", "counterfactual_group_id", "pair_side")) -> Column:
    """The fields of a source that go along with a sample, as a map of those it has."""
    pairs = F.array(*(F.struct(F.lit(f).alias("key"), _get(f"source.{f}").alias("value")) for f in fields))
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def canonical(lines: DataFrame, tasks: DataFrame) -> DataFrame:
    """Canonical samples against the task catalog: fields, task and version, language, objects, prompt version, ids."""
    rows = records(lines).withColumns({"id": _get("sample_id"), "task_id": _get("task_id"), "version": _get("task_version", "int")})
    known = tasks.select("task_id", "version", F.col("languages").alias("_languages"))
    rows = rows.join(F.broadcast(known), ["task_id", "version"], "left")
    whole = F.when(is_number(_kind("provenance.prompt_version")), _get("provenance.prompt_version", "double"))
    rows = check(
        rows,
        *(F.when(_kind(f).isNull(), f"missing:{f}") for f in REQUIRED),
        *(F.when(_kind(f).isNotNull() & (F.coalesce(_get(f), F.lit("")) == ""), f"empty:{f}") for f in ("sample_id", "state", "question", "domain")),
        F.when(_kind("task_id").isNotNull() & F.col("_languages").isNull(), "task"),
        F.when(F.col("_languages").isNotNull() & ~F.coalesce(F.array_contains("_languages", _get("language")), F.lit(False)), "language"),
        *(F.when(_kind(f).isNotNull() & ~_is(f, "OBJECT"), f) for f in ("source", "labels", "provenance")),
        F.when(_is("provenance", "OBJECT") & ~F.coalesce(_kind("provenance.prompt_version").startswith("BIGINT") | (_kind("provenance.prompt_version").startswith("DECIMAL") & (whole == F.floor(whole)) & ~_kind("provenance.prompt_version").rlike(r",[1-9]")), F.lit(False)), "prompt_version"),
    )
    return unique(rows.drop("_languages"), "id")


def target_errors(output_type: Column, path: str, candidates: Column) -> Column:
    """A hard target has the task's type: true or false, a candidate, or a number."""
    number = F.coalesce(is_number(_kind(path)), F.lit(False)) | F.coalesce(_is(path, "STRING") & _get(path).try_cast("double").isNotNull(), F.lit(False))
    fits = F.when(output_type == "boolean", _is(path, "BOOLEAN")).when(output_type == "choice", _is(path, "STRING") & F.coalesce(F.array_contains(candidates, _get(path)), F.lit(False))).otherwise(number)
    return F.when(~F.coalesce(fits, F.lit(False)), "target")


def soft_target_errors(output_type: Column, path: str, candidates: Column) -> Column:
    """A soft target, where there is one: a probability, probabilities of all candidates that sum to 1, or a number."""
    kind = _kind(path)
    none = kind.isNull() | (kind == "VOID")
    p = F.when(is_number(kind), _get(path, "double")).when(kind == "STRING", _get(path).try_cast("double"))
    each = F.transform_values(_get(path, "map<string,variant>"), lambda _, v: F.when(is_number(F.schema_of_variant(v)), F.try_variant_get(v, "$", "double")))
    values = F.map_values(each)
    covers = (F.size(F.array_except(F.map_keys(each), candidates)) == 0) & (F.size(F.array_except(candidates, F.map_keys(each))) == 0)
    sums = F.abs(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) - 1.0) <= SUM_TOLERANCE
    choice = _is(path, "OBJECT") & covers & F.forall(values, lambda x: F.coalesce(x.between(0.0, 1.0), F.lit(False))) & sums
    fits = F.when(output_type == "boolean", p.between(0.0, 1.0)).when(output_type == "choice", choice).otherwise(p.isNotNull())
    return F.when(~none & ~F.coalesce(fits, F.lit(False)), "soft_target")


def training(lines: DataFrame, tasks: DataFrame, human: bool = False) -> DataFrame:
    """Records that may be learnt from: a known split, no raw inputs, targets of the task's type, and human labels if needed.

    ``id, task_id, split, errors`` among others.
    """
    rows = identified(lines, "sample_id").withColumns({"task_id": _get("task_id"), "version": _get("task_version", "int"), "split": _get("provenance.split")})
    known = tasks.select("task_id", "version", F.col("output_type").alias("_type"), F.col("candidates").alias("_candidates"))
    rows = rows.join(F.broadcast(known), ["task_id", "version"], "left")
    label = parse_decision(F.to_json(_get("labels.human", "variant")))
    rows = rows.withColumn("_label", label)
    required = ()
    if human:
        has = _is("labels.human", "OBJECT")
        required = (
            F.when(~has, "human"),
            F.when(has & (F.col("task_id") == "control.skill") & (F.coalesce(_get("provenance.target_source"), F.lit("")) != "human_review"), "target_source"),
            F.when(has & F.col("_type").isNotNull() & ~F.coalesce(fits_task(F.col("_label"), F.col("_type"), F.col("_candidates")), F.lit(False)), "human_label"),
        )
    known_task = F.col("_type").isNotNull()
    out = check(
        rows, F.when(~known_task, "task"), F.when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "split"), F.when(F.coalesce(_get("provenance.privacy_raw_inputs_stored", "boolean"), F.lit(False)), "raw_inputs"), *required,
        F.when(known_task, target_errors(F.col("_type"), "target", F.col("_candidates"))), F.when(known_task, soft_target_errors(F.col("_type"), "soft_target", F.col("_candidates"))),
    )
    return out.drop("_type", "_candidates", "_label")


def training_counts(rows: DataFrame) -> DataFrame:
    """``kind, name, n``: valid records per split and task, and records per error, in one pass."""
    each = F.when(F.size("errors") == 0, F.array(F.struct(F.lit("split").alias("kind"), F.col("split").alias("name")), F.struct(F.lit("task").alias("kind"), F.col("task_id").alias("name")))).otherwise(
        F.transform("errors", lambda e: F.struct(F.lit("error").alias("kind"), e.alias("name")))
    )
    return rows.select(F.inline(each)).groupBy("kind", "name").agg(F.count("*").alias("n"))


def training_plan(rows: DataFrame, digest: Column, student: dict[str, object], settings: dict[str, object]) -> DataFrame:
    """A plan of one row: the set's size, counts and digest, with the model's and the run's settings; no model is made."""
    c = training_counts(rows).filter("kind <> 'error'")
    maps = c.agg(*(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("name", "n"))))).alias(f"{k}_counts") for k in ("split", "task")))
    as_map = lambda d: F.create_map(*(F.lit(x if isinstance(x, str) else str(x)) for kv in sorted(d.items()) for x in kv))
    n = rows.filter(F.size("errors") == 0).agg(F.count("*").alias("sample_count"), digest.alias("sha256"))
    return n.crossJoin(F.broadcast(maps)).select(
        F.lit("training_plan").alias("record_type"), F.lit("planned").alias("status"), "sha256", "sample_count", "split_counts", "task_counts", as_map(student).alias("student"), as_map(settings).alias("training")
    )


def calibrations(lines: DataFrame, checkpoint_sha256: str) -> DataFrame:
    """``task_id, temperature, error`` of calibration manifests: fitted temperatures, if the manifest is for that checkpoint."""
    rows = check(
        records(lines), F.when(F.coalesce(_get("record_type"), F.lit("")) != "calibration_manifest", "record_type"), F.when(F.coalesce(_get("checkpoint_sha256"), F.lit("")) != checkpoint_sha256, "checkpoint_sha256"),
    )
    tasks = F.explode_outer(F.map_entries(_get("tasks", "map<string,variant>")))
    each = rows.select("errors", tasks.alias("t")).select("errors", F.col("t.key").alias("task_id"), F.try_variant_get("t.value", "$.status", "string").alias("status"), F.try_variant_get("t.value", "$.temperature", "double").alias("temperature"))
    bad = F.array_join("errors", ",")
    return each.filter("size(errors) > 0 or status = 'fitted'").select(F.when(F.size("errors") == 0, F.col("task_id")).alias("task_id"), F.when(F.size("errors") == 0, F.col("temperature")).alias("temperature"), F.nullif(bad, F.lit("")).alias("error")).distinct()


def of_split(df: DataFrame, wanted: str, split: str = "split") -> DataFrame:
    """Rows of a split, or of all."""
    if wanted not in (*SPLITS, "all"):
        raise ValueError(f"split must be all or one of {SPLITS}")
    return df if wanted == "all" else df.filter(F.col(split) == wanted)


def first_rows(df: DataFrame, seq: str, n: int) -> DataFrame:
    """The first ``n`` rows in input order."""
    if n < 1:
        raise ValueError("n must be positive")
    return df.orderBy(seq).limit(n)
