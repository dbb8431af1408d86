"""Line-delimited JSON: numbered lines of files, runs with a manifest, append-only logs, reports and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.contracts import json_type


class ContractError(ValueError):
    """Raised in strict mode if any row violates its contract."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of all lines, blank ones too, with their number in the file.

    A file may be read in several splits: the lines of each are counted, and a split's
    first number follows from those before it (a table of one row per split).
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    splits = text.groupBy("path", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return text.join(splits, ["path", "_at"]).select("path", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")


def read_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, records) of a log of JSON objects whose first record has to be its manifest: ``value`` columns."""
    rows = read_lines(spark, path).filter(F.col("line").rlike(r"\S")).withColumn("value", F.try_parse_json("line"))
    manifest, records, error = split_run(rows)
    if (why := error.first()["error"]) is not None:
        raise ContractError(f"{path}: {why}")
    return manifest, records


def split_run(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, records, error) of ``rows(path, line_no, value)``: ``error`` is one row, null for a proper run."""
    is_manifest = F.coalesce(F.try_variant_get("value", "$.record_type", "string") == "manifest", F.lit(False))
    objects = F.coalesce(json_type(F.col("value"), "$").startswith("OBJECT"), F.lit(False))
    place = F.struct("path", "line_no")
    first = rows.agg(F.count("*").alias("n"), F.min_by(is_manifest, place).alias("headed"), F.count_if(is_manifest).alias("manifests"), F.count_if(~objects).alias("odd"))
    error = first.select(
        F.when(F.col("n") == 0, "run is empty").when(F.col("odd") > 0, "records must be objects").when(~F.col("headed"), "first record must be a manifest").when(F.col("manifests") > 1, "exactly one manifest is needed").alias("error")
    )
    return rows.filter(is_manifest), rows.filter(~is_manifest), error


def append_log(df: DataFrame, path: str, errors: Column | None = None) -> None:
    """Append the rows as JSON lines; rows with ``errors`` (an array) stop it all before anything is written."""
    if errors is not None and (bad := df.filter(F.size(errors) > 0).select(F.array_join(errors, ",").alias("e")).first()):
        raise ContractError(bad["e"])
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Overwrite with keys in order of name; the commit protocol makes the change atomic."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as one JSON object with its keys in order of name."""
    write_json(report.limit(1).coalesce(1), path)


def content_digest(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file: binds a report to what it was made from."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def table_digest(df: DataFrame) -> DataFrame:
    """A digest of a table's rows that doesn't depend on their order or partitions."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("sum"))
