"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .html_text import main_text
from .line_dedup import dedup_lines
from .media import media_columns, store
from .mixing import mixing_rates
from .near_dedup import near_duplicates
from .periodic import periodic_runs
from .pieces import encode_and_decode
from .pii import pseudonyms
from .quality import fit_quality, score_quality
from .session import table
from .threads import quoting, reply_ordered
from .token_counts import token_counts
from .yinyang import cluster_vectors, integer_vectors, start_vectors

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and bytes of every whole text."""
    return token_counts(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every whole text; nothing but the text goes into it."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without lines that stand elsewhere."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as grey samples, and read back."""
    stored = store(table(spark, sf_dir, "documents"))
    return media_columns(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotations, in reply order."""
    return reply_ordered(table(spark, sf_dir, "conversations"))


def op7_quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of conversations that quote: made from the given ones, which hold no quotation."""
    return reply_ordered(quoting(table(spark, sf_dir, "conversations")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of every document for the target weights."""
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with pseudonyms; the key is the session's ``spark.arbitra.pii.key``, drawn anew for the session where that is unset."""
    name = "spark.arbitra.pii.key"
    if not spark.conf.get(name, ""):
        spark.conf.set(name, secrets.token_hex(32))
    return pseudonyms(table(spark, sf_dir, "documents"), spark.conf.get(name))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


def repeating(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by the checksum of its id, repeats a part of its words to its end."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    check = F.crc32(F.col("doc_id").cast("string"))
    # each step's values are bound once, as the element of an array
    bound = F.array(F.struct(words.alias("w"), F.floor(check / 10).alias("g")))
    bound = F.transform(bound, lambda s: F.struct(s["w"].alias("w"), s["g"].alias("g"), F.size(s["w"]).alias("n")))
    bound = F.transform(bound, lambda s: F.struct(s["w"].alias("w"), s["g"].alias("g"), s["n"].alias("n"), F.when(s["n"] > 0, s["g"] % s["n"]).cast("int").alias("a")))
    bound = F.transform(bound, lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), s["a"].alias("a"), (1 + F.floor((s["n"] - s["a"]) / (3 + s["g"] % 8))).cast("int").alias("p")))

    def told(s: Column) -> Column:
        times = (1 + F.floor((s["n"] - s["a"]) / s["p"])).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(s["w"], s["a"] + 1, s["p"]), times)), 1, s["n"] - s["a"])
        return F.when(s["n"] > 0, F.array_join(F.concat(F.slice(s["w"], 1, s["a"]), tail), " "))

    told_text = F.transform(bound, told)[0]
    return docs.select("doc_id", F.when(check % 10 == 0, F.coalesce(told_text, "text")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every text, of which a tenth is made to repeat, and digests of what they leave."""
    found = periodic_runs(repeating(table(spark, sf_dir, "documents")), exponent=4, least=6)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return (
        found.withColumn("longest", longest)
        .withColumn("told", F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(F.lit("")))
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
            F.expr("(1000 * longest.length) div (-longest.period)").alias("exponent_milli"), F.sha2("told", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 finite components, of 40 clusters after 5 rounds."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), 64, 256)
    start = start_vectors(vectors, F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256), 40, 64)
    found, centroids = cluster_vectors(vectors, start, 5)
    named = spark.createDataFrame([(k, sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    # a row for each of the 40 clusters
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = F.broadcast(sums.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(found.agg(F.sum("distance").alias("inertia")))))
    return found.join(sums, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's pieces and of the text that they give back."""
    coded = encode_and_decode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_token_counts, op2_quality_classifier, op3_line_dedup, op4_media_columns, op5_benchmark_decontamination,
        op6_minhash_near_dedup, op7_chat_formatting, op7_quoted_conversations, op8_source_mixing, op9_pii_pseudonyms, op10_html_extraction,
        op11_periodic_runs, op12_centroid_clusters, op13_piece_round_trip,
    )
}
