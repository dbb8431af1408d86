"""Ranks, running sums and positions over groups of any size.

A window over a whole group puts the group in one task. Here rows are range-partitioned
by their whole order instead, by Spark's sample of it, so that partitions are even
wherever scores lie close together, and rows of one score are cut by what breaks ties.
The partitions are written once, with each row's place in its partition; one row per
partition and group then tells how many rows come before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
_ROW_BITS = 33


def spread(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``_part`` and ``_row``: range partitions along ``order``, and the place in them from 0.

    The result is a written table, so that all that is computed from it sees one cut.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = parts.withColumn("_id", F.monotonically_increasing_id())
    return written(placed.select(*df.columns, F.shiftright("_id", _ROW_BITS).cast("int").alias("_part"), F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1).alias("_row")), "spread")


def _before(placed: DataFrame, by: list[str], *sums: Column) -> DataFrame:
    """Of each part of a group: the first row's place, and what the group's earlier parts add up to.

    A group has as many of these rows as it has partitions.
    """
    parts = placed.groupBy(*by, "_part").agg(F.min("_row").alias("_first"), *sums)
    names = [c for c in parts.columns if c not in {*by, "_part", "_first"}]
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return parts.select(*by, "_part", "_first", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in names), *(F.sum(c).over(whole).alias(f"{c}_of") for c in names))


def ranked(df: DataFrame, by: list[str], score: str, tie: list[str], value: str | None = None, ascending: bool = False) -> DataFrame:
    """``df`` with ``rank`` (from 1), ``of`` (rows of the group), and ``cumulative`` of ``value``.

    ``tie`` makes the order total. Rows without a score or a key are left out.
    """
    number = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) if value else F.lit(0.0)
    rows = df.where(F.col(score).isNotNull()).dropna(subset=by) if by else df.where(F.col(score).isNotNull())
    order = [F.col(score).asc() if ascending else F.col(score).desc(), *map(F.col, tie)]
    placed = spread(rows.withColumn("_v", number), [*map(F.col, by), *order])
    before = _before(placed, by, F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    joined = placed.join(before, [*by, "_part"])
    rank = F.col("_n_before") + F.col("_row") - F.col("_first") + 1
    if value:
        inside = Window.partitionBy(*by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
        cumulative = F.col("_s_before") + F.sum("_v").over(inside)
    else:
        cumulative = F.lit(0.0)
    return joined.select(*df.columns, rank.alias("rank"), F.col("_n_of").alias("of"), cumulative.alias("cumulative"))


def average_rank(df: DataFrame, by: list[str], score: str, out: str, weight: str | None = None) -> DataFrame:
    """``df`` with the ascending rank of the score; ties share their mean rank.

    Ties are merged before anything is sorted: counts per distinct score are ranked, not
    rows. ``weight`` says for how many a row stands. Rows without a score or a key are left out.
    """
    counts = df.groupBy(*by, score).agg((F.sum(weight) if weight else F.count("*")).alias("_n")).where(F.col(score).isNotNull())
    placed = spread(counts, [*map(F.col, by), F.col(score)])
    before = _before(placed, by, F.sum("_n").alias("_t"))
    inside = Window.partitionBy(*by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    ranks = placed.join(before, [*by, "_part"]).withColumn("_c", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return df.join(ranks.select(*by, score, (F.col("_t_before") + F.col("_c") + (F.col("_n") + 1) / 2.0).alias(out)), [*by, score])


def latest(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The row of greatest ``seq`` per key, by aggregation with map-side combine."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), seq).alias("_r")).select(*key, "_r.*").select(*df.columns)


def earliest(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The row of least ``seq`` per key."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*others), seq).alias("_r")).select(*key, "_r.*").select(*df.columns)


def positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``position`` (from 1) in the whole order, without a sort in one task."""
    placed = spread(df, order)
    # one row per partition
    before = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_row") + 1).alias("position"))
