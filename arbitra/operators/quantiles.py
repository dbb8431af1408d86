"""Exact order statistics of groups of any size, by repeated histogram refinement.

``percentile_disc`` gathers all distinct values of a group in one task. Here a wanted
rank is found in passes over the values, of which each counts a range's values in at most
some 2^16 bins and descends into the bin that holds the rank: bins of equal ratio first,
then twice bins of equal width within what is left, then the values themselves, of which
no more than about 2^16 doubles lie that close together. Counters are added up in the
tasks before they are shuffled, so that no task sees more than a bounded number of them
for a group, however many values it has and however they are distributed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of equal width in a pass, and of equal ratio for each power of two.
BINS, PER_OCTAVE = 1 << 16, 15

Rank = Callable[[Column], Column]


def nearest(percent: int) -> Rank:
    """The rank of a percentage: the least k with k / n at that or more."""
    if not 0 < percent <= 100:
        raise ValueError("a percentage lies above 0 and up to 100")
    return lambda n: F.floor((n * percent + 99) / 100)


def upper_median(n: Column) -> Column:
    """The rank of the middle value, the upper one of two."""
    return F.floor(n / 2) + 1


def _ratio_bin(v: Column) -> Column:
    """A number that never falls as the value rises: its sign, and the logarithm of its size in steps; NaN comes last."""
    size = F.greatest(F.lit(0), F.floor((F.log2(F.abs(v)) + 1075) * PER_OCTAVE)).cast("int") + 1
    finite = F.when(v == 0, 0).when(v > 0, size).otherwise(-size)
    return F.when(F.isnan(v), 1 << 17).when(v == float("inf"), 1 << 16).when(v == float("-inf"), -(1 << 16)).otherwise(finite)


def _width_bin(v: Column, low: Column, high: Column) -> Column:
    """One of ``BINS`` bins of equal width from ``low`` to ``high``, which are both taken and finite or equal."""
    return F.when(low == high, 0).otherwise(F.least(F.lit(BINS - 1), F.floor((v - low) / (high / 2 - low / 2) * (BINS / 2)).cast("int")))


def _same(by: list[str]) -> tuple[dict[str, str], Column]:
    """Other names for keys, and the condition that they are equal, nulls too."""
    names = {c: f"_by_{k}" for k, c in enumerate(by)}
    same = F.lit(True)
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    return names, same


def _ranges(counts: DataFrame, by: list[str]) -> DataFrame:
    """Of each group's bins, those that hold its ranks: an array of (rank's number, rank within the bin, least and greatest value)."""
    before = Window.partitionBy(*by, "_k").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    held = placed.where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_n")))
    one = F.struct(F.col("_k").alias("k"), (F.col("_rank") - F.col("_before")).alias("rank"), F.col("_low").alias("low"), F.col("_high").alias("high"))
    return held.groupBy(*by).agg(F.collect_list(one).alias("_ranges"))  # one a rank


def _of(ranges: str, number: int) -> Column:
    """The entry of a rank's number, null if it has none."""
    return F.try_element_at(F.filter(ranges, lambda r: r["k"] == number), F.lit(1))


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """``by``, ``rows``, the values of the given ranks (from 1), and ``n, greatest, mean`` of the values that aren't null.

    A row for each group, null keys being one; without ``by`` one row, of no rows too. A
    group without values, or with fewer than a rank says, has a null there. NaN counts as
    greatest, equal values count each. ``value`` is taken as a double.
    """
    names = list(ranks)
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    counters = (F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    first = rows.withColumn("_bin", _ratio_bin(F.col("_v"))).groupBy(*by, "_bin").agg(*counters, F.sum("_v").alias("_sum"), F.count("*").alias("_rows"))
    sizes = first.groupBy(*by).agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.max("_high").alias("greatest"), F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean"))
    other, same = _same(by)
    wanted = sizes.select(*(F.col(c).alias(other[c]) for c in by), F.posexplode(F.array(*(ranks[k](F.col("n")).cast("long") for k in names))).alias("_k", "_rank"))
    state = _ranges(first.join(wanted, same).drop(*other.values()), by)
    for last in (False, False, True):
        side = state.withColumnsRenamed(other)
        joined = (rows.join(side, same) if by else rows.crossJoin(F.broadcast(side))).select(*by, "_v", F.explode(F.filter("_ranges", lambda r: F.col("_v").between(r["low"], r["high"]))).alias("_r"))
        at = F.col("_v") if last else _width_bin(F.col("_v"), F.col("_r.low"), F.col("_r.high"))
        counts = joined.groupBy(*by, F.col("_r.k").alias("_k"), F.col("_r.rank").alias("_rank"), at.alias("_bin")).agg(*counters)
        state = _ranges(counts, by)
    found = state.select(*(F.col(c).alias(other[c]) for c in by), *(_of("_ranges", i)["low"].alias(k) for i, k in enumerate(names)))
    joined = sizes.join(found, same, "left").drop(*other.values()) if by else sizes.crossJoin(F.broadcast(found.agg(*(F.first(k).alias(k) for k in names))))
    return joined.select(*by, "rows", "n", *names, "greatest", "mean")
