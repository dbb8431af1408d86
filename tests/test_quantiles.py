"""Order statistics against sorting, for values that lie close together, far apart, or are equal."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from arbitra.operators import metrics
from arbitra.operators.quantiles import nearest, order_statistics, upper_median

RANKS = {"p50": nearest(50), "p95": nearest(95), "p99": nearest(99), "median": upper_median, "first": lambda n: F.lit(1), "last": lambda n: n, "none": lambda n: n + 1}


def expected(values):
    x = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    n = len(x)
    at = lambda k: x[k - 1] if 1 <= k <= n else None
    return (n, at(-(-n * 50 // 100)), at(-(-n * 95 // 100)), at(-(-n * 99 // 100)), at(n // 2 + 1), at(1), at(n), None)


def groups():
    r = random.Random(3)
    return {
        "close": [0.5 + r.random() * 1e-13 for _ in range(900)] + [r.random() for _ in range(50)],
        "far": [math.ldexp(r.random() - 0.5, r.randint(-1070, 1020)) for _ in range(700)],
        "ties": [1.0] * 500 + [2.0] * 20 + [0.0, -0.0],
        "odd": [float("nan"), float("inf"), float("-inf"), -1.5, None, 5e-324, -5e-324, 1.7e308, -1.7e308],
        "one": [7.25], "nulls": [None, None], None: [3.0, 1.0, 2.0, None],
    }


def same(a, b):
    return all(x == y or (x is not None and y is not None and math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True))


def test_equals_sorting(spark):
    data = groups()
    df = spark.createDataFrame([(g, v, "x") for g, vs in data.items() for v in vs], "g string, v double, _n string").repartition(5)
    got = {r["g"]: (r["n"], *(r[k] for k in RANKS)) for r in order_statistics(df, ["g"], "v", RANKS).collect()}
    assert got.keys() == data.keys()
    for g, values in data.items():
        assert same(got[g], expected(values)), g


def test_without_groups(spark):
    values = [v for vs in groups().values() for v in vs if v is None or math.isfinite(v)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = order_statistics(df, [], "v", RANKS).collect()
    assert len(row) == 1 and same((row[0]["n"], *(row[0][k] for k in RANKS)), expected(values))
    none = order_statistics(df.where("false"), [], "v", RANKS).collect()
    assert [tuple(x) for x in none] == [(0, 0, *[None] * (len(RANKS) + 2))]
    assert order_statistics(df.withColumn("g", F.lit(1)).where("false"), ["g"], "v", RANKS).count() == 0


def test_no_task_gets_all_values(spark):
    """200,000 different values of one group: the most rows that meet for a group are counters."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.lit(0.3) + F.col("id") * 1e-12).alias("v"))
    plan = order_statistics(df, ["g"], "v", {"p95": nearest(95)})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list(v" not in plan
    first = df.groupBy(F.expr("floor((log2(v) + 1075) * 15)")).count().count()
    assert first < 100
    assert order_statistics(df, ["g"], "v", {"p95": nearest(95)}).first()["p95"] == 0.3 + 189_999 * 1e-12


@pytest.mark.parametrize("percent", [0, 101])
def test_percentages(percent):
    with pytest.raises(ValueError):
        nearest(percent)


def test_latency_report(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0004), ("b", None)], "g string, latency_ms double")
    got = sorted(map(tuple, metrics.latency_report(df, ["g"]).collect()))
    assert got == [("a", 3, 2.0, 2.0, 2.0, 2.0, 1.667), ("b", 1, None, None, None, None, None)]
