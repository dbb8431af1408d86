"""Quality, calibration and selective-prediction metrics.

Every function takes one row per prediction (or per prediction and class) and the
grouping columns, and aggregates; nothing is collected, and ranks are two-level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .quantiles import nearest, order_statistics
from .ranking import average_rank, ranked

THRESHOLDS = (0.50, 0.70, 0.80, 0.90, 0.95, 0.99)
TINY = 1e-12


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def binary_metrics(df: DataFrame, by: list[str], label: str = "label", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1, Brier score and log loss; 0 where a denominator is 0."""
    y, q = F.col(label), F.col(p)
    said = q >= threshold
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"), _n(said & y).alias("tp"), _n(said & ~y).alias("fp"), _n(~said & y).alias("fn"), _n(~said & ~y).alias("tn"),
        F.round(F.avg(F.pow(q - y.cast("int"), F.lit(2.0))), 6).alias("brier"),
        F.round(F.avg(-F.ln(F.greatest(F.when(y, q).otherwise(1 - q), F.lit(TINY)))), 6).alias("nll"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by, "n", ratio(tp + F.col("tn"), F.col("n")).alias("accuracy"), ratio(tp, tp + fp, empty=0.0).alias("precision"), ratio(tp, tp + fn, empty=0.0).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn, empty=0.0).alias("f1"), "brier", "nll",
    )


def _error_of_bins(df: DataFrame, by: list[str], label: Column, p: Column, out: str) -> DataFrame:
    per = df.groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.avg(p).alias("_c"), F.avg(label.cast("double")).alias("_a"))
    return per.groupBy(*by).agg(F.round(F.sum(F.col("_n") * F.abs(F.col("_a") - F.col("_c"))) / F.sum("_n"), 6).alias(out))


def ece(df: DataFrame, by: list[str], label: str = "label", p: str = "p", bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width; the last holds its right end."""
    binned = df.withColumn("_bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    return _error_of_bins(binned, by, F.col(label), F.col(p), "ece")


def adaptive_ece(df: DataFrame, by: list[str], tie: list[str], label: str = "label", p: str = "p", bins: int = 10) -> DataFrame:
    """Calibration error over bins of equal numbers of rows, in order of p, then ``tie``."""
    b = F.least(F.lit(bins), F.col("of"))
    binned = ranked(df.select(*by, p, *tie, label), by, p, tie, ascending=True).withColumn("_bin", F.floor((F.col("rank") * b - 1) / F.col("of")))
    return _error_of_bins(binned, by, F.col(label), F.col(p), "adaptive_ece")


def auroc(df: DataFrame, by: list[str], label: str = "label", p: str = "p") -> DataFrame:
    """Probability that a positive scores above a negative, ties half; null with one class only."""
    sums = average_rank(df, by, p, "_rank").groupBy(*by).agg(
        F.sum(F.when(F.col(label), F.col("_rank"))).alias("s"), _n(F.col(label)).alias("pos"), _n(~F.col(label)).alias("neg")
    )
    return sums.select(*by, F.round(F.try_divide(F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2.0, (F.col("pos") * F.col("neg")).cast("double")), 6).alias("auroc"))


def auprc(df: DataFrame, by: list[str], tie: list[str], label: str = "label", p: str = "p") -> DataFrame:
    """Average precision; ties by ``tie``."""
    at = ranked(df.select(*by, p, *tie, F.col(label).cast("int").alias("_y")), by, p, tie, "_y")
    return at.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col("_y") * F.col("cumulative") / F.col("rank")), F.sum("_y").cast("double")), 6).alias("auprc"))


def risk_coverage_curve(df: DataFrame, by: list[str], tie: list[str], correct: str = "correct", confidence: str = "confidence") -> DataFrame:
    """Coverage and risk after each row, by falling confidence."""
    at = ranked(df.select(*by, confidence, *tie, F.col(correct).cast("int").alias("_y")), by, confidence, tie, "_y")
    return at.select(
        *by, *tie, F.col("rank").cast("bigint").alias("position"), F.round(F.col("rank") / F.col("of"), 6).alias("coverage"),
        F.round(1 - F.col("cumulative") / F.col("rank"), 6).alias("risk"), F.round(confidence, 6).alias("threshold"),
    )


def threshold_risk_coverage(df: DataFrame, by: list[str], thresholds: tuple[float, ...] = THRESHOLDS, correct: str = "correct", confidence: str = "confidence") -> DataFrame:
    """Accepted rows, coverage, accuracy and risk at fixed thresholds; null accuracy where none is accepted.

    One pass of conditional counts; thresholds are unfolded after aggregation.
    """
    c, y = F.col(confidence), F.col(correct)
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.array(*(F.struct(F.lit(t).alias("threshold"), _n(c >= t).alias("accepted"), _n((c >= t) & y).alias("right")) for t in thresholds)).alias("at"),
    )
    rows = counts.select(*by, "n", F.inline("at"))
    accuracy = ratio(F.col("right"), F.col("accepted"))
    return rows.select(*by, "threshold", "accepted", ratio(F.col("accepted"), F.col("n")).alias("coverage"), accuracy.alias("accuracy"), F.round(1 - accuracy, 6).alias("risk"))


def choice_rows(long: DataFrame, key: list[str], label: str = "label", cls: str = "class", p: str = "p") -> DataFrame:
    """From one row per class to one per prediction: selected, second, p of label, squares.

    Selected is the class of greatest p, the lesser name first.
    """
    best = F.array_sort(F.collect_list(F.struct((-F.col(p)).alias("minus"), F.col(cls).alias("class"))))
    return long.groupBy(*key, label).agg(
        best.alias("_o"), F.max(F.when(F.col(cls) == F.col(label), F.col(p))).alias("p_label"), F.sum(F.pow(F.col(p) - F.when(F.col(cls) == F.col(label), 1.0).otherwise(0.0), F.lit(2.0))).alias("squares")
    ).select(
        *key, label, F.col("_o")[0]["class"].alias("selected"), (-F.col("_o")[0]["minus"]).alias("confidence"), F.coalesce(F.get(F.col("_o"), F.lit(1))["class"], F.lit("")).alias("second"),
        F.coalesce("p_label", F.lit(0.0)).alias("p_label"), "squares",
    )


def choice_metrics(rows: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Accuracy, top-2 accuracy, multiclass Brier score and log loss of :func:`choice_rows`."""
    hit = F.col("selected") == F.col(label)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"), F.round(F.avg((hit | (F.col("second") == F.col(label))).cast("double")), 6).alias("top2_accuracy"),
        F.round(F.avg("squares"), 6).alias("brier"), F.round(F.avg(-F.ln(F.greatest("p_label", F.lit(TINY)))), 6).alias("nll"),
    )


def class_report(rows: DataFrame, label: str = "label", predicted: str = "selected") -> DataFrame:
    """Per class: support, predictions, precision, recall, F1; a class counts if it is a label or a prediction."""
    sides = rows.select(F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("l"), F.lit(0).alias("s"), (F.col(label) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("l"), F.lit(1).alias("s"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    n = sides.groupBy("class").agg(F.sum("l").alias("support"), F.sum("s").alias("predicted"), F.sum("hit").alias("hits"))
    return n.select(
        "class", "support", "predicted", "hits", ratio(F.col("hits"), F.col("predicted"), empty=0.0).alias("precision"), ratio(F.col("hits"), F.col("support"), empty=0.0).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"), empty=0.0).alias("f1"),
    )


def macro_f1(rows: DataFrame, label: str = "label", predicted: str = "selected") -> DataFrame:
    report = class_report(rows, label, predicted)
    exact = F.coalesce(F.try_divide(2.0 * F.col("hits"), (F.col("support") + F.col("predicted")).cast("double")), F.lit(0.0))
    return report.agg(F.count("*").alias("classes"), F.round(F.avg(exact), 6).alias("macro_f1"))


def confusion(rows: DataFrame, classes: tuple[str, ...], label: str = "label", predicted: str = "selected") -> DataFrame:
    """Counts of every pair of classes, zeros too. The grid is of the given classes, so of fixed size."""
    spark = rows.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, classes))).alias("target")).select("target", F.explode(F.array(*map(F.lit, classes))).alias("predicted"))
    n = rows.groupBy(F.col(label).alias("target"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(n, ["target", "predicted"], "left").select("target", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def score_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute and root mean square error, coverage and mean width of intervals."""
    e = F.col("value") - F.col("target")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(F.avg(F.col("target").between(F.col("lower"), F.col("upper")).cast("double")), 6).alias("interval_coverage"), F.round(F.avg(F.col("upper") - F.col("lower")), 6).alias("mean_width"),
    )


def spearman(df: DataFrame, by: list[str], x: str = "target", y: str = "value") -> DataFrame:
    """Correlation of mean ranks; null if one side doesn't vary. Equal pairs are counted first and ranked once."""
    pairs = df.groupBy(*by, x, y).agg(F.count("*").alias("w"))
    r = average_rank(average_rank(pairs, by, x, "rx", weight="w"), by, y, "ry", weight="w")
    a, b, w = F.col("rx"), F.col("ry"), F.col("w")
    s = r.groupBy(*by).agg(F.sum(w).cast("double").alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    spread = F.sqrt((F.col("n") * F.col("aa") - F.col("a") * F.col("a")) * (F.col("n") * F.col("bb") - F.col("b") * F.col("b")))
    return s.select(*by, F.round(F.try_divide(F.col("n") * F.col("ab") - F.col("a") * F.col("b"), spread), 6).alias("spearman"))


def class_calibration(long: DataFrame, cls: str = "class", label: str = "label", p: str = "p") -> DataFrame:
    """Expected calibration error of each class's probability, from one row per prediction and class."""
    rows = long.select(F.col(cls).alias("class"), (F.col(label) == F.col(cls)).alias("label"), F.col(p).alias("p"))
    return ece(rows, ["class"])


def latency_report(df: DataFrame, by: list[str], value: str = "latency_ms") -> DataFrame:
    """p50, p95, p99 by nearest rank, maximum and mean, to 3 digits; ``n`` counts rows without a value too."""
    found = order_statistics(df, by, value, {f"p{p}": nearest(p) for p in (50, 95, 99)})
    return found.select(*by, F.col("rows").alias("n"), *(F.round(c, 3).alias(c) for c in ("p50", "p95", "p99")), F.round("greatest", 3).alias("max"), F.round("mean", 3).alias("mean"))


def accuracy_summary(df: DataFrame, by: str, correct: str = "correct", accepted: str = "accepted") -> DataFrame:
    """Accuracy, accepted accuracy and coverage, overall (null group) and per group, in one pass."""
    sets = df.groupingSets([[by], []], by).agg(
        F.count("*").alias("n"), F.count_if(F.col(correct)).alias("right"), F.count_if(F.col(accepted)).alias("accepted"), F.count_if(F.col(accepted) & F.col(correct)).alias("accepted_right")
    )
    return sets.select(
        F.coalesce(by, F.lit("all")).alias("grp"), "n", ratio(F.col("right"), F.col("n")).alias("accuracy"), ratio(F.col("accepted"), F.col("n")).alias("coverage"), ratio(F.col("accepted_right"), F.col("accepted")).alias("accepted_accuracy")
    )
