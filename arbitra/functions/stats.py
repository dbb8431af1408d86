"""Intervals, probabilities and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Fixed value: the two-sided 95 % quantile of the normal distribution.
Z95 = 1.959963984540054


def ratio(part: Column, whole: Column, digits: int = 6, empty: float | None = None) -> Column:
    """part / whole rounded; ``empty`` (default null) where whole is 0."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty).cast("double")), digits)


def wilson(successes: Column | str, total: Column | str) -> tuple[Column, Column]:
    """Lower and upper bound of the 95 % interval, within 0 and 1; null without trials."""
    x, n = col(successes).cast("double"), F.when(col(total) >= 1, col(total).cast("double"))
    z2 = Z95 * Z95
    middle, reach = x + z2 / 2, Z95 * F.sqrt(F.try_divide(x * (n - x), n) + z2 / 4)
    some = n.isNotNull()
    return (
        F.when(some, F.round(F.greatest(F.lit(0.0), (middle - reach) / (n + z2)), 6)),
        F.when(some, F.round(F.least(F.lit(1.0), (middle + reach) / (n + z2)), 6)),
    )


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def nll(logits: Column, label: Column, temperature: Column) -> Column:
    """Negative log-likelihood of the label (counted from 0) by log-sum-exp."""
    top = F.array_max(logits) / temperature
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x / temperature - top))
    return top + F.ln(total) - F.element_at(logits, label.cast("int") + 1) / temperature


def half_width(x: Column) -> Column:
    """Half the sigmoid: the reach of a score's interval."""
    return 0.5 / (1 + F.exp(-x))


def score_interval(raw: Column, width: Column) -> Column:
    """``value, lower, upper`` of a score's head: clamped to 0 and 1, like its interval."""
    value, reach = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), half_width(width)
    return F.struct(value.alias("value"), F.greatest(F.lit(0.0), value - reach).alias("lower"), F.least(F.lit(1.0), value + reach).alias("upper"))
