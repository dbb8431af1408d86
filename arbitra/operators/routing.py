"""Decision rules, acceptance, the router's cascade, shadows, traffic and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The terms of the high-precision rules.
COMMITMENT = ["결정", "하기로", "선호", "좋아해", "선택", "싶다", "원한다", "기로", "prefer", "would like", "we decided", "will ", "must ", "remember"]
NEGATED = ["don't want", "do not want", "would not like", "not prefer", "원하지", "싶지", "않기로", "하지 않기로", "결정하지"]
GREETING = ["안녕", "반가", "고마워", "감사", "hello", "hi", "thanks", "thank you"]
STYLE = ["제목", "title", "스타일", "style", "서식", "format", "공백", "spacing", "문법"]
CHANGE = r"(?iU)(?:에서\s+.+?\s*로\s*(?:변경|바꾸|바뀌|수정)|\b(?:changed|change|updated|update)\b)"
LONGEST_GREETING, LONGEST_INPUT = 120, 12_000


def rule_match(task: Column, state: Column) -> Column:
    """``rule_id, value, probability`` of the rule that fires on the state, else null.

    The trimmed and the lowered text are made once and named in all tests.
    """

    def hit(name: str, value: bool, p: float) -> Column:
        return F.struct(F.lit(name).alias("rule_id"), F.lit(value).alias("value"), F.lit(p).alias("probability"))

    def any_of(text: Column, terms: list[str]) -> Column:
        return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))

    def first(x: Column) -> Column:
        low, text = x["low"], x["text"]
        remember = (
            F.when(any_of(low, NEGATED), hit("remember.explicit_rejection", False, 0.97))
            .when((F.length(text) <= LONGEST_GREETING) & any_of(low, GREETING) & ~any_of(low, COMMITMENT), hit("remember.greeting_only", False, 0.99))
            .when(any_of(low, COMMITMENT), hit("remember.explicit_commitment", True, 0.97))
        )
        wiki = F.when(any_of(low, STYLE), hit("wiki.style_only", False, 0.97)).when(text.rlike(CHANGE), hit("wiki.factual_change", True, 0.95))
        return F.when(task == "memory.remember_worthy", remember).when(task == "wiki.semantic_change", wiki)

    trimmed = F.trim(state)
    return F.element_at(F.transform(F.array(F.struct(trimmed.alias("text"), F.lower(trimmed).alias("low"))), first), 1)


def accepted_boolean(value: Column, p: Column, auto_true: Column | float = 0.92, auto_false: Column | float = 0.08) -> Column:
    true, false = (x if isinstance(x, Column) else F.lit(x) for x in (auto_true, auto_false))
    return F.when(value, p >= true).otherwise(p >= 1.0 - false)


def accepted(kind: Column, value: Column, p: Column, abstained: Column, auto_true: Column | float = 0.92, auto_false: Column | float = 0.08, minimum: Column | float = 0.9) -> Column:
    """Whether the task's thresholds accept an answer: never an abstention, always a score.

    ``p`` is the probability of the answer itself, for a choice that of the selected one.
    """
    least = minimum if isinstance(minimum, Column) else F.lit(minimum)
    return ~abstained & F.when(kind == "boolean", accepted_boolean(value, p, auto_true, auto_false)).when(kind == "choice", p >= least).otherwise(F.lit(True))


def accepted_by_confidence(kind: Column, c: Column, minimum: float, allow_score: bool = False) -> Column:
    return (c >= minimum) & ((kind != "score") | F.lit(allow_score))


def ingestion(state: Column, abstained: Column, value: Column) -> Column:
    """What to do with an input: ignored, retain_raw, review, or extract."""
    return (
        F.when(F.coalesce(F.trim(state), F.lit("")) == "", "ignored")
        .when(F.length(state) > LONGEST_INPUT, "retain_raw")
        .when(F.coalesce(abstained, F.lit(True)), "review")
        .when(value, "extract")
        .otherwise("retain_raw")
    )


def cascade(stages: list[tuple[str, Column, Column]]) -> Column:
    """``route, value, abstained``: the first accepted stage; else the last answer, abstained, for a human.

    A stage is (route, struct or null, accepted).
    """
    last = F.coalesce(*(v for _, v, _ in reversed(stages)))
    out = F.struct(F.lit("human").alias("route"), last.alias("value"), F.lit(True).alias("abstained"))
    for name, value, ok in reversed(stages):
        taken = F.struct(F.lit(name).alias("route"), value.alias("value"), F.lit(False).alias("abstained"))
        out = F.when(F.coalesce(ok, F.lit(False)) & value.isNotNull(), taken).otherwise(out)
    return out


def request_route(df: DataFrame, request: str, route: str) -> DataFrame:
    """One route per request: the common one, or mixed."""
    return df.groupBy(request).agg(F.when(F.count_distinct(route) == 1, F.min(route)).otherwise("mixed").alias("route"), F.count("*").alias("questions"))


def shadow(primary: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Both answers' signatures per question, and whether they agree; one may be missing."""
    a, b = primary.withColumnRenamed("signature", "primary_signature"), other.withColumnRenamed("signature", "shadow_signature")
    return a.join(b, key, "full_outer").withColumn("agree", F.coalesce(F.col("primary_signature") == F.col("shadow_signature"), F.lit(False)))


def traffic_snapshot(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests, abstentions, rate and mean confidence; zeros without traffic."""
    n = df.groupBy(*(by or [])).agg(F.count("*").alias("requests"), F.count_if("abstained").alias("abstained"), F.sum("confidence").alias("_c"))
    part = lambda x: F.round(F.coalesce(F.try_divide(x.cast("double"), F.col("requests").cast("double")), F.lit(0.0)), 6)
    return n.select(*(by or []), "requests", "abstained", part(F.col("abstained")).alias("abstain_rate"), part(F.col("_c")).alias("mean_confidence"))


def route_counts(df: DataFrame) -> DataFrame:
    """``route, requests, abstained`` of requests."""
    return df.groupBy("route").agg(F.count("*").alias("requests"), F.count_if("abstained").alias("abstained"))


def route_shares(counts: DataFrame) -> DataFrame:
    """Share of each route, of counters that may have several rows a route; there are few routes."""
    n = counts.groupBy("route").agg(F.sum("requests").alias("n"))
    total = n.agg(F.greatest(F.sum("n"), F.lit(1)).alias("_t"))
    return n.crossJoin(F.broadcast(total)).select("route", "n", (F.col("n") / F.col("_t")).alias("share"))


def drift(baseline: DataFrame, current: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Shift of each route's share and of the abstention rate between two sets of requests, and whether it is beyond the threshold."""
    return drift_of_counts(route_counts(baseline), route_counts(current), threshold)


def drift_of_counts(baseline: DataFrame, current: DataFrame, threshold: float = 0.10) -> DataFrame:
    """:func:`drift` of what is counted already: ``route, requests, abstained``, as windows of a stream have them."""
    a = route_shares(baseline).select("route", F.col("share").alias("_a"))
    b = route_shares(current).select("route", F.col("share").alias("_b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    routes = a.join(b, "route", "full_outer").select(F.concat(F.lit("route:"), F.col("route")).alias("measure"), (zero(F.col("_b")) - zero(F.col("_a"))).alias("_s"))
    rate = lambda d, n: d.agg(zero(F.try_divide(F.sum("abstained").cast("double"), F.sum("requests").cast("double"))).alias(n))
    abstain = rate(baseline, "_a").crossJoin(rate(current, "_b")).select(F.lit("abstain_rate").alias("measure"), (F.col("_b") - F.col("_a")).alias("_s"))
    return abstain.unionByName(routes).select("measure", F.round("_s", 6).alias("shift"), (F.abs(F.col("_s")) > threshold).alias("drifted"))
