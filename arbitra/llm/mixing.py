"""Mixing to target weights with soft memberships, by DataFrame operations alone.

1. Domains come from the table of labels: toxic (toxic = 1), junk (quality = 0),
   clean (the rest). On a bounded sample of labelled documents, a naive Bayes
   classifier takes the ``VOCABULARY`` features (words, and classes of capitals,
   signs and distinctness) that tell most about the domain.
2. Every document gets its posterior over domains: its distinct words meet the
   broadcast weights (``VOCABULARY`` + 1 rows at most) and are summed up before the
   shuffle.
3. Rates r >= 0 per document minimise the weighted squares of what the expected
   tokens of each domain, sum(r * tokens * posterior), miss the targets by. Projected
   gradient from r = 1, preconditioned by the Gram matrix of the domains over documents
   whose rate isn't zero: a step moves a document's rate by its posterior times the
   solved misses, and is halved while it makes the misses greater. A rate is a fold of
   the steps so far, so that an iteration is one aggregate over (tokens, posterior),
   and only a few numbers per pair of domains go to the driver.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import materialize

DOMAINS = ("clean", "toxic", "junk")
#: Shares of expected tokens.
TARGETS = {"clean": 0.96, "toxic": 0.02, "junk": 0.02}
#: Labelled documents to learn from, at most; features of the classifier, at most.
SAMPLE, VOCABULARY = 8000, 400
#: Least number of sample documents that have a feature.
LEAST = 4
ITERATIONS, HALVINGS, CLOSE = 30, 6, 1e-6
#: Misses, as a share of all tokens, that are told of.
TELLING = 1e-3
BIAS = "\u0001"
_CAPITALS, _SIGNS = "[A-Z]", r"[!-/<-@\[-`{-~&&[^'\-,.()]]"


def _level(part: Column, whole: Column) -> Column:
    """The root of a share in tenths; each side is evaluated once."""
    return F.round(F.sqrt(part / F.greatest(whole, F.lit(1))) * 10).cast("int").cast("string")


def with_features(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``features`` (distinct words, shapes and the bias) and ``n_tokens`` in place of the text.

    One projection for each level of use: nothing costly is evaluated twice.
    """
    others = [c for c in rows.columns if c != text]
    split = rows.select(
        *others, F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+").alias("_w"), F.length(text).alias("_n"),
        F.regexp_count(text, F.lit(_CAPITALS)).alias("_c"), F.regexp_count(text, F.lit(_SIGNS)).alias("_s"),
    )
    # blank only at the ends, where the text starts or ends with what splits
    blank = (F.element_at("_w", 1) == "").cast("int") + (F.element_at("_w", -1) == "").cast("int")
    counted = split.select(*others, F.array_distinct("_w").alias("_d"), F.greatest(F.size("_w") - blank, F.lit(0)).cast("long").alias("n_tokens"), "_n", "_c", "_s")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shapes = F.array(
        F.lit(BIAS), F.concat(F.lit(f"{BIAS}capitals"), _level(zero("_c"), zero("_n"))), F.concat(F.lit(f"{BIAS}signs"), _level(zero("_s"), zero("_n"))),
        F.concat(F.lit(f"{BIAS}distinct"), _level(F.size("_d"), F.col("n_tokens"))),
    )
    return counted.select(*others, F.concat(shapes, "_d").alias("features"), "n_tokens")


def fit_domains(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``feature`` and a weight per domain (log lift; for the bias the log prior).

    Learns from the ``sample`` labelled documents of least hash at most. A document
    with several labels has the toxic, then the junk one. Without labels there is
    only the bias, with equal priors; a domain without documents gets next to nothing.
    """
    domain = F.when(F.max("toxic") == 1, "toxic").when(F.min("quality") == 0, "junk").otherwise("clean")
    chosen = (
        labels.filter("doc_id is not null and (quality in (0, 1) or toxic in (0, 1))")
        .groupBy("doc_id")
        .agg(domain.alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", "text")
    learnt = materialize(with_features(texts, "text").select("domain", "features"), "domain-sample")
    counted = learnt.agg(*(F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS)).first().asDict()
    total = sum(counted.values())
    # of a domain without any document nothing is known: no text is of it
    prior = [math.log((counted[d] + 1) / (total + len(DOMAINS))) if counted[d] or not total else -50.0 for d in DOMAINS]
    bias = docs.sparkSession.range(1).select(F.lit(BIAS).alias("feature"), *(F.lit(p).alias(d) for d, p in zip(DOMAINS, prior, strict=True)))
    seen = learnt.select("domain", F.explode("features").alias("feature")).filter(F.col("feature") != BIAS)
    n = materialize(
        seen.groupBy("feature").agg(F.count("*").alias("all"), *(F.count_if(F.col("domain") == d).alias(f"n_{d}") for d in DOMAINS)), "domain-features"
    )
    # a word is weighed against all words of its domain's documents, a shape against the documents
    shape = F.col("feature").startswith(BIAS)
    words = n.filter(~shape).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("all", *(f"n_{d}" for d in DOMAINS)))).first()
    # a domain of few documents is taken to be like all, as if it had one average document more
    mean = max(1.0, words["all"] / max(1, total))
    base = F.when(shape, (F.col("all") + 0.5) / (total + 1.0)).otherwise((F.col("all") + 0.5) / (words["all"] + 1.0))
    of = lambda d: F.when(shape, (F.col(f"n_{d}") + base) / (counted[d] + 1.0)).otherwise((F.col(f"n_{d}") + mean * base) / (words[f"n_{d}"] + mean))
    lift = {d: F.log(of(d)) - F.log(base) for d in DOMAINS}
    told = sum((F.col(f"n_{d}") * lift[d] for d in DOMAINS), F.lit(0.0))
    best = (
        n.filter(F.col("all") >= LEAST)
        .select("feature", F.round(told, 6).alias("told"), *(lift[d].alias(d) for d in DOMAINS))
        .orderBy(F.col("told").desc(), "feature")
        .limit(VOCABULARY)
        .select("feature", *DOMAINS)
    )
    return materialize(bias.unionByName(best), "domain-weights")


def posteriors(docs: DataFrame, weights: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens`` and a posterior per domain, for each different (doc_id, text).

    ``n_rows`` says how many rows of ``docs`` were alike. A null or empty text has no
    tokens and what its shape gives as posterior.
    """
    rows = with_features(docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("same"), F.col(text).alias("text")), "text")
    # outer: a plain explode makes Spark filter by the array's size, and so build the array again for the filter
    summed = (
        rows.select("doc_id", "same", "n_tokens", F.explode_outer("features").alias("feature"))
        .join(F.broadcast(weights), "feature")
        .groupBy("doc_id", "same", "n_tokens")
        .agg(F.count_if(F.col("feature") == BIAS).alias("n_rows"), *(F.sum(d).alias(d) for d in DOMAINS))
    )
    logits = {d: F.col(d) / F.col("n_rows") for d in DOMAINS}
    top = F.greatest(*logits.values())
    e = {d: F.exp(logits[d] - top) for d in DOMAINS}
    return summed.select("doc_id", "n_rows", "n_tokens", *((e[d] / sum(e.values())).alias(d) for d in DOMAINS))


@dataclass
class Fit:
    """The steps that make the rates, and what the result misses of the targets."""

    steps: list[list[float]]
    expected: dict[str, float]
    wanted: dict[str, float]

    @property
    def missed(self) -> float:
        """The greatest miss of a domain as a share of all wanted tokens."""
        return max(abs(self.expected[d] - self.wanted[d]) for d in DOMAINS) / max(sum(self.wanted.values()), 1.0)


def rate(steps: list[list[float]]) -> Column:
    """A document's rate after the steps, from its posterior."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*(F.array(*map(F.lit, s)) for s in steps))
    return F.aggregate(
        moves,
        F.lit(1.0),
        lambda r, s: F.greatest(F.lit(0.0), r - sum((F.col(d) * F.element_at(s, i + 1) for i, d in enumerate(DOMAINS)), F.lit(0.0))),
    )


def _measure(soft: DataFrame, steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens per domain after the steps, and the Gram matrix over documents with a rate."""
    pairs = [(a, b) for i, a in enumerate(DOMAINS) for b in DOMAINS[i:]]
    rows = soft.withColumn("_r", rate(steps)).withColumn("_w", F.col("n_rows") * F.col("n_tokens"))
    got = rows.agg(
        *(F.sum(F.col("_r") * F.col("_w") * F.col(d)).alias(f"of_{d}") for d in DOMAINS),
        *(F.sum(F.when(F.col("_r") > 0, F.col("_w") * F.col(a) * F.col(b))).alias(f"{a}_{b}") for a, b in pairs),
    ).first()
    gram = [[got["_".join(sorted((a, b), key=DOMAINS.index))] or 0.0 for b in DOMAINS] for a in DOMAINS]
    return np.array([got[f"of_{d}"] or 0.0 for d in DOMAINS]), np.array(gram)


def fit_rates(soft: DataFrame, targets: dict[str, float] = TARGETS, tokens: float | None = None) -> Fit:
    """Rates for ``tokens`` in expectation (default: as many as there are), shared as ``targets`` says.

    A domain that no document can be of keeps its miss. No tokens at all need no step.
    """
    expected, gram = _measure(soft, [])
    budget = float(expected.sum()) if tokens is None else tokens
    share = np.array([targets.get(d, 0.0) for d in DOMAINS])
    wanted = budget * share / share.sum()
    steps: list[list[float]] = []
    for _ in range(ITERATIONS if budget > 0 else 0):
        miss = expected - wanted
        if np.abs(miss).max() <= CLOSE * budget:
            break
        step = np.linalg.pinv(gram, rcond=1e-9) @ miss
        for _ in range(HALVINGS):
            got, now = _measure(soft, [*steps, step.tolist()])
            if np.linalg.norm(got - wanted) < np.linalg.norm(miss):
                break
            step = step / 2
        else:
            break  # no step is better: some domain can't be met
        steps.append(step.tolist())
        done = np.linalg.norm(got - expected) <= CLOSE * budget
        expected, gram = got, now
        if done:
            break
    return Fit(steps, dict(zip(DOMAINS, expected.tolist(), strict=True)), dict(zip(DOMAINS, wanted.tolist(), strict=True)))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``doc_id, n_rows, n_tokens``, a posterior per domain, ``rate`` and ``expected_tokens``.

    One row per different (doc_id, text) of ``docs``; a rate counts for each of its
    ``n_rows`` rows. No rows give no rows. A warning tells
    of targets that are missed: a domain that hardly any document can be of.
    """
    soft = materialize(posteriors(docs, fit_domains(docs, labels)), "memberships")
    fit = fit_rates(soft, targets)
    if fit.missed > TELLING:
        warnings.warn(f"rates miss the targets by {fit.missed:.2g} of all tokens after {len(fit.steps)} steps", stacklevel=2)
    steps = fit.steps
    return soft.select(
        "doc_id", "n_rows", "n_tokens", *(F.round(d, 9).alias(f"p_{d}") for d in DOMAINS), F.round(rate(steps), 9).alias("rate"),
        F.round(rate(steps) * F.col("n_rows") * F.col("n_tokens"), 6).alias("expected_tokens"),
    )
