"""Typed answers of the three kinds: confidence, targets, signatures, blends, corrections and abstentions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say yes or no.
YES, NO = ("true", "yes", "y"), ("false", "no", "n")
# Short names of the skills.
ALIASES = {"a": "APPROACH", "h": "HOLD", "i": "INTERACT", "m": "MOVE", "s": "STOP", "ro": "ROTATE", "rt": "RETREAT", "rc": "RECOVER"}


def _by_kind(kind: Column, boolean: Column, choice: Column, score: Column) -> Column:
    return F.when(kind == "boolean", boolean).when(kind == "choice", choice).when(kind == "score", score)


def confidence(kind: Column, p: Column, selected: Column, probabilities: Column, lower: Column, upper: Column) -> Column:
    """How sure an answer is: its probability, that of what it selects, or what its interval leaves."""
    return _by_kind(kind, p, F.coalesce(F.try_element_at(probabilities, selected), F.lit(0.0)), F.greatest(F.lit(0.0), 1.0 - (upper - lower)))


def accepted(kind: Column, value: Column, p: Column, selected: Column, probabilities: Column, abstained: Column, auto_true: Column | float, auto_false: Column | float, minimum: Column | float) -> Column:
    """Whether a task's thresholds accept an answer: never an abstention, always a score."""
    true, false, least = (x if isinstance(x, Column) else F.lit(x) for x in (auto_true, auto_false, minimum))
    return ~abstained & _by_kind(kind, F.when(value, p >= true).otherwise(p >= 1.0 - false), F.coalesce(F.try_element_at(probabilities, selected), F.lit(0.0)) >= least, F.lit(True))


def target(kind: Column, value: Column, selected: Column, score: Column) -> Column:
    """The answer itself as text, scores with six places."""
    return _by_kind(kind, value.cast("string"), selected, F.format_string("%.6f", F.round(score, 6)))


def float_text(x: Column) -> Column:
    """A double with the fewest digits that tell it from others: plain from 0.0001 to below 1e16, else with an exponent of two digits or more."""
    told = x.cast("string")
    parts = F.split(F.abs(x).cast("string"), "E")
    digits = F.regexp_replace(F.regexp_replace(parts[0], r"\.0$", ""), r"\.", "")
    power = F.try_element_at(parts, F.lit(2)).cast("int")
    sign = F.when(x < 0, "-").otherwise("")
    plain = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).otherwise(
        F.when(F.length(digits) <= power + 1, F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    )
    fraction = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 20))).otherwise("")
    scientific = F.concat(F.substring(digits, 1, 1), fraction, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    odd = F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf")))
    return F.coalesce(odd, F.when(power.isNull(), told).otherwise(F.concat(sign, F.when(power.between(-4, 15), plain).otherwise(scientific))))


def label(kind: Column, value: Column, selected: Column, score: Column) -> Column:
    """The answer as a reviewer sees it: scores with the digits that they have; nothing for a missing choice or score, the kind itself if it is unknown."""
    none = F.lit("")
    known = _by_kind(kind, F.coalesce(value, F.lit(False)).cast("string"), F.coalesce(selected, none), F.coalesce(float_text(score), none))
    return F.coalesce(known, kind, none)


def reviewed_value(configured: Column, drafted: Column) -> Column:
    """What a review shows of a value: the configured one, else a teacher's draft, and which of them it is."""
    return F.coalesce(F.concat(F.when(F.trim(configured) != "", configured), F.lit(" (configured)")), F.concat(drafted, F.lit(" (teacher draft)")), F.lit("not provided"))


def signature(kind: Column, value: Column, selected: Column, score: Column) -> Column:
    """Kind and answer: equal for answers that agree. An abstention doesn't count as another answer."""
    return F.concat(kind, F.lit(":"), target(kind, value, selected, score))


def signature_key(kind: Column, value: Column, selected: Column, score: Column) -> Column:
    """SHA-256 of an answer as canonical JSON, to compare answers without keeping them."""
    from .text import digest, json_object, json_string

    return digest(json_object(type=json_string(kind), answer=json_string(target(kind, value, selected, score))))


def skill_action(kind: Column, selected: Column) -> Column:
    """The action that a choice names; other kinds name none."""
    return F.when(kind == "choice", selected)


def soft_target(kind: Column, value: tuple[Column, Column], p: tuple[Column, Column], probabilities: tuple[Column, Column], score: tuple[Column, Column]) -> Column:
    """Two answers' mean: ``probability`` of true, ``probabilities`` over both sides' classes, or ``score``."""
    true = lambda v, q: F.when(v, q).otherwise(1 - q)
    a, b = probabilities
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    classes = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    mean = F.map_from_entries(F.transform(classes, lambda k: F.struct(k.alias("key"), F.round((at(a, k) + at(b, k)) / 2, 6).alias("value"))))
    return F.struct(
        F.when(kind == "boolean", F.round((true(value[0], p[0]) + true(value[1], p[1])) / 2, 6)).alias("probability"), F.when(kind == "choice", mean).alias("probabilities"),
        F.when(kind == "score", F.round((score[0] + score[1]) / 2, 6)).alias("score"),
    )


def one_hot(selected: Column, candidates: Column) -> Column:
    """1 for the selected candidate, 0 for the others, whatever the case of letters."""
    return F.map_from_arrays(candidates, F.transform(candidates, lambda c: F.when(F.lower(c) == F.lower(selected), 1.0).otherwise(0.0)))


def correction(kind: Column, said: Column, candidates: Column) -> Column:
    """``value, selected, probabilities, score, error`` of what a reviewer typed.

    Booleans are true, yes, y and their opposites, choices one of the candidates,
    scores numbers within 0 and 1; anything else has the kind as error.
    """
    low = F.lower(F.trim(said))
    value = F.when(low.isin(*YES), True).when(low.isin(*NO), False)
    chosen = F.try_element_at(F.filter(candidates, lambda c: F.lower(c) == low), F.lit(1))
    number = low.try_cast("double")
    score = F.when(number.between(0.0, 1.0), number)
    b, c, s = kind == "boolean", kind == "choice", kind == "score"
    found = _by_kind(kind, value.isNotNull(), chosen.isNotNull(), score.isNotNull())
    return F.struct(
        F.when(b, value).alias("value"), F.when(c, chosen).alias("selected"), F.when(c & chosen.isNotNull(), one_hot(chosen, candidates)).alias("probabilities"), F.when(s, score).alias("score"), F.when(~F.coalesce(found, F.lit(False)), kind).alias("error")
    )


def skill_of(said: Column) -> Column:
    """A skill by its short or whole name, whatever the case of letters; null if there is none."""
    low = F.lower(F.trim(said))
    names = {**ALIASES, **{s.lower(): s for s in ALIASES.values()}}
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), low)


def abstention(kind: Column, candidates: Column) -> Column:
    """The answer that says nothing: undecided, uniform over the candidates, or the whole range."""
    even = 1.0 / F.greatest(F.size(candidates), F.lit(1))
    uniform = F.map_from_arrays(candidates, F.transform(candidates, lambda _: even))
    b, c, s = kind == "boolean", kind == "choice", kind == "score"
    return F.struct(
        F.when(b, F.lit(False)).alias("value"), F.when(b, F.lit(0.5)).when(c, even).alias("probability"), F.when(c, F.try_element_at(candidates, F.lit(1))).alias("selected"), F.when(c, uniform).alias("probabilities"),
        F.when(s, F.lit(0.5)).alias("score"), F.when(s, F.lit(0.0)).alias("lower"), F.when(s, F.lit(1.0)).alias("upper"), F.lit(True).alias("abstained"),
    )
