"""Queues for review and training, made from templates by modular arithmetic and hashes: the same at every run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_number
from .control import PHRASES, SKILLS, STOP_SIGNALS, numbered, split_by_variant
from .ranking import positions

# The order of tasks in a golden queue, and the questions that go with control states.
TASK_ORDER = ("memory.remember_worthy", "wiki.semantic_change")
QUESTIONS = {
    "en": ("select next safe high-level control skill", "choose the safest control action for this state", "which control skill should execute next", "decide the next controller action from this state"),
    "ko": ("다음 안전한 고수준 제어 skill을 선택하라", "이 상태에서 가장 안전한 제어 동작을 골라라", "다음에 실행할 제어 skill은 무엇인가", "현재 상태에서 다음 제어 행동을 결정하라"),
}
#: Pairs of skills that are taken for each other.
CONFUSED = (("MOVE", "STOP"), ("HOLD", "MOVE"), ("ROTATE", "MOVE"), ("APPROACH", "RETREAT"), ("INTERACT", "APPROACH"), ("RECOVER", "HOLD"))
#: (state, question, target) by task and language.
GOLDEN = {
    ("memory.remember_worthy", "ko"): (("앞으로 보고서는 월요일에 보내기로 결정했다.", "기억할 만한가?", "true"), ("안녕하세요, 반갑습니다.", "기억할 만한가?", "false")),
    ("memory.remember_worthy", "en"): (("We decided to send reports on Mondays.", "Is it worth remembering?", "true"), ("Hello and thanks.", "Is it worth remembering?", "false")),
    ("wiki.semantic_change", "ko"): (("기본 값이 10에서 20으로 변경되었다.", "의미가 바뀌었는가?", "true"), ("제목의 공백만 정리되었다.", "의미가 바뀌었는가?", "false")),
    ("wiki.semantic_change", "en"): (("The default value was changed to 20.", "Did the meaning change?", "true"), ("Only spacing in the title was tidied.", "Did the meaning change?", "false")),
}
_HANGUL = re.compile("[가-힣]")


def _by_language(texts: list[str]) -> dict[str, list[str]]:
    return {lang: [t for t in texts if bool(_HANGUL.search(t)) == (lang == "ko")] for lang in ("en", "ko")}


#: States by skill and language: the phrases that name the skill, put together.
TEMPLATES: dict[str, dict[str, list[str]]] = {s: _by_language([" while ".join(p) if not _HANGUL.search(p[0]) else " ".join(p) for p in PHRASES[s]] if s in PHRASES else STOP_SIGNALS) for s in SKILLS}


def _choice(values, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _state(templates: dict[str, dict[str, list[str]]], skill: Column, language: Column, at: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, by in templates.items():
        for lang, texts in by.items():
            if texts:
                out = F.when((skill == name) & (language == lang), _choice(texts, at)).otherwise(out)
    return out


def review_queue(spark: SparkSession, per_skill: int = 100, seed: int = 7, templates: dict[str, dict[str, list[str]]] = TEMPLATES, quotas: tuple[int, int] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """A balanced queue of control states in two languages with question, split and group.

    Splits follow from variant, skill and seed, or, with ``quotas`` of test and
    validation rows per skill, from the variant alone. Skills take turns over the
    numbers of ``ids``, if they are given.
    """
    if per_skill < 1 or (quotas and (min(quotas) < 0 or sum(quotas) > per_skill)):
        raise ValueError("per_skill must be positive and quotas must fit into it")
    rows = numbered(spark, len(SKILLS) * per_skill if ids is None else ids).select("id", (F.floor(F.col("id") / per_skill) % len(SKILLS)).alias("k"), (F.col("id") % per_skill).alias("v"))
    k, v = F.col("k"), F.col("v")
    rows = rows.withColumns({"target": _choice(SKILLS, k), "language": F.when((v + k + seed) % 2 == 1, "ko").otherwise("en")})
    ko = F.col("language") == "ko"
    split = split_by_variant((v + k * 3 + seed) % 10)
    if quotas:
        split = F.when(v < quotas[0], "test").when(v < sum(quotas), "validation").otherwise("train")
    return rows.select(
        F.format_string("control-review-%05d", F.col("id") + 1).alias("sample_id"), "target",
        F.concat(_state(templates, F.col("target"), F.col("language"), v), F.when(ko, "; 시나리오 변형 ").otherwise("; scenario variant "), F.format_string("%04d", v)).alias("state"),
        F.when(ko, _choice(QUESTIONS["ko"], v)).otherwise(_choice(QUESTIONS["en"], v)).alias("question"), "language", split.alias("split"), F.format_string("control-group-%05d", F.col("id") + 1).alias("semantic_group_id"),
    )


def counterfactual_queue(spark: SparkSession, pairs: int | DataFrame = 100, seed: int = 7, confused: tuple[tuple[str, str], ...] = CONFUSED, templates: dict[str, dict[str, list[str]]] = TEMPLATES) -> DataFrame:
    """Pairs of states for skills that are taken for each other: both sides in one group and one split."""
    if isinstance(pairs, int) and pairs < 1:
        raise ValueError("pairs must be positive")
    i = F.col("id")
    sides = F.array(*(F.struct(F.lit(n + 1).cast("bigint").alias("pair_side"), _choice([c[n] for c in confused], i).alias("target")) for n in (0, 1)))
    rows = numbered(spark, pairs).select(i, F.when((i + seed) % 2 == 1, "ko").otherwise("en").alias("language"), F.inline(sides))
    return rows.select(
        F.format_string("control-hard-%05d", i * 2 + F.col("pair_side")).alias("sample_id"), F.format_string("control-hard-group-%05d", i).alias("counterfactual_group_id"), "pair_side", "target",
        F.concat(_state(templates, F.col("target"), F.col("language"), i), F.format_string("; counterfactual variant %04d", i)).alias("state"), "language", split_by_variant((i + seed) % 10).alias("split"),
    )


def training_queue(spark: SparkSession, kind: str, templates: dict[str, list[str]] | DataFrame, language: str) -> DataFrame:
    """One row per template, by skill and place, in the train split alone; skills without templates have none.

    ``templates`` are lists by skill, or a table of ``target, v, text``.
    """
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame([(s, v, t) for s in SKILLS for v, t in enumerate(templates.get(s, []))], "target string, v int, text string")
    skill = F.array_position(F.array(*map(F.lit, SKILLS)), F.col("target"))
    rows = positions(templates.where(skill > 0), [skill, F.col("v"), F.col("text")]).withColumnRenamed("position", "i")
    variant = "; 한국어 학습 변형 %04d" if language == "ko" else f"; {kind} training variant %04d"
    return rows.select(
        F.format_string(f"control-{kind}-train-%05d", "i").alias("sample_id"), "target", F.concat("text", F.format_string(variant, "v")).alias("state"), F.lit(QUESTIONS[language][0]).alias("question"), F.lit(language).alias("language"), F.lit("train").alias("split"),
        F.format_string(f"control-{kind}-group-%05d", "i").alias("semantic_group_id"),
    )


def golden_queue(spark: SparkSession, count: int | DataFrame = 1000, seed: int = 0, templates: dict[tuple[str, str], tuple] = GOLDEN) -> DataFrame:
    """Tasks in turn; a fifth of the rows in English and the template by hash, so that no generator's sequence is needed."""
    if isinstance(count, int) and count < 1:
        raise ValueError("count must be positive")
    i = F.col("id") + 1
    draw = lambda salt, n: hash_number(F.concat(i.cast("string"), F.lit(f":{salt}:{seed}"))) % n
    rows = numbered(spark, count).select(i.alias("i"), _choice(TASK_ORDER, F.col("id")).alias("task_id"), F.when(draw("language", 5) == 0, "en").otherwise("ko").alias("language"), draw("template", 2).alias("k"))
    known = spark.createDataFrame([(t, lang, k, *x) for (t, lang), xs in templates.items() for k, x in enumerate(xs)], "task_id string, language string, k long, state string, question string, target string")
    return rows.join(F.broadcast(known), ["task_id", "language", "k"]).select(
        F.format_string("phase0-synthetic-%04d", "i").alias("sample_id"), "task_id", F.lit(1).alias("task_version"), "state", "question", "target", "language", F.lit("pending").alias("status")
    )


def scenario_counts(scenarios: DataFrame, reason: str = "expected_reason", id: str = "scenario_id") -> DataFrame:
    """Scenarios and different ids per reason."""
    return scenarios.groupBy(reason).agg(F.count("*").alias("n"), F.count_distinct(id).alias("ids"))
