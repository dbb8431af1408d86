"""Control decisions: stop signals, phrase rules, the safety policy, scenario matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import ratio, wilson
from ..functions.text import any_term, normalize_prompt
from .quantiles import nearest, order_statistics, upper_median

SKILLS = ("STOP", "HOLD", "MOVE", "ROTATE", "APPROACH", "RETREAT", "INTERACT", "RECOVER")

# Phrases that mean an immediate stop.
STOP_SIGNALS = [
    "obstacle is directly ahead", "obstacle is inside the safety zone", "immediate collision risk", "collision risk is immediate",
    "collision risk is inside the safety zone", "emergency collision risk", "emergency hazard is detected inside the collision zone",
    "sensor reports an emergency collision risk", "collision may occur", "imminent impact", "stopping distance", "wall blocks the vehicle", "brake before contact",
    "충돌 위험이 즉시 발생해 정지가 필수다", "충돌 구역 안에서 비상 위험이 감지됐다", "장애물이 바로 앞", "즉시 충돌 위험", "비상 충돌 위험", "충돌 직전", "충돌할 위험", "제동 거리 안",
    "벽에 닿기 직전", "즉시 멈춰야", "안전 여유가 사라져", "비상 충돌 신호", "브레이크를 걸어야", "장애물이 안전 구역 안에 있다",
]

# Phrases that, all of one entry together, name a skill, in English and Korean.
PHRASES: dict[str, list[list[str]]] = {
    "APPROACH": [
        ["target is ahead", "approached safely"], ["target is close", "directly ahead"], ["reachable target", "getting closer"], ["reachable target", "locked directly ahead"],
        ["object is still far", "approached first"], ["close the gap", "visible marker"], ["move nearer", "selected object"], ["object can be reached", "moving closer"],
        ["destination is visible", "still distant"], ["reduce distance", "goal"], ["go toward", "locked target"],
        ["목표가 앞에 있고", "접근"], ["접근 가능한 목표", "가까워지고"], ["물체가 아직 멀어", "먼저 접근"], ["표지판까지", "거리를 줄인다"], ["선택된 물체", "가까워지도록"],
        ["목적지가 아직 멀어", "접근"], ["목표와의 간격", "줄인다"], ["대상 쪽으로", "가까이"], ["선택한 물체가 멀리 있어", "가까이 이동"], ["식별된 목표를 향해", "접근"],
        ["앞에 고정된 목표까지", "거리를 줄인다"],
    ],
    "HOLD": [
        ["pose is stable", "no new command"], ["pose is stable", "no hazard is present"], ["wait safely", "next sensor update"], ["stable pose", "maintained"], ["remain stationary", "scene is stable"],
        ["keep the current pose", "another command"], ["wait in place", "sensors refresh"], ["no motion is needed", "stable waypoint"], ["stay still", "no immediate hazard"],
        ["자세가 안정적이고", "새 명령이 없다"], ["센서 업데이트까지", "안전하게 기다린다"], ["안정된 자세", "유지"], ["위험이 없고 자세가 안정적이므로", "안전하게 잠시 멈춘다"], ["자세가 안정되어", "위치를 그대로 유지"],
        ["센서가 갱신될 때까지", "움직이지 않고"], ["위험이 없어", "대기"], ["위험이 없어", "기다린다"], ["웨이포인트에서", "기다린다"], ["자세를 유지하고", "전진하지"],
        ["현재 자세를 유지", "앞으로 나아가지"],
    ],
    "MOVE": [
        ["corridor is clear", "forward motion"], ["corridor is clear", "continue forward"], ["free space is available", "route"], ["heading is aligned", "open route", "straight ahead"],
        ["advance through", "unobstructed hallway"], ["continue forward", "open route"], ["continue ahead", "route remains open"], ["clear path"], ["forward navigation", "free space"], ["proceed straight", "corridor"],
        ["통로가 비어 있어", "앞으로 움직일"], ["막힘 없는 복도를 따라", "앞으로 전진한다"], ["경로에 자유 공간"], ["앞쪽 통로가 비어", "직진"], ["열린 경로를 따라", "앞으로"],
        ["장애물 없는 복도", "이동"], ["장애물 없는 복도", "지나"], ["주행 공간이 충분", "전진"], ["바닥이 비어", "나아간다"],
    ],
    "ROTATE": [
        ["heading is wrong", "turn space is clear"], ["turn toward", "next waypoint"], ["heading is wrong", "clear turn"], ["reorient toward", "corridor"], ["turn left", "waypoint"], ["change heading", "junction"],
        ["route requires", "turn"], ["rotate in place", "face the goal"],
        ["방향이 틀렸고", "회전 공간"], ["웨이포인트 방향으로", "회전"], ["다음 복도를 향해", "방향"], ["교차로에서", "방향을"], ["목표 방향에 맞도록", "회전"],
        ["헤딩이 틀려", "방향을 교정"], ["다음 복도로 향하도록", "방향"], ["웨이포인트에 맞추기 위해", "회전"], ["목표 방향을 바라보도록", "제자리에서 회전"],
    ],
    "RETREAT": [
        ["hazard is approaching", "move away"], ["safe space behind"], ["reverse into", "safe rear area"], ["move away from", "obstacle approaching ahead"], ["reverse away", "blocked area"],
        ["back up", "moving obstacle"], ["increase distance", "approaching hazard"], ["reverse into", "safe rear"], ["withdraw from", "blocked front"], ["move backward", "escape the danger"],
        ["위험이 다가오므로", "멀어져야"], ["뒤쪽에 안전한 공간"], ["위험이 다가오지만", "뒤의 빈 경로는 안전하다"], ["다가오는 장애물에서", "멀어지도록"], ["위험과의 거리를", "뒤로"],
        ["뒤쪽의 안전 구역", "물러난다"], ["막힌 앞쪽을 피해", "후방"], ["위험에서 벗어나기 위해", "뒤로"], ["뒤쪽의 안전한 공간으로", "후진"], ["위험이 가까워져", "거리를 벌린"],
        ["다가오는 위험에서", "멀어지도록"], ["앞의 위험 구역을 벗어나기 위해", "뒤로"], ["막힌 앞쪽 대신", "뒤쪽으로 물러난다"],
    ],
    "INTERACT": [
        ["aligned object", "within reach"], ["nearby switch", "ready to activate"], ["button is aligned", "within hand reach"], ["press", "button"], ["grasp", "handle"],
        ["grip the handle", "aligned with the end effector"], ["press the available control", "button"], ["activate", "switch"], ["touch", "reachable object"], ["pick up", "selected item"],
        ["정렬된 물체", "손이 닿는 거리"], ["근처 스위치", "작동할 준비"], ["버튼이 정렬됐고", "손이 닿는 거리에 있다"], ["손이 닿는", "버튼을"], ["정렬된 손잡이", "잡는다"],
        ["옆의 스위치를", "작동"], ["접근 가능한 물체", "만진다"], ["선택된 물건", "집어"], ["가까운 걸쇠", "열기"], ["제어판을", "사용"],
        ["스위치를 눌러", "활성화"], ["조작 지점을 눌러", "명령"], ["접근 가능한 물체를", "집어 든다"],
    ],
    "RECOVER": [
        ["localization is lost", "recovery is needed"], ["localization is lost", "no collision risk is present"], ["controller reports", "balance fault"], ["reinitialize", "pose estimation failure"],
        ["restore balance", "fall"], ["lost localization"], ["reset", "navigation fault"], ["recover from", "unstable state"], ["robot needs to regain balance"],
        ["위치를 잃어", "복구가 필요"], ["제어기가 균형 오류"], ["자세 추정이 실패", "재초기화"], ["넘어진 뒤", "균형을 회복"], ["넘어진 뒤", "균형을 되찾"],
        ["위치 추적이 끊겨", "복구"], ["탐색 오류를", "재설정"], ["불안정한 상태", "안정화"], ["위치를 잃은 뒤", "좌표"], ["동작 제어 오류", "복귀"],
        ["위치 추정이 끊겨", "재초기화"], ["제어기 오류에서", "복구 절차"], ["불안정한 자세를", "안정화한 뒤"], ["추적 실패 후", "위치를 다시 확보"],
    ],
}
# Phrases that veto a skill.
BLOCKERS: dict[str, list[str]] = {
    "APPROACH": ["cannot be approached", "can't be approached", "do not approach", "don't approach", "접근할 수 없다", "접근할 수 없어", "접근하지", "접근할 수 없"],
    "HOLD": ["pose is unstable", "an emergency hazard is present", "the hazard is present", "emergency", "자세가 불안정", "위험이 있다", "비상", "즉시 멈춰야"],
    "MOVE": ["path is blocked", "corridor is blocked", "cannot move", "can't move", "경로가 막혀", "움직일 수 없다", "막혀 있어"],
    "ROTATE": ["cannot turn", "can't turn", "turn space is blocked", "회전할 수 없다", "회전 공간이 막혀"],
    "RETREAT": ["no safe space behind", "cannot retreat", "can't retreat", "뒤에 안전한 공간이 없다", "후퇴할 수 없다", "뒤쪽이 막혀"],
    "INTERACT": ["not within reach", "not aligned", "cannot activate", "can't activate", "손이 닿지 않는다", "정렬되지", "작동할 수 없다"],
    "RECOVER": ["no recovery is needed", "recovery is not needed", "복구가 필요 없다"],
}
OLDEST_MS, LOWEST_CONFIDENCE, LONGEST_TTL_MS, SAFE_TTL_MS = 100.0, 0.9, 100, 50
MOST_SUMMARIES, LONGEST_MEMORY = 8, 2048


def explicit_stop(state: Column) -> Column:
    return any_term(normalize_prompt(state), STOP_SIGNALS)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def phrase_skill(state: Column, phrases: dict[str, list[list[str]]] = PHRASES, blockers: dict[str, list[str]] = BLOCKERS) -> Column:
    """The one skill whose phrases match without a veto; null if none or several do."""
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    catalog = F.array(
        *(F.struct(F.lit(s).alias("skill"), F.array(*map(strings, p)).alias("patterns"), strings(blockers.get(s, [])).alias("blockers")) for s, p in phrases.items())
    )

    def matching(text: Column) -> Column:
        said = lambda x: F.contains(text, x)
        return F.filter(catalog, lambda s: ~F.exists(s["blockers"], said) & F.exists(s["patterns"], lambda p: F.forall(p, said)))

    return _bound(normalize_prompt(state), lambda t: _bound(matching(t), lambda m: F.when(F.size(m) == 1, F.element_at(m, 1)["skill"])))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def invalid_clock(now: Column, stamp: Column) -> Column:
    return ~_finite(now) | (now < stamp)


def staleness(now: Column, stamp: Column, oldest: float = OLDEST_MS) -> Column:
    """invalid_clock, stale_observation or null; an age of exactly ``oldest`` passes."""
    return F.when(invalid_clock(now, stamp), "invalid_clock").when(now - stamp > oldest, "stale_observation")


def safety_policy(
    now: Column, stamp: Column, emergency: Column, abstained: Column, confidence: Column, ttl: Column, oldest: float = OLDEST_MS, lowest: float = LOWEST_CONFIDENCE, longest: int = LONGEST_TTL_MS,
    why_abstained: Column | str = "model_abstained",
) -> Column:
    """Reason of a safe stop, in the order of the policy; null if the action may run. No confidence is too low."""
    why = F.lit(why_abstained) if isinstance(why_abstained, str) else F.coalesce(why_abstained, F.lit("model_abstained"))
    return (
        F.when(invalid_clock(now, stamp), "invalid_clock")
        .when(emergency, "emergency_stop")
        .when(now - stamp > oldest, "stale_observation")
        .when(abstained, why)
        .when(F.coalesce(confidence, F.lit(0.0)) < lowest, "confidence_below_control_threshold")
        .when(ttl > longest, "action_ttl_exceeded")
    )


def action(skill: Column, source: str, reason: Column, ttl: Column | int, confidence: Column | float, abstained: bool = False) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        skill.alias("skill"), F.lit(source).alias("source"), reason.cast("string").alias("reason"), c(ttl).cast("int").alias("ttl_ms"), c(confidence).cast("double").alias("confidence"), F.lit(abstained).alias("abstained")
    )


def safe_stop(reason: Column, ttl: int = SAFE_TTL_MS) -> Column:
    """The one action that is left when a loop can't go on safely."""
    return action(F.lit("STOP"), "safety", reason, max(1, ttl), 1.0, True)


def decide(
    state: Column, now: Column, stamp: Column, emergency: Column, model_skill: Column, model_confidence: Column, model_abstained: Column, model_ttl: Column | int = LONGEST_TTL_MS, fast_path: bool = True,
    oldest: float = OLDEST_MS, lowest: float = LOWEST_CONFIDENCE, longest: int = LONGEST_TTL_MS,
) -> Column:
    """``skill, source, reason, ttl_ms, confidence, abstained`` of an observation: interlocks, then phrases, then the model.

    An emergency comes before the clock here, other than in the policy, which every
    phrase's and the model's action has to pass afterwards. A collision signal stops
    even where phrases are switched off. A model's answer that is none (no known skill,
    a confidence outside 0 and 1, a lifetime under 1) is an error and stops.
    """
    ttl = model_ttl if isinstance(model_ttl, Column) else F.lit(model_ttl)
    no_reason = F.lit(None).cast("string")

    def checked(act: Column, abstained: Column, confidence: Column, act_ttl: Column, why: str = "model_abstained") -> Column:
        reason = safety_policy(now, stamp, emergency, abstained, confidence, act_ttl, oldest, lowest, longest, why)
        return _bound(reason, lambda r: F.when(r.isNotNull(), safe_stop(r)).otherwise(act))

    def by_phrase(rule: Column) -> Column:
        reason = F.concat(F.lit("high_precision_"), F.lower(rule), F.lit("_signal"))
        return checked(action(rule, "control-rule", reason, SAFE_TTL_MS, 1.0), F.lit(False), F.lit(1.0), F.lit(SAFE_TTL_MS))

    wrong = ~F.coalesce(model_skill.isin(*SKILLS), F.lit(False)) | F.coalesce(~_finite(model_confidence) | ~model_confidence.between(0.0, 1.0), F.lit(False)) & model_confidence.isNotNull() | F.coalesce(ttl < 1, F.lit(True))
    by_model = checked(action(model_skill, "control-student", no_reason, ttl, model_confidence), F.coalesce(model_abstained, F.lit(False)), model_confidence, ttl, "student_abstained")
    found = F.struct(explicit_stop(state).alias("stop"), (phrase_skill(state) if fast_path else no_reason).alias("rule"))
    return _bound(
        found,
        lambda x: F.when(emergency, safe_stop(F.lit("emergency_stop")))
        .when(invalid_clock(now, stamp), safe_stop(F.lit("invalid_clock")))
        .when(now - stamp > oldest, safe_stop(F.lit("stale_observation")))
        .when(x["stop"], action(F.lit("STOP"), "safety-rule", F.lit("explicit_collision_signal"), SAFE_TTL_MS, 1.0))
        .when(x["rule"].isNotNull(), by_phrase(x["rule"]))
        .when(wrong, safe_stop(F.lit("control_inference_error")))
        .otherwise(by_model),
    )


def _blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def memory_errors(summaries: Column, source: Column) -> Column:
    """What is wrong with summaries that go along with an observation; no summaries at all are fine."""
    total = F.aggregate(summaries, F.lit(0), lambda a, s: a + F.coalesce(F.length(s), F.lit(0)))
    return F.array_compact(
        F.array(
            F.when(summaries.isNotNull() & _blank(source), "source"), F.when(F.size(summaries) > MOST_SUMMARIES, "count"), F.when(F.exists(summaries, _blank), "blank"), F.when(total > LONGEST_MEMORY, "length"),
        )
    )


def memory_from_text(text: Column) -> Column:
    """One summary of bounded length from a text; null from a blank one."""
    return F.when(~_blank(text), F.array(F.substring(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), 1, LONGEST_MEMORY)))


def render_state(state: Column, summaries: Column, source: Column) -> Column:
    """The model's input: the state, and its memories as a list if there are any to go along."""
    lines = F.array_join(F.transform(summaries, lambda s: F.concat(F.lit("- "), s)), "\n")
    return F.when(summaries.isNull(), state).otherwise(F.concat(state, F.lit("\nRelevant memory context ("), source, F.lit("):\n"), lines))


def observation_errors(id: Column, state: Column, domain: Column, stamp: Column) -> Column:
    return F.array_compact(
        F.array(F.when(_blank(id), "observation_id"), F.when(_blank(state), "state"), F.when(_blank(domain), "domain"), F.when(~F.coalesce(_finite(stamp) & (stamp >= 0), F.lit(False)), "timestamp_ms"))
    )


def action_errors(skill: Column, ttl: Column, confidence: Column, parameters: Column) -> Column:
    """What keeps an action from being one; parameters are names with values within -1 and 1."""
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(skill.isin(*SKILLS), F.lit(False)), "skill"), F.when(F.coalesce(ttl, F.lit(0)) < 1, "ttl_ms"), F.when(~F.coalesce(_finite(confidence) & confidence.between(0.0, 1.0), F.lit(False)), "confidence"),
            F.when(F.exists(F.map_entries(parameters), lambda e: _blank(e["key"]) | ~F.coalesce(_finite(e["value"]) & e["value"].between(-1.0, 1.0), F.lit(False))), "parameters"),
        )
    )


def policy_errors(lowest: Column, oldest: Column, longest: Column) -> Column:
    ok = lambda c: F.coalesce(c, F.lit(False))
    return F.array_compact(
        F.array(
            F.when(~ok(_finite(lowest) & lowest.between(0.0, 1.0)), "minimum_confidence"), F.when(~ok(_finite(oldest) & (oldest >= 0)), "max_observation_age_ms"), F.when(~ok(longest >= 1), "max_action_ttl_ms"),
        )
    )


# Reasons of the safety matrix.
REASONS = ("emergency_stop", "stale_observation", "invalid_clock")


def _pick(values: tuple[str, ...] | list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def numbered(spark: SparkSession, rows: int | DataFrame) -> DataFrame:
    """Numbers to make rows of: so many from 0, or those of a table's ``id``, so that what is made grows with it."""
    return spark.range(rows) if isinstance(rows, int) else rows.select(F.col("id").cast("long").alias("id"))


def safety_matrix(spark: SparkSession, count: int | DataFrame = 500) -> DataFrame:
    """Scenarios that must stop: reasons take turns, the clock sits beyond each limit."""
    i = F.col("id")
    reason, variant = _pick(REASONS, i % len(REASONS)), F.floor(i / len(REASONS))
    rows = numbered(spark, count).select(F.format_string("control-safety-%04d", i).alias("scenario_id"), reason.alias("expected_reason"), (1000.0 + variant).alias("timestamp_ms"))
    shift = F.when(F.col("expected_reason") == "emergency_stop", 1.0).when(F.col("expected_reason") == "stale_observation", 101.0).otherwise(-1.0)
    return rows.select("scenario_id", "expected_reason", "timestamp_ms", (F.col("timestamp_ms") + shift).alias("now_ms"), (F.col("expected_reason") == "emergency_stop").alias("emergency_stop"))


def near_miss_matrix(spark: SparkSession, count: int | DataFrame = 500) -> DataFrame:
    """Scenarios just inside the limits, one phrase of each skill in turn."""
    cases = [(" while ".join(p[0]), skill) for skill, p in PHRASES.items()]
    i = F.col("id")
    near = _pick(REASONS, i % len(REASONS)) == "stale_observation"
    rows = numbered(spark, count).select(
        F.format_string("control-safety-near-miss-%04d", i).alias("scenario_id"), F.format_string("%s; safety near-miss variant %04d", _pick([c for c, _ in cases], i % len(cases)), i).alias("state"),
        _pick([s for _, s in cases], i % len(cases)).alias("expected_skill"), (2000.0 + F.floor(i / len(REASONS))).alias("timestamp_ms"), near.alias("_near"),
    )
    return rows.withColumn("now_ms", F.col("timestamp_ms") + F.when(F.col("_near"), 100.0).otherwise(1.0)).drop("_near")


def split_by_variant(bucket: Column) -> Column:
    return F.when(bucket < 8, "train").when(bucket == 8, "validation").otherwise("test")


def review_queue(spark: SparkSession, per_skill: int = 100, seed: int = 7, templates: dict[str, list[str]] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """A balanced queue: languages and splits follow from variant, skill and seed alone. Skills take turns over the numbers of ``ids``, if they are given."""
    states = templates or {s: [" while ".join(p) for p in PHRASES.get(s, [STOP_SIGNALS[:1]])] for s in SKILLS}
    catalog = F.array(*(F.array(*map(F.lit, states[s])) for s in SKILLS))
    k, v = F.col("skill_index"), F.col("variant")
    rows = numbered(spark, len(SKILLS) * per_skill if ids is None else ids).select((F.floor(F.col("id") / per_skill) % len(SKILLS)).alias("skill_index"), (F.col("id") % per_skill).alias("variant"), F.col("id"))
    choices = F.element_at(catalog, (k + 1).cast("int"))
    return rows.select(
        F.format_string("control-review-%05d", F.col("id") + 1).alias("sample_id"), _pick(SKILLS, k).alias("target"),
        F.format_string("%s; scenario variant %04d", F.element_at(choices, (v % F.size(choices) + 1).cast("int")), v).alias("state"),
        F.when((v + k + seed) % 2 == 1, "ko").otherwise("en").alias("language"), split_by_variant((v + k * 3 + seed) % 10).alias("split"),
    )


def hard_negative_queue(spark: SparkSession, pairs: int | DataFrame = 100, seed: int = 7, confused: tuple[tuple[str, str], ...] = (("MOVE", "STOP"), ("HOLD", "MOVE"), ("ROTATE", "MOVE"), ("APPROACH", "RETREAT"), ("INTERACT", "APPROACH"), ("RECOVER", "HOLD"))) -> DataFrame:
    """Counterfactual pairs: both sides in one split and one group."""
    i = F.col("id")
    sides = F.array(
        F.struct(F.lit(1).alias("pair_side"), _pick([a for a, _ in confused], i % len(confused)).alias("target")),
        F.struct(F.lit(2).alias("pair_side"), _pick([b for _, b in confused], i % len(confused)).alias("target")),
    )
    rows = numbered(spark, pairs).select(
        F.format_string("control-hard-group-%05d", i).alias("counterfactual_group_id"), F.when((i + seed) % 2 == 1, "ko").otherwise("en").alias("language"), split_by_variant((i + seed) % 10).alias("split"), i, F.inline(sides)
    )
    return rows.select(F.format_string("control-hard-%05d", i * 2 + F.col("pair_side")).alias("sample_id"), "counterfactual_group_id", "pair_side", "target", "language", "split")


def safety_report(df: DataFrame, expected_stop: str = "expected_stop", stopped: str = "stopped", correct: str = "correct") -> DataFrame:
    """Accuracy, recall of safe stops, rate of false ones, with lower bounds."""
    e, s, c = F.col(expected_stop), F.col(stopped), F.col(correct)
    n = df.agg(F.count("*").alias("n"), F.count_if(c).alias("right"), F.count_if(e).alias("stops"), F.count_if(e & s).alias("caught"), F.count_if(~e & s).alias("false_stops"))
    return n.select(
        "n", ratio(F.col("right"), F.col("n")).alias("accuracy"), wilson("right", "n")[0].alias("accuracy_lower"), ratio(F.col("caught"), F.col("stops")).alias("stop_recall"), wilson("caught", "stops")[0].alias("stop_recall_lower"),
        ratio(F.col("false_stops"), F.col("n") - F.col("stops")).alias("false_stop_rate"),
    )


def latency_report(df: DataFrame, latency: str, most: float) -> DataFrame:
    """Upper median, nearest-rank percentiles, greatest and mean latency, and whether the 95th is within the limit."""
    found = order_statistics(df, [], latency, {"p50": upper_median, "p95": nearest(95), "p99": nearest(99)})
    return found.select("n", *(F.round(c, 3).alias(c) for c in ("p50", "p95", "p99")), F.round("greatest", 3).alias("max"), F.round("mean", 3).alias("mean"), (F.col("p95") <= most).alias("passed"))
