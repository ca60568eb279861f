"""What an evaluation hands on: step and mismatch rows, sequence comparison, tips, records for the feedback and prosody stages."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "∅"

# What each type of issue is called and advised, in the words of the reports.
MESSAGES = {
    "aspiration_or_tense_confusion": ("기식성이나 경음 대조가 약하게 실현되었습니다.", "숨을 더 실어 내거나 성대 긴장을 조금 더 주어 ㅋ/ㅌ/ㅍ, ㄲ/ㄸ/ㅃ 계열 차이를 분명하게 내보세요."),
    "vowel_confusion": ("모음 높이 또는 입모양 차이가 기준 발음과 다르게 들렸습니다.", "입 벌림과 혀 위치를 조금 더 크게 구분해 보세요. 특히 ㅓ/ㅗ, ㅡ/ㅜ, ㅐ/ㅔ 대비를 의식하면 도움이 됩니다."),
    "liquid_realization_issue": ("ㄹ 계열 소리가 플랩/유음 사이에서 흔들렸습니다.", "혀끝을 윗잇몸에 짧게 한 번 닿게 하면 초성 ㄹ에, 조금 더 길게 닿게 하면 종성 ㄹ에 가깝습니다."),
    "coda_deletion": ("받침이 약하게 실현되어 거의 들리지 않았습니다.", "음절 끝을 길게 빼지 말고, 짧게 막아 주는 느낌으로 받침을 마무리해 보세요."),
    "epenthetic_vowel_insertion": ("기준 발음에는 없는 모음이 사이에 덧붙었습니다.", "자음 사이를 연결할 때 불필요한 모음을 넣지 않도록 리듬을 더 짧게 가져가 보세요."),
    "consonant_insertion": ("기준 발음에는 없는 자음이 추가되어 들렸습니다.", "강하게 끊는 구간에서 불필요한 자음이 섞이지 않게 호흡을 조금 더 매끄럽게 이어 보세요."),
    "consonant_deletion": ("기준 자음이 약화되거나 빠져서 들렸습니다.", "문장 속 자음을 흘리지 말고, 시작점에서 짧게 또렷하게 터뜨려 보세요."),
}
OTHER_MESSAGE = ("기준 발음과 다른 구간이 확인되었습니다.", "해당 구간을 천천히 반복해 기준 발음과의 차이를 줄여 보세요.")
PROFILE_MESSAGE = {"ru": (["aspiration_or_tense_confusion", "liquid_realization_issue", "vowel_confusion"], " 러시아어권 학습자에게 자주 보이는 유형이라 대조를 더 크게 내면 도움이 됩니다.")}
HEADLINES = {
    "excellent": "전체적으로 기준 발음과 매우 가깝습니다.", "good": "전반적으로 안정적이지만 몇몇 대비를 더 분명하게 하면 좋습니다.",
    "developing": "핵심 발음은 전달되지만 일부 구간에서 대조가 약해졌습니다.", "needs-work": "기준 발음과 차이가 커서 구간별 교정이 필요합니다.",
}
DEFAULT_TIP = "허용 가능한 발음 변이를 제외하면 큰 문제는 보이지 않았습니다. 현재 리듬을 유지하면서 또렷함만 조금 더 높여 보세요."
DIFF_LEVELS = [(90, "전체적으로 목표 IPA와 매우 가깝습니다."), (75, "전체적으로 비슷하지만 몇몇 음소 차이가 있습니다."), (55, "중간 정도 일치합니다. 특정 구간의 음소 차이가 눈에 띕니다.")]
DIFF_LOWEST = "목표 IPA와 차이가 큽니다. 천천히 또렷하게 다시 발음해보는 것이 좋습니다."
DIFF_NOTE = "주의: 이 프로토타입은 직접 음성에서 phone/IPA 시퀀스를 추정하는 최소 버전이라 표기 체계 차이와 모델 오차가 일부 남을 수 있습니다."


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def alignment_rows(evaluations: DataFrame, by: list[str]) -> DataFrame:
    """Every step of each alignment, numbered from 1, cost to three places; a missing side is ∅."""
    rows = evaluations.select(*by, F.posexplode("alignment.steps").alias("i", "s"))
    return rows.select(*by, (F.col("i") + 1).alias("number"), F.coalesce("s.ref_symbol", F.lit(NONE)).alias("ref"), F.coalesce("s.hyp_symbol", F.lit(NONE)).alias("hyp"), "s.op", "s.error_type", F.round("s.cost", 3).alias("cost"), "s.detail")


def mismatch_rows(evaluations: DataFrame, by: list[str]) -> DataFrame:
    """The steps that cost something."""
    rows = evaluations.select(*by, F.posexplode("alignment.steps").alias("i", "s")).where("s.cost > 0")
    return rows.select(*by, "i", F.coalesce("s.ref_symbol", F.lit(NONE)).alias("ref"), F.coalesce("s.hyp_symbol", F.lit(NONE)).alias("hyp"), "s.cost", "s.error_type", "s.detail")


def described(issue: Column, profile: str = "ru") -> Column:
    """description and tip of an issue (issue_type, ref_symbol, hyp_symbol), and both as one feedback text."""
    kind = issue["issue_type"]
    types, more = PROFILE_MESSAGE.get(profile, ([], ""))
    description = F.coalesce(F.try_element_at(_map({k: v[0] for k, v in MESSAGES.items()}), kind), F.lit(OTHER_MESSAGE[0]))
    description = F.when(kind.isin(types), F.concat(description, F.lit(more))).otherwise(description) if types else description
    tip = F.coalesce(F.try_element_at(_map({k: v[1] for k, v in MESSAGES.items()}), kind), F.lit(OTHER_MESSAGE[1]))
    ref, hyp = issue["ref_symbol"], issue["hyp_symbol"]
    tokens = F.when(ref.isNull() & hyp.isNull(), F.lit("")).otherwise(F.concat(F.lit(" 기준 "), F.coalesce(ref, F.lit(NONE)), F.lit(" / 사용자 "), F.coalesce(hyp, F.lit(NONE)), F.lit(".")))
    return F.struct(kind.alias("issue_type"), description.alias("description"), tip.alias("tip"), F.concat(description, tokens, F.lit(" "), tip).alias("text"))


def feedback_report(report: Column, profile: str = "ru") -> Column:
    """headline of a report's level, and the different texts of its issues in order (a default one if there is none)."""
    texts = F.array_distinct(F.transform(report["issues"], lambda i: described(i, profile)["text"]))
    return F.struct(F.element_at(_map(HEADLINES), report["level"]).alias("headline"), F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(DEFAULT_TIP))).alias("tips"))


def compare_tokens(rows: DataFrame, target: str = "target", user: str = "user", into: str = "compared") -> DataFrame:
    """``rows`` with score (matching share times 100, two places) and the spans that are equal or differ, by longest matching blocks.

    Null counts as empty; two empty sequences score 100.  Each different pair is compared once.
    """
    schema = "struct<score: double, details: array<struct<tag: string, target: array<string>, user: array<string>>>>"

    @F.pandas_udf(schema)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b):
            x, y = [] if x is None else list(x), [] if y is None else list(y)
            matcher = SequenceMatcher(a=x, b=y)
            out.append((round(matcher.ratio() * 100, 2), [{"tag": tag, "target": x[i:j], "user": y[k:l]} for tag, i, j, k, l in matcher.get_opcodes()]))
        return pd.DataFrame(out, columns=["score", "details"])

    keyed = rows.withColumn("_pair", F.sha2(F.to_json(F.struct(target, user)), 256))
    done = keyed.select("_pair", target, user).dropDuplicates(["_pair"]).select("_pair", run(target, user).alias(into))
    return keyed.join(done, "_pair").drop("_pair")


def op_summary(details: Column) -> Column:
    """Tokens in spans of each kind, the longer side of a span counting."""
    n = lambda tag: F.aggregate(F.filter(details, lambda x: x["tag"] == tag), F.lit(0), lambda s, x: s + F.greatest(F.size(x["target"]), F.size(x["user"])))
    return F.struct(*(n(tag).alias(tag) for tag in ("equal", "replace", "delete", "insert")))


def _side(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise(NONE)


def diff_lines(details: Column) -> Column:
    return F.array_join(F.transform(details, lambda x: F.concat(F.lit("["), x["tag"], F.lit("] target: "), _side(x["target"]), F.lit(" | user: "), _side(x["user"]))), "\n")


def diff_feedback(details: Column, score: Column) -> Column:
    """A verdict by score, up to three examples of each kind of difference, and a note."""
    level = F.lit(DIFF_LOWEST)
    for least, text in reversed(DIFF_LEVELS):
        level = F.when(score >= least, text).otherwise(level)

    def examples(tag: str, head: str, text) -> Column:
        hit = F.slice(F.filter(details, lambda x: x["tag"] == tag), 1, 3)
        return F.when(F.size(hit) > 0, F.concat(F.lit(head), F.array_join(F.transform(hit, text), ", ")))

    lines = F.array(
        level, examples("replace", "치환 구간: ", lambda x: F.concat(_side(x["target"]), F.lit(" → "), _side(x["user"]))), examples("delete", "누락 구간: ", lambda x: F.concat(_side(x["target"]), F.lit(" 누락"))),
        examples("insert", "추가 구간: ", lambda x: F.concat(_side(x["user"]), F.lit(" 추가"))), F.lit(DIFF_NOTE))
    return F.array_join(F.array_compact(lines), "\n")


def gate_summary(rows: DataFrame) -> Column:
    """Gates of an evaluation (audio_passed, coarse_score, coarse_passed, alignment_passed; null: not performed).

    Without its own verdict the coarse gate counts as passed where a later stage has run (has_forced, alignment_passed, has_score).
    """
    gate = lambda performed, passed: F.struct(performed.alias("performed"), passed.alias("passed"))
    coarse = F.col("coarse_score")
    inferred = F.when(coarse.isNotNull(), F.col("has_forced") | F.col("alignment_passed").isNotNull() | F.col("has_score"))
    return F.struct(
        gate(F.col("audio_passed").isNotNull(), F.col("audio_passed")).alias("audio_quality_gate"),
        F.struct(coarse.isNotNull().alias("performed"), F.coalesce("coarse_passed", inferred).alias("passed"), coarse.alias("normalized_score")).alias("coarse_token_alignment_gate"),
        gate(F.col("alignment_passed").isNotNull(), F.col("alignment_passed")).alias("alignment_confidence_gate"))


def feedback_handoff(rows: DataFrame) -> DataFrame:
    """utt_id and what the feedback stage reads; without its own flag a score is final where the status is ready and there is one."""
    final = F.when(~F.col("has_score"), False).otherwise(F.coalesce("score_is_final", F.col("evaluation_status") == "ready"))
    return rows.select("utt_id", "reference_text", F.col("evaluation_status").alias("status"), F.lit("coarse_token_alignment").alias("score_source"), final.alias("score_is_final"), "coarse_score", gate_summary(rows).alias("gate_summary"))


def prosody_handoff(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """utt_id and what the prosody stage reads: gates, usage, and phone segments in order with their durations."""
    length = F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time")).alias("duration")
    s = segments.groupBy("utt_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", "token", "label", "start_time", "end_time", length, "frame_start", "frame_end", "confidence"))).alias("phoneme_segments"))
    usage = [c for c in ("recommended_usage", "alignment_for_prosody") if c in rows.columns]
    return rows.select("utt_id", "reference_text", gate_summary(rows).alias("gate_summary"), *usage).join(s, "utt_id", "left")


def evaluation_records(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """One nested record an utterance, to be written with ``stores.write_artifacts`` by day: status, gates, forced segments, both hand-offs."""
    feedback = feedback_handoff(rows).select("utt_id", F.struct("reference_text", "status", "score_source", "score_is_final", "coarse_score", "gate_summary").alias("llm_feedback_input"))
    handed = prosody_handoff(rows, segments)
    prosody = handed.select("utt_id", F.struct(*[c for c in handed.columns if c != "utt_id"]).alias("prosody_input"), F.struct(F.struct(F.col("phoneme_segments").alias("segments")).alias("forced")).alias("alignment"), F.col("gate_summary").alias("gates"))
    status = rows.select("utt_id", F.lit(1).alias("schema_version"), F.col("created_at"), F.to_date("created_at").alias("day"), F.struct("evaluation_status").alias("status"), F.struct(F.col("reference_text").alias("text")).alias("reference"))
    return status.join(prosody, "utt_id").join(feedback, "utt_id")
