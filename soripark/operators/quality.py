"""Gaps, confidence issues and gates of phone segments, one utterance a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soripark import tables as t
from soripark.operators.ranges import between, range_sums


def by_utt():
    return Window.partitionBy("utt_id").orderBy("seg_idx")


def gaps(segments: DataFrame) -> DataFrame:
    """A row between neighbours: gap in seconds, never negative; the last two are tail gaps."""
    rows = segments.withColumns({
        "previous_token": F.lag("token").over(by_utt()), "previous_end": F.lag("end_time").over(by_utt()), "last_idx": F.max("seg_idx").over(Window.partitionBy("utt_id")),
    })
    gap = F.greatest(F.lit(0.0), F.col("start_time") - F.col("previous_end"))
    return rows.where("previous_end is not null").select("utt_id", F.col("seg_idx").alias("next_idx"), "previous_token", F.col("token").alias("next_token"), gap.alias("gap"), (F.col("seg_idx") >= F.col("last_idx") - 1).alias("is_tail_gap"))


def confidence_issues(segments: DataFrame) -> DataFrame:
    """Counts, ratios and scope of low confidence per utterance; ``segments`` carry their thresholds.

    Means are taken to nine places, so that the order of summing decides nothing.  Scope: none without a very low segment at a low ratio up to .15; global above .30 very low if that is no single
    token's matter; localized if one token makes .45 of them or two tokens all; mixed above .15 or .30 low; else minor.
    """
    very, low = F.col("confidence") < F.col("very_low_threshold"), F.col("confidence") < F.col("low_threshold")
    per_token = segments.groupBy("utt_id", "token").agg(F.count("*").alias("n"), F.count_if(very).alias("v"), F.count_if(low).alias("l"), F.sum("confidence").alias("c"))
    out = per_token.groupBy("utt_id").agg(F.sum("n").alias("token_count"), F.sum("v").alias("very_low_count"), F.sum("l").alias("low_count"), F.max("v").alias("most"), F.count_if(F.col("v") > 0).alias("unique_very_low"), F.round(F.sum("c") / F.sum("n"), 9).alias("avg_confidence"))
    per = lambda x: F.col(x) / F.col("token_count")
    rows = out.select("utt_id", "token_count", "very_low_count", "low_count", per("very_low_count").alias("very_low_ratio"), per("low_count").alias("low_ratio"), "avg_confidence", "unique_very_low", "most")
    very, low, share = F.col("very_low_ratio"), F.col("low_ratio"), F.greatest(F.col("very_low_count"), F.lit(1))
    spread = (low > 0.45) | (F.col("avg_confidence") < 0.60) | (F.col("unique_very_low") / share > 0.55)
    scope = (
        F.when((F.col("very_low_count") == 0) & (low <= 0.15), "none").when((very > 0.30) & spread, "global")
        .when((F.col("very_low_count") > 0) & ((F.col("most") / share >= 0.45) | (F.col("unique_very_low") <= 2)), "localized").when((very > 0.15) | (low > 0.30), "mixed").otherwise("minor")
    )
    return rows.withColumn("scope", scope).drop("most")


def worst_segments(segments: DataFrame, k: int = 10) -> DataFrame:
    """The k least confident segments of each utterance, ties by index."""
    rank = F.row_number().over(Window.partitionBy("utt_id").orderBy("confidence", "seg_idx"))
    return segments.withColumn("rank", rank).where(F.col("rank") <= k).select("utt_id", "rank", "seg_idx", "token", "confidence")


def dominant_tokens(segments: DataFrame, k: int = 8) -> DataFrame:
    """The tokens most often very low in an utterance, ties by first occurrence."""
    hit = segments.where("confidence < very_low_threshold")
    per = hit.groupBy("utt_id", "token").agg(F.count("*").alias("count"), F.min("seg_idx").alias("first_idx"), F.min("confidence").alias("min_confidence"), F.avg("confidence").alias("mean_confidence"))
    whole = Window.partitionBy("utt_id")
    ranked = per.withColumns({"rank": F.row_number().over(whole.orderBy(F.col("count").desc(), "first_idx")), "ratio_among_very_low": F.col("count") / F.sum("count").over(whole)})
    return ranked.where(F.col("rank") <= k).select("utt_id", "rank", "token", "count", "ratio_among_very_low", "min_confidence", "mean_confidence")


def very_low_runs(segments: DataFrame, k: int = 8) -> DataFrame:
    """Maximal runs of very low segments, the k longest of each utterance; ties: lower confidence, then earlier."""
    hit = segments.where("confidence < very_low_threshold").withColumn("island", F.col("seg_idx") - F.row_number().over(by_utt()))
    runs = hit.groupBy("utt_id", "island").agg(F.min("seg_idx").alias("start_index"), F.max("seg_idx").alias("end_index"), F.count("*").alias("length"), F.min("confidence").alias("min_confidence"))
    rank = F.row_number().over(Window.partitionBy("utt_id").orderBy(F.col("length").desc(), "min_confidence", "start_index"))
    return runs.withColumn("rank", rank).where(F.col("rank") <= k).select("utt_id", "rank", "start_index", "end_index", "length", "min_confidence")


def gap_evidence(segments: DataFrame, frames: DataFrame | Column, attempt: list[str] | None = None) -> DataFrame:
    """What the frames strictly between two neighbours tell of their gap; ``frames``: utt_id, frame_idx, blank_posterior, confidence.

    Where an utterance has several alignments, told apart by the columns ``attempt``, all are looked up in the same sums.

    A gap is like a pause with at least three frames between, a mean blank of .70 and .60 of the frames at a blank of .65.
    Sums of a gap are differences of an utterance's running sums, so neither frames nor gaps multiply.  ``frames`` may be
    an array of structs made of a segment's columns, each frame in one of an utterance's segments: only segments are shuffled then.
    """
    attempt = attempt or []
    own = Window.partitionBy("utt_id", *attempt)
    all_ = segments.withColumns({"begin": F.lag("frame_end").over(own.orderBy("seg_idx")) + 1, "last_idx": F.max("seg_idx").over(own)})
    n = F.greatest(F.lit(0), F.col("frame_start") - F.col("begin"))
    gap = F.struct(*attempt, F.col("seg_idx").alias("next_idx"), n.alias("frame_count"), (F.col("seg_idx") >= F.col("last_idx") - 1).alias("is_tail_gap"))
    if isinstance(frames, Column):
        seen = _within(all_.select("utt_id", gap.alias("gap"), F.col("begin").cast("long").alias("low"), (F.col("begin") + n).cast("long").alias("high"), frames.alias("frames")), _sums)
    else:
        g = all_.where("begin is not null").select("utt_id", gap.alias("gap"), "begin", (F.col("begin") + n).alias("end"))
        seen = range_sums(frames, g, ["utt_id"], "frame_idx", ["gap"], _sums(F.col("blank_posterior"), F.col("confidence")), "begin", "end")
    out = seen.select("utt_id", "gap.*", *(c.alias(name) for name, c in _means().items()))
    return out.select("utt_id", *attempt, "next_idx", "frame_count", "is_tail_gap", "blank_mean", "blank_dominant_ratio", "confidence_mean", "confidence_low_ratio", _pause().alias("pause_like"))


def _means() -> dict[str, Column]:
    mean = lambda c, unit=1.0: F.when(F.col("n_points") > 0, F.col(c) / unit / F.col("n_points"))
    return {"blank_mean": mean("b", _UNIT), "blank_dominant_ratio": mean("bd"), "confidence_mean": mean("c", _UNIT), "confidence_low_ratio": mean("cl")}


def _pause() -> Column:
    return F.coalesce((F.col("frame_count") >= 3) & (F.round("blank_mean", 9) >= 0.70) & (F.col("blank_dominant_ratio") >= 0.60), F.lit(False))


def with_pauses(segments: DataFrame, frames: Column, keep: list[str]) -> DataFrame:
    """utt_id, seg_idx and ``keep`` of all segments and whether the gap before each is like a pause; ``frames`` as an array, see ``gap_evidence``.

    The segments go along with the ends of their gaps, so that they are shuffled by utterance once and joined with nothing.
    """
    own = Window.partitionBy("utt_id")
    rows = segments.withColumn("begin", F.lag("frame_end").over(own.orderBy("seg_idx")) + 1)
    n = F.greatest(F.lit(0), F.col("frame_start") - F.col("begin"))
    gap = F.struct(F.when(F.col("begin").isNotNull(), n).alias("frame_count"), F.struct("seg_idx", *keep).alias("s"))
    low = F.coalesce(F.col("begin"), F.col("frame_start"), F.lit(0)).cast("long")
    seen = _within(rows.select("utt_id", gap.alias("gap"), low.alias("low"), (low + F.coalesce(n, F.lit(0))).alias("high"), frames.alias("frames")), _sums)
    out = seen.select("utt_id", "gap.*", *(c.alias(name) for name, c in _means().items()))
    return out.select("utt_id", "s.*", _pause().alias("pause_like"))


def _sums(blank: Column, sure: Column) -> dict[str, Column]:
    return {"b": _fixed(blank), "bd": (blank >= 0.65).cast("long"), "c": _fixed(sure), "cl": (sure < 0.35).cast("long")}


def _within(rows: DataFrame, sums) -> DataFrame:
    """The sums of gaps (low to high; null low: none) and their utterances' ``frames``; both come out of the rows behind their one shuffle."""
    names = list(sums(F.lit(0.0), F.lit(0.0)))
    kind = f"struct<_at: long, _point: int, gap: {rows.schema['gap'].dataType.simpleString()}, _sign: int, {', '.join(f'{n}: long' for n in names)}>"
    nothing = F.lit(None)
    points = F.transform("frames", lambda f: F.struct(f["frame_idx"], F.lit(1), nothing, nothing, *(F.coalesce(c, F.lit(0)) for c in sums(f["blank_posterior"], f["confidence"]).values())).cast(kind))
    end = lambda at, sign: F.struct(F.col(at), F.lit(0), F.col("gap"), F.lit(sign), *(F.lit(0) for _ in names)).cast(kind)
    ends = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), F.array(end("low", -1), end("high", 1)))
    both = rows.select("utt_id", F.explode(F.concat(F.coalesce(points, F.array().cast(f"array<{kind}>")), F.coalesce(ends, F.array().cast(f"array<{kind}>")))).alias("x"))
    return between(both.select("utt_id", "x.*"), ["utt_id"], ["gap"], names)


_UNIT = 1e12


def _fixed(value: Column) -> Column:
    """A posterior in whole millionths of a millionth, so that running sums of it are exact and their order decides nothing."""
    return F.round(value * _UNIT).cast("long")


def timing_summary(segments: DataFrame, evidence: DataFrame | None = None, alignments: DataFrame | None = None) -> DataFrame:
    """Gap, duration and confidence figures and the quality level of each utterance.

    ``segments`` carry their effective thresholds; ratios of the fixed ones stand beside.  ``evidence``
    (of ``gap_evidence``) tells which gaps are pauses; without it the segments' column pause_like does, or none is.  ``alignments`` (utt_id,
    coverage, normalized_log_prob, blank_ratio) are passed on; without them coverage is 1.  Mean confidence is taken
    to nine places, so that the order of summing decides nothing.
    """
    whole = Window.partitionBy("utt_id")
    rows = segments.withColumns({
        "gap": F.greatest(F.lit(0.0), F.col("start_time") - F.lag("end_time").over(by_utt())), "from_end": F.max("seg_idx").over(whole) - F.col("seg_idx"),
        "length": F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time"))})
    rows = rows.withColumn("gap", F.when(F.col("seg_idx") > F.min("seg_idx").over(whole), F.col("gap")))
    if evidence is None:
        rows = rows if "pause_like" in rows.columns else rows.withColumn("pause_like", F.lit(False))
    else:
        rows = rows.join(evidence.select("utt_id", F.col("next_idx").alias("seg_idx"), "pause_like"), ["utt_id", "seg_idx"], "left").fillna(False, ["pause_like"])
    tail, pause, c = F.col("from_end") <= 1, F.col("pause_like"), F.col("confidence")
    most = lambda condition=F.lit(True): F.coalesce(F.max(F.when(condition, F.col("gap"))), F.lit(0.0))
    above = lambda limit, condition=F.lit(True): F.count_if((F.col("gap") > limit) & condition)
    share = lambda condition: F.count_if(condition) / F.count("*")
    out = rows.groupBy("utt_id").agg(
        F.count("*").alias("segment_count"), F.percentile("length", F.lit(0.5)).alias("median_duration"), F.max("length").alias("max_duration"), F.min(c).alias("min_confidence"), F.round(F.avg(c), 9).alias("avg_confidence"),
        share(c < F.col("low_threshold")).alias("low_ratio"), share(c < F.col("very_low_threshold")).alias("very_low_ratio"), share(c < t.LOW).alias("raw_low_ratio"), share(c < t.VERY_LOW).alias("raw_very_low_ratio"),
        ((F.count("*") >= 2) & (F.count_if((c < F.col("very_low_threshold")) & tail) == 2)).alias("final_very_low"),
        most().alias("max_gap"), most(tail).alias("max_tail_gap"), most(~tail).alias("max_internal_gap"), most(~tail & ~pause & (F.col("gap") > t.FAILURE_GAP)).alias("max_unexplained_internal_gap"),
        most(~tail & pause & (F.col("gap") > t.LARGE_GAP)).alias("max_pause_gap"), above(t.LARGE_GAP).alias("large_gap_count"), above(t.WARNING_GAP).alias("warning_gap_count"),
        above(t.FAILURE_GAP, ~tail & ~pause).alias("failure_gap_count"), above(t.LARGE_GAP, ~tail & pause).alias("pause_gap_count"), above(t.LARGE_GAP, ~tail & ~pause).alias("unexplained_large_gap_count"))
    if alignments is None:
        out = out.withColumns({"coverage": F.lit(1.0), "normalized_log_prob": F.lit(0.0), "blank_ratio": F.lit(0.0)})
    else:
        out = out.join(alignments.select("utt_id", "coverage", "normalized_log_prob", "blank_ratio"), "utt_id", "left")
    level = (
        F.when((F.col("coverage") < 0.90) | (F.col("max_tail_gap") > t.LARGE_GAP) | (F.col("failure_gap_count") > 0), "discardable")
        .when((F.col("warning_gap_count") > 0) | (F.col("large_gap_count") >= 3) | (F.col("very_low_ratio") > 0.15), "usable_with_warnings")
        .when((F.col("large_gap_count") > 0) | (F.col("very_low_ratio") > 0.10), "minor_warnings")
        .otherwise("clean")
    )
    return out.withColumn("quality_level", level)


def top_gaps(segments: DataFrame, k: int = 10) -> DataFrame:
    """The k longest gaps of each utterance, ties by index."""
    rank = F.row_number().over(Window.partitionBy("utt_id").orderBy(F.col("gap").desc(), "next_idx"))
    return gaps(segments).withColumn("rank", rank).where(F.col("rank") <= k)


def _names(conditions: dict[str, Column]) -> Column:
    """The names whose condition holds, in order; null counts as no."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in conditions.items())))


def failed_checks() -> Column:
    """The names of the ten checks that a timing summary fails."""
    long = (F.col("median_duration") > 0) & (F.col("max_duration") > F.greatest(F.lit(0.75), F.col("median_duration") * 8))
    return _names({
        "coverage": F.col("coverage") < 0.90, "avg_confidence": F.col("avg_confidence") < 0.45, "low_ratio": F.col("low_ratio") > 0.45, "very_low_ratio": F.col("very_low_ratio") > 0.30,
        "log_prob": F.col("normalized_log_prob") < -1.5, "blank_ratio": F.col("blank_ratio") > 0.97, "final_phones": F.col("final_very_low"), "long_phone": long,
        "tail_gap": F.col("max_tail_gap") > t.LARGE_GAP, "internal_gap": (F.col("max_tail_gap") <= t.LARGE_GAP) & (F.col("max_unexplained_internal_gap") > t.FAILURE_GAP),
    })


def alignment_gate(summary: DataFrame) -> DataFrame:
    """passed, and the failed checks by name, of each utterance's timing summary."""
    failed = failed_checks()
    return summary.select("utt_id", (F.size(failed) == 0).alias("passed"), F.array_join(failed, ",").alias("reasons"))


def soft_accept_gates(rows: DataFrame) -> DataFrame:
    """Gates of utt_id, audio_passed, coarse_score, alignment_passed (null: not judged; unjudged audio does not fail).

    A good alignment makes up for a low coarse score; rows that fail any gate are accepted with a warning.
    """
    aligned, raw = F.coalesce("alignment_passed", F.lit(False)), F.col("coarse_score") >= t.COARSE_SCORE
    every = F.coalesce("audio_passed", F.lit(True)) & (raw | aligned) & aligned
    return rows.select("utt_id", "audio_passed", raw.alias("raw_coarse_passed"), (~raw & aligned).alias("coarse_recovered"), (raw | aligned).alias("coarse_passed"), aligned.alias("alignment_passed"), (~every).alias("soft_accepted"))


def prosody_usage(rows: DataFrame) -> DataFrame:
    """How far the prosody stage may use an utterance's timing: disabled, limited, cautious or full, why, and what limits it.

    ``rows``: a timing summary (quality_level null: no alignment) with scope, evaluation_status, gate_passed,
    audio_passed, coarse_passed (null: not judged) and is_partial (a trimmed tail).  ``raw_scope`` and ``raw_very_low_ratio``,
    by the fixed thresholds, are passed on where they are at hand.  Times in detail are allowed wherever the alignment may be used at all.
    """
    very_low, level = F.col("very_low_ratio"), F.col("quality_level")
    broad = F.col("scope").isin("global", "mixed") & (very_low > 0)
    much, some = F.coalesce((very_low > 0.15) | broad, F.lit(False)), F.coalesce((very_low > 0.10) | broad, F.lit(False))
    gate, pause, tail = ~F.col("gate_passed"), F.col("pause_gap_count") > 0, F.col("max_tail_gap") > t.LARGE_GAP
    many = F.col("large_gap_count") >= 3
    scoped = lambda condition, otherwise: F.when(condition, F.concat(F.lit("confidence_limited_"), F.coalesce("scope", F.lit(otherwise))))

    def reasons(head: dict[str, Column], scope: Column, last: dict[str, Column], default: str | None) -> Column:
        found = F.array_compact(F.concat(_names(head), F.array(scope), _names(last)))
        return found if default is None else F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)

    off = level.isNull() | (F.col("evaluation_status") != "ready")
    # Names of usages, reasons and limits.
    why = (
        F.when(level.isNull(), F.array(F.lit("forced_alignment_missing"))).when(off, F.array(F.lit("evaluation_not_ready")))
        .when(level == "discardable", reasons({"timing_quality_discardable": F.lit(True), "alignment_gate_not_ready": gate}, scoped(much, "unknown"), {"pause_gap_detected": pause, "tail_gap_detected": tail}, None))
        .when(level == "usable_with_warnings", reasons({
            "alignment_gate_not_ready": gate, "pause_gap_detected": pause, "large_internal_gap_warning": F.col("warning_gap_count") > 0, "many_large_gaps": many,
            "many_very_low_confidence_segments": very_low > 0.15}, scoped(much, "unknown"), {}, "timing_quality_usable_with_warnings"))
        .when(level == "minor_warnings", reasons({
            "alignment_gate_not_ready": gate, "pause_gap_detected": pause, "minor_gap_warning": F.col("large_gap_count") > 0, "minor_low_confidence_warning": very_low > 0.10}, scoped(some, "minor"), {}, "minor_timing_warning"))
        .otherwise(_names({"alignment_gate_not_ready": gate}))
    )
    usage = F.when(off, "disabled").when(level.isin("discardable", "usable_with_warnings"), "limited").when(level == "minor_warnings", "cautious").when(gate, "limited").otherwise("full")
    audio, coarse, partial = ~F.col("audio_passed"), ~F.col("coarse_passed"), F.col("is_partial")
    soft = F.coalesce(audio, F.lit(False)) | F.coalesce(coarse, F.lit(False))
    more = _names({"audio_quality_gate_failed": audio, "coarse_alignment_gate_failed": coarse, "soft_accept_policy_applied": soft, "partial_alignment_tail_excluded": partial})
    limits = _names({
        "alignment_gate": gate, "pause": pause, "confidence": some, "gap": (F.col("warning_gap_count") > 0) | many | (F.col("unexplained_large_gap_count") > 0), "tail": tail,
        "audio_quality": audio, "coarse_alignment": coarse, "partial_tail": partial})
    usage = F.when((usage == "full") & (soft | F.coalesce(partial, F.lit(False))), "cautious").otherwise(usage)
    given = lambda name, kind: F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    return rows.select(
        "utt_id", usage.alias("recommended_usage"), (~off).alias("alignment_for_prosody"), (~off).alias("detailed_timing_allowed"), F.array_join(F.concat(why, more), ",").alias("reasons"), F.array_join(limits, ",").alias("limited_by"),
        level.alias("alignment_quality_level"), F.col("scope").alias("confidence_issue_scope"), given("raw_scope", "string").alias("raw_confidence_issue_scope"), given("raw_very_low_ratio", "double").alias("raw_very_low_confidence_ratio"),
        F.coalesce(very_low, F.lit(0.0)).alias("effective_very_low_confidence_ratio"))


def excluded_tail(references: DataFrame) -> DataFrame:
    """Each reference token by index; those past the aligned ones are excluded.  ``references``: utt_id, tokens, aligned_count."""
    rows = references.select("utt_id", "aligned_count", F.size("tokens").alias("n"), F.posexplode("tokens").alias("index", "token"))
    out = F.col("index") >= F.col("aligned_count")
    return rows.select("utt_id", "index", "token", out.alias("is_excluded"), F.when(out, "unstable_forced_alignment_tail").alias("reason"), (F.col("aligned_count") < F.col("n")).alias("alignment_is_partial"))


def tail_attempts(targets: DataFrame) -> DataFrame:
    """Targets (utt_id, labels, passed: whether the whole alignment passed) to align: the failed ones once more without their last one and last two labels."""
    most = F.least(F.lit(t.TAIL_MAX_TRIM), F.size("labels") - 1)
    trims = F.when(F.col("passed") | (most < 1), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), most))
    rows = targets.withColumn("trim", F.explode(trims))
    return rows.withColumn("labels", F.slice("labels", 1, F.size("labels") - F.col("trim")))


def select_attempt(attempts: DataFrame) -> DataFrame:
    """The attempt of each utterance to go on with: the best passing one without its tail, else the whole one.

    ``attempts``: utt_id, trim, passed and a timing summary.  Among passing tails a better quality level counts
    first, then coverage, fewer and smaller gaps and weak phones, less trim, confidence and log probability.
    """
    level = F.array_position(F.array(*map(F.lit, t.QUALITY_LEVELS)), F.col("quality_level"))
    falls = ["failure_gap_count", "warning_gap_count", "large_gap_count", "very_low_ratio", "low_ratio", "max_tail_gap", "max_unexplained_internal_gap", "max_internal_gap", "trim"]
    tail = (F.col("trim") > 0) & F.col("passed")
    unexplained = F.when(F.col("max_unexplained_internal_gap") > 0, F.col("max_unexplained_internal_gap")).otherwise(F.col("max_internal_gap"))
    order = [tail.desc(), (F.col("trim") > 0).asc(), level.desc(), F.col("coverage").desc(), *((unexplained if c == "max_unexplained_internal_gap" else F.col(c)).asc() for c in falls), F.col("avg_confidence").desc(), F.col("normalized_log_prob").desc()]
    rows = attempts.where((F.col("trim") == 0) | tail).withColumn("n", F.row_number().over(Window.partitionBy("utt_id").orderBy(*order)))
    return rows.where("n = 1").drop("n")


def judged_attempts(segments: DataFrame, frames: DataFrame, alignments: DataFrame) -> DataFrame:
    """Timing summary, passed and failed checks of each alignment of an utterance: whole (trim 0) and without its tails.

    ``segments`` (with thresholds) and ``alignments`` (coverage, normalized_log_prob, blank_ratio): utt_id, trim, ...; ``frames``: of ``gap_evidence``.
    """
    keyed = lambda df: df.withColumn("utt_id", F.struct("utt_id", "trim")).drop("trim")  # noqa: E731  an attempt is an utterance of its own while it is summed up
    summary = timing_summary(keyed(segments), keyed(gap_evidence(segments, frames, ["trim"])), keyed(alignments))
    failed = failed_checks()
    rows = summary.withColumns({"passed": F.size(failed) == 0, "reasons": F.array_join(failed, ",")})
    return rows.withColumns({"trim": F.col("utt_id.trim"), "utt_id": F.col("utt_id.utt_id")})


def retried(attempts: DataFrame) -> DataFrame:
    """The attempt of each utterance to go on with: the whole one if it passes, else the best passing tail that leaves a segment, else the whole one."""
    whole = Window.partitionBy("utt_id")
    full = lambda c: F.max(F.when(F.col("trim") == 0, F.col(c))).over(whole)
    rows = attempts.withColumns({"_passed": full("passed"), "_segments": full("segment_count")})
    return select_attempt(rows.where((F.col("trim") == 0) | (~F.col("_passed") & (F.col("_segments") > F.col("trim"))))).drop("_passed", "_segments")


def tail_hint(segments: DataFrame) -> DataFrame:
    """How many last segments look unstable (0, 1 or 2); utterances of fewer than three segments: 0."""
    w = Window.partitionBy("utt_id")
    length = F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time"))
    gap = F.greatest(F.lit(0.0), F.col("start_time") - F.lag("end_time").over(by_utt()))
    rows = segments.withColumns({"gap": gap, "length": length, "from_end": F.row_number().over(w.orderBy(F.col("seg_idx").desc()))})
    last = lambda column, n: F.max(F.when(F.col("from_end") == n, F.col(column)))
    u = rows.groupBy("utt_id").agg(
        F.count("*").alias("n"), F.percentile("length", F.lit(0.5)).alias("median"), last("confidence", 1).alias("c1"), last("confidence", 2).alias("c2"), last("gap", 1).alias("g1"), last("gap", 2).alias("g2"), last("length", 1).alias("l1"))
    odd = (F.col("median") > 0) & (F.col("l1") > F.greatest(F.lit(0.75), F.col("median") * 8))
    hint = (
        F.when(F.col("n") < 3, 0).when((F.col("c1") < 0.05) & (F.col("c2") < 0.05), 2).when(F.col("g1") > t.LARGE_GAP, 1).when(F.col("g2") > t.LARGE_GAP, 2).when((F.col("c1") < 0.005) & odd, 1).otherwise(0)
    )
    return u.select("utt_id", hint.alias("trim"))
