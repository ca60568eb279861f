"""Prosody of whole utterances against word models: every request ends as a verdict or as a named error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soripark.functions import hangul as h
from soripark.operators import distributions, prosody, spans
from soripark.sources.shared import staged

UNKNOWN_TEXT, TOKEN_COUNT, SYLLABLES = "unknown text", "token count mismatch", "syllable length mismatch"
#: Rows of the token plan of all texts asked for up to which it is sent to every task.
BROADCAST_TOKENS = 200_000


@dataclass(frozen=True)
class Analysis:
    """``outcomes``: one row a request; ``words``: vectors, distances and classes; ``syllables``: contours' deviations in words that stand out."""

    outcomes: DataFrame
    words: DataFrame
    syllables: DataFrame


def token_plan(texts: DataFrame, models: DataFrame) -> DataFrame:
    """text, eojeol_idx, first (tokens of the words before), n_tokens of the word, and the positions of its model's word without punctuation (null: no such word)."""
    words = texts.select("text").distinct().select("text", F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")).alias("eojeol_idx", "word"))
    rows = h.with_tokens(words, "word", "tokens").select("text", "eojeol_idx", F.size("tokens").alias("n_tokens"))
    rows = rows.withColumn("first", F.sum("n_tokens").over(Window.partitionBy("text").orderBy("eojeol_idx")) - F.col("n_tokens"))
    own = models.join(texts.select("text").distinct(), "text", "left_semi").select("text", "eojeol_idx", F.regexp_replace("eojeol", "[.·,!?。]", "").alias("own"))
    own = h.with_tokens(own, "own", "own_tokens").select("text", "eojeol_idx", F.transform("own_tokens", lambda x: x["position"]).alias("positions"))
    return rows.join(own, ["text", "eojeol_idx"], "left")


def analyze(requests: DataFrame, segments: DataFrame, frames: DataFrame, models: DataFrame, inside: float = 2.5) -> Analysis:
    """Requests (utt_id, text) judged word by word.

    ``segments``: utt_id, seg_idx (0, 1, ...), start_time, end_time; ``frames``: utt_id, frame_idx, t, f0 (normalised), voiced; ``models``:
    text, eojeol_idx, eojeol, mean, std, cov_inv, mode, n, syllable_contours.  Errors, the first that holds: no model of
    the text; more or fewer segments than the text's tokens (none counts as 0); a word whose model has other tokens than it.  Words
    without a model of their own are left out, as are a request's words beyond the model's.
    """
    plan = staged(token_plan(requests, models), "plan")
    n_plan = plan.count()
    size = F.size("positions")
    per_text = plan.groupBy("text").agg(F.sum("n_tokens").alias("expected"), F.bool_or(F.col("positions").isNotNull() & (size != F.col("n_tokens"))).alias("odd"), F.bool_or(F.col("positions").isNotNull()).alias("known"))
    counts = segments.groupBy("utt_id").agg(F.count("*").alias("n_segments"))
    small = lambda df: F.broadcast(df) if n_plan <= BROADCAST_TOKENS else df
    judged = requests.select("utt_id", "text").join(small(per_text), "text", "left").join(counts, "utt_id", "left")
    error = (
        F.when(~F.coalesce("known", F.lit(False)), UNKNOWN_TEXT).when(F.coalesce("n_segments", F.lit(0)) != F.col("expected"), TOKEN_COUNT).when(F.col("odd"), SYLLABLES)
    )
    judged = staged(judged.select("utt_id", "text", error.alias("error")), "requests")

    tokens = plan.where("positions is not null").select("text", "eojeol_idx", "first", F.posexplode("positions").alias("i", "position")).select("text", "eojeol_idx", (F.col("first") + F.col("i")).alias("seg_idx"), "position")
    good = judged.where("error is null").select("utt_id", "text")
    spoken = segments.select("utt_id", "seg_idx", "start_time", "end_time").join(good, "utt_id").join(small(tokens), ["text", "seg_idx"])
    word = ["utt_id", "text", "eojeol_idx"]
    spoken = staged(spoken.select(F.struct(*word).alias("utt_id"), "seg_idx", "start_time", "end_time", "position"), "spoken")
    named = lambda df: df.select("utt_id.*", *(c for c in df.columns if c != "utt_id"))
    syllables = named(spans.syllable_spans(spoken, spoken).where("error is null").drop("error"))
    bounds = named(spoken.groupBy("utt_id").agg(F.min_by("start_time", "seg_idx").alias("t0"), F.max_by("end_time", "seg_idx").alias("t1")))
    syllables, bounds = staged(syllables, "syllables"), staged(bounds, "words")

    sliced = spans.slice_frames(frames.select("utt_id", "frame_idx", "t", "f0", "voiced"), bounds)
    own = Window.partitionBy(*word)
    sliced = sliced.withColumns({"pos": F.row_number().over(own.orderBy("frame_idx")) - 1, "total": F.count("*").over(own)})
    vectors = prosody.word_vectors(sliced, word, syllables.select(*word, F.col("syl_idx").alias("idx"), (F.col("t1") - F.col("t0")).alias("duration")), bounds)
    models = models.select("text", "eojeol_idx", "eojeol", "mean", "std", "cov_inv", "mode", "n", "syllable_contours")
    words = distributions.scored(vectors.select(*word, prosody.as_array().alias("v")), models.drop("syllable_contours"), ["text", "eojeol_idx"], inside)
    words = staged(words.join(bounds, word).select(*word, "eojeol", "t0", "t1", "v", "distance", "inside", "z", "classes", "mode", "n"), "scored")

    outliers = syllables.join(words.where("not inside").select(*word), word, "left_semi")
    contours = spans.span_contours(frames, outliers, [*word, "syl_idx"]).join(models.select("text", "eojeol_idx", "syllable_contours"), ["text", "eojeol_idx"])
    mean = F.get("syllable_contours", F.col("syl_idx"))
    squares = F.zip_with("contour", mean, lambda a, b: (a - b) * (a - b))
    rmse = F.when(mean.isNotNull(), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size("contour")))
    drilldown = contours.select(*word, "syl_idx", "contour", mean.alias("mean_contour"), rmse.alias("rmse"))
    outcomes = judged.join(distributions.sentence_verdict(words, ["utt_id", "text"]), ["utt_id", "text"], "left")
    return Analysis(outcomes, words, drilldown)
