"""Time spans of syllables and words, the frames inside them, contours of spans, and hints where in a word something is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soripark.operators.prosody import resampled


def slice_frames(frames: DataFrame, spans: DataFrame, width: float = 0.5) -> DataFrame:
    """Frames (utt_id, t, ...) of each span (utt_id, t0, t1, ...) with t0 <= t < t1; spans may overlap.

    Both sides meet by utterance and time bin of ``width`` seconds, so a frame meets only spans near it.
    """
    bin_ = lambda t: F.floor(t / width)
    dealt = spans.where("t1 > t0").withColumn("_bin", F.explode(F.sequence(bin_(F.col("t0")), bin_(F.col("t1")))))
    met = dealt.join(frames.withColumn("_bin", bin_(F.col("t"))), ["utt_id", "_bin"])
    return met.where("t >= t0 and t < t1").drop("_bin")


def syllable_spans(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """utt_id, syl_idx, t0, t1 and error; ``positions``: utt_id, seg_idx, position of the reference's phones.

    A syllable begins at the first phone and where an onset or nucleus follows a coda or nucleus; groups without a nucleus
    are left out.  An utterance with more or fewer positions than segments is one row with an error.
    """
    both = segments.select("utt_id", "seg_idx", "start_time", "end_time").join(positions.select("utt_id", "seg_idx", "position"), ["utt_id", "seg_idx"], "full")
    w = Window.partitionBy("utt_id")
    odd = F.max(F.when(F.col("start_time").isNull() | F.col("position").isNull(), 1).otherwise(0)).over(w)
    before = F.lag("position").over(w.orderBy("seg_idx"))
    opens = before.isNull() | (before.isin("coda", "nucleus") & F.col("position").isin("onset", "nucleus"))
    rows = both.withColumns({"_odd": odd, "_opens": opens.cast("int")})
    rows = rows.withColumn("_group", F.sum("_opens").over(w.orderBy("seg_idx")))
    groups = rows.where("_odd = 0").groupBy("utt_id", "_group").agg(F.min_by("start_time", "seg_idx").alias("t0"), F.max_by("end_time", "seg_idx").alias("t1"), F.bool_or(F.col("position") == "nucleus").alias("_voiced"))
    spans = groups.where("_voiced").withColumn("syl_idx", F.row_number().over(w.orderBy("_group")) - 1)
    wrong = rows.where("_odd = 1").select("utt_id").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    return spans.select("utt_id", "syl_idx", "t0", "t1", none("string").alias("error")).unionByName(
        wrong.select("utt_id", none("int").alias("syl_idx"), none("double").alias("t0"), none("double").alias("t1"), F.lit("length mismatch").alias("error")))


def word_counts(texts: DataFrame) -> DataFrame:
    """utt_id, word_idx, word, hangul (letters counted) and first: Hangul letters of the words before."""
    words = texts.select("utt_id", F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")).alias("word_idx", "word"))
    rows = words.withColumn("hangul", F.length(F.regexp_replace("word", "[^가-힣]", "")))
    w = Window.partitionBy("utt_id").orderBy("word_idx")
    return rows.withColumn("first", F.sum("hangul").over(w) - F.col("hangul"))


def word_spans(syllables: DataFrame, texts: DataFrame) -> DataFrame:
    """utt_id, eojeol_idx, t0, t1, label: as many syllables as a word has Hangul letters; the last word takes all that are left.

    A word without Hangul letters or without a syllable left has no span.  Labels are the first words of the text in
    order, one a span, so a word without a span shifts the labels after it.
    """
    s = syllables.where("syl_idx is not null")
    n = s.groupBy("utt_id").agg(F.count("*").alias("n"))
    words = word_counts(texts).withColumn("last", F.max("word_idx").over(Window.partitionBy("utt_id"))).join(n, "utt_id")
    end = F.when(F.col("word_idx") == F.col("last"), F.col("n")).otherwise(F.least("n", F.col("first") + F.col("hangul")))
    owned = words.withColumn("end", end).where("first < end").select("utt_id", "word_idx", F.explode(F.sequence(F.col("first").cast("int"), F.col("end").cast("int") - 1)).alias("syl_idx"))
    spans = owned.join(s, ["utt_id", "syl_idx"]).groupBy("utt_id", "word_idx").agg(F.min_by("t0", "syl_idx").alias("t0"), F.max_by("t1", "syl_idx").alias("t1"), F.min("syl_idx").alias("first_syl"), F.max("syl_idx").alias("last_syl"))
    spans = spans.withColumn("eojeol_idx", F.row_number().over(Window.partitionBy("utt_id").orderBy("word_idx")) - 1)
    labels = words.select("utt_id", F.col("word_idx").alias("eojeol_idx"), F.col("word").alias("label"))
    return spans.join(labels, ["utt_id", "eojeol_idx"], "left").select("utt_id", "eojeol_idx", "t0", "t1", "label", "first_syl", "last_syl")


def whole_spans(frames: DataFrame) -> DataFrame:
    """One span an utterance, from 0 to its last frame."""
    return frames.groupBy("utt_id").agg(F.lit(0.0).alias("t0"), F.max("t").alias("t1")).withColumn("label", F.lit("전체"))


def span_contours(frames: DataFrame, spans: DataFrame, by: list[str], n: int = 50) -> DataFrame:
    """``by``, n_frames and contour (n points of f0 by linear interpolation; zeros for a span without frames)."""
    inside = slice_frames(frames.select("utt_id", "t", "frame_idx", "f0"), spans).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("frame_idx", "f0"))).alias("x"))
    rows = spans.select(*by).join(inside, by, "left").withColumn("values", F.transform(F.coalesce("x", F.array().cast("array<struct<frame_idx: int, f0: double>>")), lambda e: e["f0"]))
    return rows.select(*by, F.size("values").alias("n_frames"), resampled(F.col("values"), n).alias("contour"))


def mean_contours(contours: DataFrame, by: list[str]) -> DataFrame:
    """The mean contour of each group, point by point; sums per point are added up by partition."""
    points = contours.select(*by, F.posexplode("contour").alias("i", "v")).groupBy(*by, "i").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct("i", "v")))
    return points.groupBy(*by).agg(F.transform(order, lambda x: x["v"]).alias("mean_contour"), F.max("n").alias("n"))


def syllable_drilldown(contours: DataFrame, means: DataFrame, outliers: DataFrame, word: list[str], syllable: list[str]) -> DataFrame:
    """rmse of each syllable's contour against the mean one, for words in ``outliers`` (keys ``word``) only; null where there is no mean.

    ``means`` are keyed by ``syllable``, columns that ``contours`` has as well.
    """
    rows = contours.join(outliers.select(*word).distinct(), word, "left_semi").join(means.select(*syllable, "mean_contour"), syllable, "left")
    squares = F.zip_with("contour", "mean_contour", lambda a, b: (a - b) * (a - b))
    return rows.withColumn("rmse", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size("contour"))).drop("contour", "mean_contour")


def position_hint(pos: Column, total: Column) -> Column:
    # Names of a syllable's place.
    return (
        F.when(total == 1, F.lit("유일 음절")).when(pos == 0, F.lit("첫 음절")).when(pos == total - 1, F.lit("마지막 음절"))
        .otherwise(F.concat((pos + 1).cast("string"), F.lit("번째 음절")))
    )


def syllable_hints(windows: DataFrame, syllables: DataFrame, by: list[str], least: float = 0.30) -> DataFrame:
    """``by`` and hint: the syllables of which a window (``by``, w0, w1) covers ``least`` or more, as a phrase; null where none.

    ``syllables``: the columns of ``by`` that name the word, pos (place in the word), t0, t1, label; they meet by equality.
    """
    word = [c for c in by if c in syllables.columns]
    total = syllables.groupBy(*word).agg(F.count("*").alias("total"))
    length = F.col("t1") - F.col("t0")
    covered = F.greatest(F.lit(0.0), F.least("w1", "t1") - F.greatest("w0", "t0"))
    hit = windows.join(syllables, word).where((length > 0) & (covered / F.nullif(length, F.lit(0.0)) >= least)).join(total, word)
    got = hit.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("label", F.lit("")).alias("label")))).alias("s"), F.first("total").alias("total"))
    label = F.array_join(F.transform("s", lambda x: x["label"]), "")
    first, last = position_hint(F.get("s", F.lit(0))["pos"], F.col("total")), position_hint(F.element_at("s", -1)["pos"], F.col("total"))
    phrase = F.when(F.size("s") == 1, first).otherwise(F.concat(first, F.lit("~"), last))
    hint = F.when(label != "", F.concat(phrase, F.lit(" ("), label, F.lit(")"))).otherwise(phrase)
    return windows.select(*by).distinct().join(got.select(*by, hint.alias("hint")), by, "left")
