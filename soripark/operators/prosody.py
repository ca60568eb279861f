"""Pitch frames: normalisation, interpolation, contours, word vectors and rules."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soripark import tables as t


def utt():
    return Window.partitionBy("utt_id")


def by_frame():
    return utt().orderBy("frame_idx")


def zscore(frames: DataFrame) -> DataFrame:
    """voiced and f0 (z over an utterance's voiced frames, population deviation; 0 where unvoiced or constant)."""
    voiced = F.col("f0_raw") > 0
    own = F.when(voiced, F.col("f0_raw"))
    mean, std = F.avg(own).over(utt()), F.stddev_pop(own).over(utt())
    z = F.when(voiced & (std > 0), (F.col("f0_raw") - mean) / std).otherwise(0.0)
    return frames.withColumns({"voiced": F.coalesce(voiced, F.lit(False)), "f0": F.coalesce(z, F.lit(0.0))})


def interpolated(frames: DataFrame, value: str = "f0", into: str = "f0_filled") -> DataFrame:
    """Unvoiced frames on the line between voiced neighbours by index, level at the ends; without a voiced frame as they are."""
    own, place = F.when(F.col("voiced"), F.col(value)), F.when(F.col("voiced"), F.col("frame_idx"))
    back, ahead = by_frame().rowsBetween(Window.unboundedPreceding, 0), by_frame().rowsBetween(0, Window.unboundedFollowing)
    rows = frames.withColumns({"_v0": F.last(own, True).over(back), "_i0": F.last(place, True).over(back), "_v1": F.first(own, True).over(ahead), "_i1": F.first(place, True).over(ahead)})
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("frame_idx") - F.col("_i0")) / F.nullif(F.col("_i1") - F.col("_i0"), F.lit(0))
    return rows.withColumn(into, F.coalesce(own, between, "_v0", "_v1", value)).drop("_v0", "_i0", "_v1", "_i1")


def resampled(values: Column, n: int = 50) -> Column:
    """n points of an array by linear interpolation over its length; an empty one: n zeros."""
    size = F.size(values)

    def point(i: Column) -> Column:
        x = i * (size - 1) / F.lit(float(n - 1))
        low = F.floor(x).cast("int")
        a, b = F.get(values, low), F.coalesce(F.get(values, low + 1), F.get(values, low))
        return F.when(size > 0, a + (b - a) * (x - low)).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def contour_metrics(pairs: DataFrame, by: list[str], durations: DataFrame | None = None) -> DataFrame:
    """rmse, pearson (5 points), slope difference (3 points) and count over jointly voiced points (x, native, learner).

    ``durations`` (by, native_duration, learner_duration) add their ratio (null for no native length), and a row of count 0 for
    each key without a jointly voiced point.
    """
    n, l, x = F.col("native"), F.col("learner"), F.col("x").cast("double")
    out = pairs.where("voiced").groupBy(*by).agg(
        F.count("*").alias("voiced_count"), F.sqrt(F.avg((n - l) * (n - l))).alias("rmse"), F.stddev_pop(n).alias("sn"), F.stddev_pop(l).alias("sl"),
        F.covar_pop(n, l).alias("c"), (F.regr_slope(n, x) - F.regr_slope(l, x)).alias("slope"))
    pearson = F.when((F.col("voiced_count") >= 5) & (F.col("sn") > 0) & (F.col("sl") > 0), F.try_divide("c", F.col("sn") * F.col("sl")))
    out = out.select(*by, "voiced_count", "rmse", pearson.alias("pearson"), F.when(F.col("voiced_count") >= 3, F.col("slope")).alias("slope_diff"))
    if durations is None:
        return out
    ratio = F.when(F.col("native_duration") > 0, F.col("learner_duration") / F.col("native_duration"))
    return durations.select(*by, ratio.alias("duration_ratio")).join(out, by, "left").fillna(0, ["voiced_count"])


def word_vectors(frames: DataFrame, by: list[str], syllables: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """The pitch part of the word vector per group of ``by``: frames carry pos (index in the word), total, f0, voiced.

    Fewer than two voiced frames: zeros and middle positions; two: the slope is the rise.  ``syllables``
    (by, idx, duration) add their count and the last one's length against the mean.  ``words`` (by, t0, t1) add the
    duration, and a row for each word without frames.
    """
    v = F.col("voiced")
    own = lambda c: F.when(v, F.col(c))
    pos = F.col("pos") / F.greatest(F.col("total") - 1, F.lit(1))
    first = lambda value, order: F.min_by(value, F.when(v, order))
    rows = frames.withColumn("npos", pos)
    out = rows.groupBy(*by).agg(
        F.count_if(v).alias("n"), F.count("*").alias("total_frames"), F.avg(own("f0")).alias("mean"), F.stddev_pop(own("f0")).alias("std"), (F.max(own("f0")) - F.min(own("f0"))).alias("range"),
        first(F.col("npos"), F.struct(-F.col("f0"), F.col("pos"))).alias("max_pos"), first(F.col("npos"), F.struct("f0", "pos")).alias("min_pos"),
        first(F.col("f0"), F.col("pos")).alias("start"), first(F.col("f0"), -F.col("pos")).alias("end"), F.regr_slope(own("f0"), own("npos")).alias("slope"))
    enough = F.col("n") >= 2
    of = lambda c, other=0.0: F.when(enough, F.col(c)).otherwise(other)
    slope = F.when(F.col("n") >= 3, F.col("slope")).when(enough, F.col("end") - F.col("start")).otherwise(0.0)
    out = out.select(*by, of("mean").alias("f0_mean"), of("std").alias("f0_std"), slope.alias("f0_slope"), of("range").alias("f0_range"), of("max_pos", 0.5).alias("f0_max_pos"), of("min_pos", 0.5).alias("f0_min_pos"),
                     of("start").alias("f0_start"), of("end").alias("f0_end"), (F.col("n") / F.col("total_frames")).alias("voiced_ratio"))
    if words is not None:
        nothing = {c: 0.5 if c.endswith("_pos") else 0.0 for c in out.columns if c not in by}
        out = words.select(*by, (F.col("t1") - F.col("t0")).alias("duration")).join(out, by, "left").fillna(nothing)
    if syllables is None:
        return out
    s = syllables.groupBy(*by).agg(F.count("*").alias("syllable_count"), F.avg("duration").alias("a"), F.max_by("duration", "idx").alias("last"))
    ratio = F.when((F.col("syllable_count") >= 2) & (F.col("a") > 0), F.col("last") / F.col("a")).otherwise(1.0)
    return out.join(s.select(*by, "syllable_count", ratio.alias("last_syl_ratio")), by, "left").fillna({"syllable_count": 0, "last_syl_ratio": 1.0})


def as_array() -> Column:
    """The twelve values of ``word_vectors`` in their fixed order."""
    return F.array(*(F.col(name).cast("double") for name in t.DIMS))


def severity(value: Column, threshold: float) -> Column:
    return F.when(F.abs(value) >= 2 * threshold, "major").otherwise("minor")


def pitch_offset(words: DataFrame, tau: float = t.RULES["pitch_offset"]) -> DataFrame:
    """Words (utt_id, eojeol_idx, native_mean, learner_mean) whose mean pitch differs by tau or more."""
    d = F.col("learner_mean") - F.col("native_mean")
    return words.where(F.abs(d) >= tau).select("utt_id", "eojeol_idx", F.lit("pitch_offset").alias("rule_label"), d.alias("value"), severity(d, tau).alias("severity"))


def eojeol_slow(words: DataFrame, tau: float = t.RULES["eojeol_slow"]) -> DataFrame:
    """Words (native_duration, learner_duration) whose ratio is off 1 by tau - 1 or more."""
    ratio = F.try_divide("learner_duration", "native_duration")
    return words.where(F.abs(ratio - 1) >= tau - 1).select("utt_id", "eojeol_idx", F.lit("eojeol_slow").alias("rule_label"), ratio.alias("value"), severity(ratio, tau).alias("severity"))


def syllable_elongation(syllables: DataFrame, tau: float = t.RULES["syllable_elongation"]) -> DataFrame:
    """The syllable of each word with the largest duration ratio, if that is tau or more; the first of equal ones."""
    ratio = F.try_divide("learner_duration", "native_duration")
    w = Window.partitionBy("utt_id", "eojeol_idx").orderBy(F.col("value").desc_nulls_last(), "syl_idx")
    rows = syllables.withColumn("value", ratio).withColumn("n", F.row_number().over(w)).where((F.col("n") == 1) & (F.col("value") >= tau))
    return rows.select("utt_id", "eojeol_idx", F.lit("syllable_elongation").alias("rule_label"), "value", severity(F.col("value"), tau).alias("severity"), "syl_idx")


def at_times(frames: DataFrame, queries: DataFrame) -> DataFrame:
    """The first frame at or after each query time of its utterance (the last frame beyond the end): a forward as-of join.

    Both sides meet in one window an utterance, so nothing multiplies.
    """
    both = frames.select("utt_id", "t", F.struct("frame_idx", "f0").alias("frame"), F.lit(None).cast("long").alias("query_id")).unionByName(
        queries.select("utt_id", "t", F.lit(None).cast("struct<frame_idx: int, f0: double>").alias("frame"), F.col("query_id").cast("long").alias("query_id")))
    w = utt().orderBy("t", F.col("frame").isNotNull())
    ahead = F.first("frame", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    last = F.last("frame", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn("hit", F.coalesce(ahead, last)).where("query_id is not null").select("utt_id", "query_id", "hit.frame_idx", "hit.f0")


def load_rule_config(path: str | None = None) -> dict[str, dict[str, float]]:
    """Thresholds and window ratios of a TOML file (sections thresholds and window) over the built-in ones; other names are an error."""
    rules, window = dict(t.RULES), dict(t.WINDOW)
    if path is not None:
        with open(path, "rb") as file:
            read = tomllib.load(file)
        for own, section in ((rules, "thresholds"), (window, "window")):
            unknown = set(read.get(section, {})) - set(own)
            if unknown:
                raise ValueError(f"unknown names in [{section}]: {sorted(unknown)}")
            own |= {k: float(v) for k, v in read.get(section, {}).items()}
    return {"thresholds": rules, "window": window}
