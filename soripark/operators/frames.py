"""Emission frames: confidence, greedy decoding, pauses, forced alignment; audio samples: energy and quality."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soripark import kernels
from soripark import tables as t


def by_frame():
    return Window.partitionBy("utt_id").orderBy("frame_idx")


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(logits, lambda x: x - top - F.log(total))


def frame_scores(emissions: DataFrame, blank: int = 0) -> DataFrame:
    """Per frame the largest softmax value, the blank's posterior and the best label."""
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return emissions.withColumns({"confidence": 1 / total, "blank_posterior": F.exp(F.get("logits", F.lit(blank)) - top) / total, "label_id": F.array_position("logits", top).cast("int") - 1})


def greedy_decode(emissions: DataFrame, blank: int = 0) -> DataFrame:
    """Best label a frame, repeats collapsed, blanks dropped, in order."""
    rows = frame_scores(emissions, blank).withColumn("before", F.lag("label_id").over(by_frame()))
    kept = rows.where((F.col("label_id") != blank) & (F.col("before").isNull() | (F.col("before") != F.col("label_id"))))
    out = kept.groupBy("utt_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "label_id"))), lambda x: x["label_id"]).alias("labels"))
    return emissions.select("utt_id").distinct().join(out, "utt_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<int>")))


def frame_boundaries(timestamps: Column, n: Column) -> Column:
    """n + 1 boundaries of n frames from the given times: the first n + 1; of n times the last one's length in equal parts;
    fewer ones go on by their first step (0.02 s if there is one only); none: whole numbers; no frame: 0.0.
    """
    have, place = F.size(timestamps), F.sequence(F.lit(0), n)
    last, step = F.element_at(timestamps, -1), F.coalesce(F.get(timestamps, F.lit(1)) - F.get(timestamps, F.lit(0)), F.lit(0.02))
    return (
        F.when(n <= 0, F.array(F.lit(0.0))).when(timestamps.isNull() | (have == 0), F.transform(place, lambda i: i.cast("double"))).when(have >= n + 1, F.slice(timestamps, 1, F.greatest(n + 1, F.lit(1))))
        .when((have == n) & (n > 1) & (last > 0), F.transform(place, lambda i: last * i / n))
        .otherwise(F.transform(place, lambda i: F.coalesce(F.get(timestamps, i), last + step * (i - have + 1))))
    )


def frame_energy(samples: DataFrame, counts: DataFrame) -> DataFrame:
    """Root mean square of the samples (utt_id, idx, x) of each of an utterance's frames (``counts``: utt_id, frame_count).

    Frame i of F holds samples from n i / F to n (i + 1) / F, rounded half to even, one at least.  Sample numbers are
    joined by equality; an utterance without samples has no rows.
    """
    n = samples.groupBy("utt_id").agg(F.count("*").alias("n"))
    f = counts.join(n, "utt_id").where("frame_count > 0").withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frame_count").cast("long") - 1)))
    edge = lambda i: F.bround(F.col("n") * i / F.col("frame_count")).cast("long")
    begin = edge(F.col("frame_idx"))
    rows = f.select("utt_id", "frame_idx", F.explode(F.sequence(begin, F.greatest(begin + 1, edge(F.col("frame_idx") + 1)) - 1)).alias("idx"))
    return rows.join(samples, ["utt_id", "idx"]).groupBy("utt_id", "frame_idx").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("energy"))


def segment_boundaries(evidence: DataFrame, padding: int = 2, bridged: int = 20) -> DataFrame:
    """start_frame and end_frame (not included) of each label from its first and last frame of evidence.

    ``evidence``: utt_id, label_idx, first, last (null: no evidence, no boundaries), n_frames.  Neighbours with up to
    ``bridged`` blank frames between share them half and half; others keep ``padding`` frames at each side.
    """
    w = Window.partitionBy("utt_id").orderBy("label_idx")
    first, last, before, after = (F.col(c) for c in ("first", "last", "_before", "_after"))
    rows = evidence.where("first is not null").withColumns({"_before": F.lag("last").over(w), "_after": F.lead("first").over(w), "_a": F.greatest(F.lit(0), first - padding)})
    rows = rows.withColumn("_b", F.greatest(F.col("_a") + 1, F.least("n_frames", last + 1 + padding)))
    half = lambda end, begin: end + 1 + F.floor(F.greatest(F.lit(0), begin - end - 1) / 2)
    start = F.when(before.isNull(), F.col("_a")).when(first - before - 1 <= bridged, F.least(half(before, first), F.col("_b") - 1)).otherwise(F.least("_a", F.col("_b") - 1))
    rows = rows.withColumn("start_frame", start)
    end = F.when(after - last - 1 <= bridged, half(last, after)).when(after.isNull(), F.col("_b")).otherwise(F.least("_b", last + 1 + padding))
    out = rows.select("utt_id", "label_idx", "start_frame", F.greatest(F.col("start_frame") + 1, end).alias("end_frame"))
    return out.unionByName(evidence.where("first is null").select("utt_id", "label_idx", F.lit(None).cast("long").alias("start_frame"), F.lit(None).cast("long").alias("end_frame")))


def pause_mask(scored: DataFrame) -> DataFrame:
    """is_pause: blank .85, confidence .70, and energy at most max(.01, .15 of the 95th percentile of positive energy)."""
    loud = scored.where("energy > 0").groupBy("utt_id").agg(F.percentile("energy", F.lit(0.95)).alias("p95"))
    limit = F.greatest(F.lit(0.01), 0.15 * F.coalesce(F.col("p95"), F.lit(0.0)))
    quiet = F.col("energy").isNull() | (F.col("energy") <= limit)
    return scored.join(loud, "utt_id", "left").withColumn("is_pause", (F.col("blank_posterior") >= 0.85) & (F.col("confidence") >= 0.70) & quiet).drop("p95")


def compress_pauses(frames: DataFrame, least: int = 8, edge: int = 2, n_labels: int | Column = 1) -> DataFrame:
    """Frames left, under their own numbers, when pauses of ``least`` frames keep ``edge`` at each end.

    An utterance with fewer than ``n_labels`` frames left (a number, or a column of ``frames`` that holds each utterance's) stays whole.
    """
    labels = F.lit(n_labels) if isinstance(n_labels, int) else n_labels
    before = F.lag("is_pause").over(by_frame())
    rows = frames.withColumn("_new", F.when(before.isNull() | (before != F.col("is_pause")), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(by_frame()))
    run = Window.partitionBy("utt_id", "_run")
    rows = rows.withColumns({"_at": F.row_number().over(run.orderBy("frame_idx")), "_size": F.count("*").over(run)})
    keep = ~F.col("is_pause") | (F.col("_size") < least) | (F.col("_at") <= edge) | (F.col("_at") > F.col("_size") - edge)
    rows = rows.withColumn("_keep", keep).withColumn("_left", F.count_if("_keep").over(Window.partitionBy("utt_id")))
    return rows.where(F.col("_keep") | (F.col("_left") < F.greatest(F.lit(1), F.coalesce(labels, F.lit(1))))).drop("_new", "_run", "_at", "_size", "_keep", "_left")


_SEGMENT = "struct<label: int, first: int, last: int, confidence: double>"
ALIGNED = f"utt_id long, trim int, frames int, labels int, log_prob double, normalized_log_prob double, avg_confidence double, coverage double, blank_ratio double, segments array<{_SEGMENT}>, error string"


def _confidence(own: np.ndarray, near: np.ndarray | None, weak: bool) -> float:
    """Mean of a label's own frames, raised by the posterior around them: by its peak where the evidence is weak or short."""
    value = float(own.mean())
    if near is not None:
        best = float(np.sort(near)[::-1][:3].mean())
        value = max(value, best, 0.85 * float(near.max())) if weak or len(own) <= 2 else max(value, 0.75 * value + 0.25 * best)
    return min(1.0, max(0.0, value))


def _align(logits: np.ndarray, places: np.ndarray, labels: np.ndarray, blank: int, weak: frozenset[int], trims: tuple[int, ...]) -> list[dict]:
    """One row a trim; ``places`` are the numbers of the frames at hand among all the utterance's frames."""
    top = logits.max(1, keepdims=True)
    log_probs = logits - top - np.log(np.exp(logits - top).sum(1, keepdims=True))
    trellis, out = kernels.Trellis(log_probs, labels, blank), []
    paths = trellis.best_paths(trims)
    spans = [[(int(np.searchsorted(path, 2 * k + 1)), int(np.searchsorted(path, 2 * k + 1, "right"))) for k in range(len(labels) - trim)] if len(path) else [] for (path, _), trim in zip(paths, trims)]
    posteriors = trellis.posteriors([[(max(0, a - 2), min(len(logits), b + 2)) for a, b in of] for of in spans], trims)
    for trim, (path, score), of, near in zip(trims, paths, spans, posteriors):
        row = {"trim": trim, "frames": len(logits), "labels": len(labels) - trim, "error": None, "segments": []}
        if not len(path):
            out.append(row | {"error": "no path", "coverage": 0.0})
            continue
        for k, (a, b) in enumerate(of):
            value = _confidence(np.exp(log_probs[a:b, labels[k]]), near[k] if near is not None else None, int(labels[k]) in weak)
            row["segments"].append({"label": int(labels[k]), "first": int(places[a]), "last": int(places[b - 1]), "confidence": value})
        out.append(row | {"log_prob": score, "normalized_log_prob": score / len(path), "avg_confidence": float(np.mean([x["confidence"] for x in row["segments"]])),
                          "coverage": len({p for p in path.tolist() if p % 2}) / (len(labels) - trim), "blank_ratio": float((path % 2 == 0).mean())})
    return out


def align_tails(emissions: DataFrame, targets: DataFrame, blank: int = 0, weak: Iterable[int] = (), most: int = t.TAIL_MAX_TRIM) -> DataFrame:
    """Each utterance's labels on its frames, and the labels without their last 1..``most`` (one stays), a row a trim, all from one trellis.

    ``emissions``: utt_id, frame_idx, logits; numbers may be missing where pauses were cut, and first and last frames
    are given in them.  ``targets``: utt_id, labels.  Labels in ``weak`` (those of ``tables.WEAK_TOKENS``) and of one or two frames
    take the peak of their posterior near them into account.  No frames, no labels, a blank or an unknown number among
    them, fewer frames than labels, no path: a row with ``error``.
    """
    weak_ids = frozenset(weak)

    def run(key, frames: pd.DataFrame, target: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in ("utt_id", "trim", "frames", "labels", "log_prob", "normalized_log_prob", "avg_confidence", "coverage", "blank_ratio", "segments", "error")]
        if not len(target):
            return pd.DataFrame(columns=columns)
        labels = np.array(list(target["labels"].iloc[0] if target["labels"].iloc[0] is not None else []), int)
        frames = frames.sort_values("frame_idx")
        width = len(frames["logits"].iloc[0]) if len(frames) else 0
        checks = {"no labels": not len(labels), "no frames": not len(frames), "blank label": blank in labels, "unknown label": bool(len(labels)) and not (0 <= labels.min() and labels.max() < width), "too few frames": len(labels) > len(frames)}
        wrong = next((name for name, bad in checks.items() if bad), None)
        if wrong:
            rows = [{"trim": 0, "frames": len(frames), "labels": len(labels), "error": wrong, "segments": []}]
        else:
            rows = _align(np.stack(frames["logits"].to_numpy()), frames["frame_idx"].to_numpy(), labels, blank, weak_ids, tuple(range(min(most, len(labels) - 1) + 1)))
        return pd.DataFrame(rows).assign(utt_id=key[0]).reindex(columns=columns)

    named = lambda df, *columns: df.select(F.col("utt_id").cast("long").alias("utt_id"), *columns).groupBy("utt_id")
    return named(emissions, "frame_idx", "logits").cogroup(named(targets, "labels")).applyInPandas(run, ALIGNED)


def force_align(emissions: DataFrame, targets: DataFrame, blank: int = 0, weak: Iterable[int] = ()) -> DataFrame:
    """``align_tails`` of the whole labels only."""
    return align_tails(emissions, targets, blank, weak, 0).drop("trim")


def forced_segments(aligned: DataFrame, times: DataFrame) -> DataFrame:
    """Rows of ``align_tails`` as segments: utt_id, trim, seg_idx, label, start_time, end_time, frame_start, frame_end, confidence.

    ``times``: utt_id, n_frames (all frames, cut pauses included) and timestamps, of which ``frame_boundaries`` makes the frames' borders.
    """
    seen = aligned.select(F.struct("utt_id", "trim").alias("utt_id"), F.posexplode("segments").alias("label_idx", "s"))
    n = times.select(F.col("utt_id").alias("_utt"), "n_frames", frame_boundaries(F.col("timestamps"), F.col("n_frames")).alias("borders"))
    seen = seen.join(n, F.col("utt_id.utt_id") == F.col("_utt")).drop("_utt")
    evidence = seen.select("utt_id", "label_idx", F.col("s.first").alias("first"), F.col("s.last").alias("last"), "n_frames")
    rows = seen.join(segment_boundaries(evidence), ["utt_id", "label_idx"])
    border = lambda i: F.get("borders", F.least(i, "n_frames").cast("int"))
    return rows.select(
        "utt_id.utt_id", "utt_id.trim", F.col("label_idx").alias("seg_idx"), "s.label", border(F.col("start_frame")).alias("start_time"), border(F.col("end_frame")).alias("end_time"),
        F.col("start_frame").alias("frame_start"), F.greatest("start_frame", F.col("end_frame") - 1).alias("frame_end"), "s.confidence")


def align_without_pauses(emissions: DataFrame, targets: DataFrame, blank: int = 0, weak: Iterable[int] = (), most: int = 0) -> DataFrame:
    """``align_tails`` on what is left of the frames when long pauses are cut; ``emissions``: utt_id, frame_idx, logits, energy (null: not known).

    An utterance whose cut frames would be fewer than its labels is aligned whole.
    """
    masked = pause_mask(frame_scores(emissions, blank)).join(targets.select("utt_id", F.size("labels").alias("n_labels")), "utt_id", "left")
    return align_tails(compress_pauses(masked, n_labels=F.col("n_labels")), targets, blank, weak, most)


def block_energy(samples: DataFrame, rate: int = 16000, seconds: float = 0.02) -> DataFrame:
    """Root mean square of each block of ``seconds`` (utt_id, idx, x)."""
    size = max(1, int(rate * seconds))
    return samples.groupBy("utt_id", F.floor(F.col("idx") / size).alias("block")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("energy"))


def trim_bounds(samples: DataFrame, rate: int = 16000, seconds: float = 0.02, padding: float = 0.15, floor: float = 0.01, ratio: float = 0.08) -> DataFrame:
    """First sample kept and the one after the last: active blocks with padding; silent utterances stay whole."""
    size, pad = max(1, int(rate * seconds)), max(1, int(rate * padding))
    blocks = block_energy(samples, rate, seconds)
    limit = F.greatest(F.lit(floor), ratio * F.max("energy").over(Window.partitionBy("utt_id")))
    active = blocks.withColumn("on", F.col("energy") >= limit).groupBy("utt_id").agg(F.min(F.when(F.col("on"), F.col("block"))).alias("a"), F.max(F.when(F.col("on"), F.col("block"))).alias("b"))
    n = samples.groupBy("utt_id").agg(F.count("*").alias("n"))
    return n.join(active, "utt_id", "left").select("utt_id", F.coalesce(F.greatest(F.lit(0), F.col("a") * size - pad), F.lit(0)).alias("start"), F.coalesce(F.least("n", (F.col("b") + 1) * size + pad), "n").alias("end"))


def audio_quality(samples: DataFrame, rate: int = 16000) -> DataFrame:
    """Duration, level, silent and clipped shares, and the reasons that fail an utterance."""
    x = F.abs("x")
    q = samples.groupBy("utt_id").agg((F.count("*") / rate).alias("duration"), (20 * F.log10(F.greatest(F.sqrt(F.avg(x * x)), F.lit(1e-12)))).alias("rms_db"), (F.count_if(x < 0.02) / F.count("*")).alias("silence_ratio"), (F.count_if(x >= 0.995) / F.count("*")).alias("clipping_ratio"))
    bad = {"too_short": F.col("duration") < 0.6, "too_quiet": F.col("rms_db") < -35, "mostly_silent": F.col("silence_ratio") > 0.85, "clipped": F.col("clipping_ratio") > 0.08}
    reasons = F.array_compact(F.array(*(F.when(c, k) for k, c in bad.items())))
    return q.withColumns({"passed": F.size(reasons) == 0, "reasons": F.array_join(reasons, ",")})
