"""Running sums over ranges, pauses cut out and mapped back, tails from one trellis; each against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_kernels as plain
from soripark.operators import calibration, frames, quality, ranges


def test_range_sums_equal_plain_loops(spark):
    rng = random.Random(2)
    points = [(u, rng.choice([0, 1, 2, 2, 3, 5, 8, 13]) / 2, rng.choice([None, 1, 2, 3]), rng.random()) for u in range(6) for _ in range(rng.randint(0, 12))]
    asked = [(u, k, rng.randint(-1, 8) / 2, rng.choice([None, rng.randint(-1, 9) / 2, 50.0])) for u in range(7) for k in range(9)]
    got = ranges.range_sums(
        spark.createDataFrame(points, "u int, at double, n int, x double").repartition(3), spark.createDataFrame(asked, "u int, k int, low double, high double"), ["u"], "at", ["k"], {"n": F.col("n").cast("long"), "x": F.col("x")})
    want = {}
    for u, k, low, high in asked:
        if high is not None:
            inside = [p for p in points if p[0] == u and low <= p[1] < high]
            want[u, k] = (sum(p[0] == u and p[1] < low for p in points), len(inside), sum(p[2] or 0 for p in inside), sum(p[3] for p in inside))
    got = {(r.u, r.k): (r.n_before, r.n_points, r.n, r.x) for r in got.collect()}
    assert set(got) == set(want)
    assert all(got[k][:3] == want[k][:3] and abs(got[k][3] - want[k][3]) < 1e-9 for k in want)


def test_span_means(spark):
    points = spark.createDataFrame([(1, 0.0, 2.0, True), (1, 0.1, 9.0, False), (1, 0.2, 4.0, True)], "u int, t double, v double, voiced boolean")
    spans = spark.createDataFrame([(1, 0, 0.0, 0.3), (1, 1, 0.05, 0.15), (1, 2, 5.0, 4.0), (2, 0, 0.0, 1.0)], "u int, k int, t0 double, t1 double")
    got = {(r.u, r.k): (r.n_points, r.n, r["mean"]) for r in ranges.span_means(points, spans, ["u"], "t", ["k"], "v", "voiced").collect()}
    assert got == {(1, 0): (3, 2, 3.0), (1, 1): (1, 0, None), (1, 2): (0, 0, None), (2, 0): (0, 0, None)}


def spoken(seed, n=70, width=6):
    """Logits with long blanks, short blanks and labels; and energies."""
    rng = np.random.default_rng(seed)
    best, out = 0, []
    while len(out) < n:
        best = 0 if rng.random() < 0.5 else int(rng.integers(1, width))
        for _ in range(int(rng.choice([1, 2, 7, 8, 9, 15])) if best == 0 else int(rng.integers(1, 4))):
            logits = rng.normal(0, 0.5, width)
            logits[best] += 6
            out.append((logits, float(rng.choice([0.0, 0.004, 0.02])) if best == 0 else float(rng.uniform(0.1, 1))))
    return out[:n]


def plain_chain(rows, labels, blank=0):
    """The steps one after another: mask, cut, align, map back."""
    logits = np.array([x for x, _ in rows])
    lp = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    energy = np.array([e for _, e in rows])
    loud = energy[energy > 0]
    limit = max(0.01, 0.15 * float(np.percentile(loud, 95))) if len(loud) else 0.01
    pause = (np.exp(lp[:, blank]) >= 0.85) & (np.exp(lp.max(1)) >= 0.70) & (energy <= limit)
    keep, i = np.ones(len(rows), bool), 0
    while i < len(rows):
        j = i
        while j < len(rows) and pause[j]:
            j += 1
        if j - i >= 8:
            keep[i + 2 : j - 2] = False
        i = max(j, i + 1)
    at = np.flatnonzero(keep)
    if len(at) < max(1, len(labels)):
        at = np.arange(len(rows))
    path, score = plain.ctc_viterbi(lp[at], np.array(labels), blank)
    table = plain.ctc_posteriors(lp[at], np.array(labels), blank)
    out = []
    for k, label in enumerate(labels):
        own = np.flatnonzero(path == 2 * k + 1)
        near = np.sort(table[max(0, own[0] - 2) : own[-1] + 3, 2 * k + 1])[::-1]
        mean, best = float(np.exp(lp[at][own, label]).mean()), float(near[:3].mean())
        value = max(mean, best, 0.85 * near[0]) if len(own) <= 2 else max(mean, 0.75 * mean + 0.25 * best)
        out.append((label, int(at[own[0]]), int(at[own[-1]]), min(1.0, value)))
    return len(at), score, out


def tables(spark, utterances):
    em = [(u, i, [float(v) for v in x], e) for u, (rows, _) in utterances.items() for i, (x, e) in enumerate(rows)]
    return spark.createDataFrame(em, "utt_id long, frame_idx int, logits array<double>, energy double"), spark.createDataFrame([(u, labels) for u, (_, labels) in utterances.items()], "utt_id long, labels array<int>")


def reading(rows):
    best = [int(np.argmax(x)) for x, _ in rows]
    return [b for a, b in zip([None, *best], best) if b != a and b]


@pytest.fixture(scope="module")
def utterances():
    out = {}
    for u in range(8):
        rows = spoken(u)
        out[u] = (rows, reading(rows) + ([5, 1] if u % 2 else []))
    long_pause = [(np.array([8.0, 0, 0, 0, 0, 0]), 0.0)] * 12
    out[8] = (long_pause, [1, 2, 3, 4, 5, 1])  # five frames would be left: the undo rule
    out[9] = (long_pause, [1, 2])
    return out


def test_pauses_are_cut_and_frames_mapped_back(spark, utterances):
    em, targets = tables(spark, utterances)
    got = {r.utt_id: r for r in frames.align_without_pauses(em.repartition(5), targets).collect()}
    cut = 0
    for u, (rows, labels) in utterances.items():
        n, score, segments = plain_chain(rows, labels)
        cut += n < len(rows)
        assert got[u].error is None and got[u].frames == n and got[u].log_prob == pytest.approx(score, abs=1e-4)
        assert [(s.label, s.first, s.last) for s in got[u].segments] == [s[:3] for s in segments]
        assert [s.confidence for s in got[u].segments] == pytest.approx([s[3] for s in segments], abs=1e-6)
    assert cut >= 6 and got[8].frames == 12 and got[9].frames == 4


def test_tails_equal_separate_alignments(spark, utterances):
    em, targets = tables(spark, utterances)
    got = {(r.utt_id, r.trim): r for r in frames.align_tails(em, targets).collect()}
    assert {u for u, _ in got} == set(utterances)
    for trim in (0, 1, 2):
        cut = targets.where(F.size("labels") > trim).withColumn("labels", F.slice("labels", 1, F.size("labels") - trim))
        for r in frames.force_align(em, cut).collect():
            mine = got[r.utt_id, trim].asDict()
            assert mine.pop("trim") == trim and mine == r.asDict()
    assert max(t for _, t in got) == 2


def test_bad_input_is_a_named_error(spark):
    em = spark.createDataFrame([(u, i, [0.0, 1.0, 2.0]) for u in range(1, 6) for i in range(2)], "utt_id long, frame_idx int, logits array<double>")
    targets = spark.createDataFrame([(1, []), (2, [1, 0]), (3, [1, 3]), (4, [1, 2, 1]), (5, [1, 1]), (6, [1])], "utt_id long, labels array<int>")
    got = {r.utt_id: r.error for r in frames.align_tails(em, targets).where("trim = 0").collect()}
    assert got == {1: "no labels", 2: "blank label", 3: "unknown label", 4: "too few frames", 5: "no path", 6: "no frames"}


def test_the_retry_goes_by_the_whole_gate(spark, utterances):
    em, targets = tables(spark, utterances)
    aligned = frames.align_without_pauses(em, targets, most=2).cache()
    n = em.groupBy("utt_id").agg(F.count("*").cast("int").alias("n_frames")).withColumn("timestamps", F.transform(F.sequence(F.lit(0), F.col("n_frames")), lambda i: i * F.lit(0.02)))
    segments = calibration.with_thresholds(frames.forced_segments(aligned, n).withColumn("token", F.col("label").cast("string")), None).cache()
    scored = frames.frame_scores(em)
    attempts = quality.judged_attempts(segments, scored, aligned).cache()
    for trim in (0, 1, 2):  # each attempt as an utterance of its own
        of = lambda df: df.where(F.col("trim") == trim).drop("trim")
        alone = quality.timing_summary(of(segments), quality.gap_evidence(of(segments), scored), of(aligned))
        gate = {r.utt_id: (r.passed, r.reasons) for r in quality.alignment_gate(alone).collect()}
        assert gate == {r.utt_id: (r.passed, r.reasons) for r in attempts.where(F.col("trim") == trim).collect()}
    passed = {(r.utt_id, r.trim): r.passed for r in attempts.collect()}
    chosen = {r.utt_id: r.trim for r in quality.retried(attempts).collect()}
    assert set(chosen) == set(utterances)
    for u, trim in chosen.items():
        tails = [k for k in (1, 2) if passed.get((u, k))]
        assert (trim == 0) if passed[u, 0] or not tails else trim in tails
    assert any(chosen.values())


def test_segments_lie_in_the_frames_of_the_utterance(spark, utterances):
    em, targets = tables(spark, utterances)
    n = spark.createDataFrame([(u, len(rows), [0.02 * i for i in range(len(rows) + 1)]) for u, (rows, _) in utterances.items()], "utt_id long, n_frames int, timestamps array<double>")
    rows = frames.forced_segments(frames.align_without_pauses(em, targets).withColumn("trim", F.lit(0)), n).collect()
    assert len(rows) == sum(len(labels) for _, labels in utterances.values())
    for r in rows:
        size = len(utterances[r.utt_id][0])
        assert 0 <= r.frame_start <= r.frame_end < size and r.start_time == pytest.approx(0.02 * r.frame_start) and r.end_time == pytest.approx(0.02 * (r.frame_end + 1))
