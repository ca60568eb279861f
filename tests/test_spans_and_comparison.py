import datetime
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from soripark import kernels
from soripark import tables as t
from soripark.operators import alignment, comparison, distributions, frames, handoff, prosody, quality, spans
from soripark.sources import stores


def test_gap_evidence_and_pauses(spark):
    rows = [(1, 0, 0, 4), (1, 1, 8, 9), (1, 2, 10, 12), (1, 3, 15, 16), (2, 0, 0, 3)]
    segments = spark.createDataFrame(rows, "utt_id int, seg_idx int, frame_start int, frame_end int")
    marks = spark.createDataFrame([(1, i, 0.9 if i < 10 else 0.5, 0.1 if i % 2 else 0.8) for i in range(17)], "utt_id int, frame_idx int, blank_posterior double, confidence double")
    got = {r.next_idx: r for r in quality.gap_evidence(segments, marks).collect()}
    assert {k: (r.frame_count, r.pause_like) for k, r in got.items()} == {1: (3, True), 2: (0, False), 3: (2, False)}
    assert got[1].blank_mean == pytest.approx(0.9) and got[1].confidence_low_ratio == pytest.approx(2 / 3) and got[2].blank_mean is None and got[3].is_tail_gap
    assert quality.gap_evidence(segments.where("utt_id > 9"), marks).count() == 0


def timing(spark, rows):
    frame = spark.createDataFrame(rows, "utt_id int, seg_idx int, token string, start_time double, end_time double, confidence double")
    return frame.withColumns({"low_threshold": F.lit(0.20), "very_low_threshold": F.lit(0.05)})


def test_every_check_of_the_gate(spark):
    good = [(i, "a", i * 0.1, i * 0.1 + 0.1, 0.9) for i in range(6)]
    cases = {1: good, 2: [(*x[:4], 0.01 if i >= 4 else 0.9) for i, x in enumerate(good)], 3: [(*x[:2], x[2] + (2.0 if i >= 3 else 0), x[3] + (2.0 if i >= 3 else 0), 0.9) for i, x in enumerate(good)], 4: good[:1], 5: good}
    segments = timing(spark, [(u, *x) for u, xs in cases.items() for x in xs])
    figures = spark.createDataFrame([(1, 0.95, -0.1, 0.5), (2, 0.5, -2.0, 0.99), (3, 1.0, 0.0, 0.0), (4, 1.0, 0.0, 0.0), (5, 0.9, -1.5, 0.97)], "utt_id int, coverage double, normalized_log_prob double, blank_ratio double")
    pauses = spark.createDataFrame([(3, 3, True)], "utt_id int, next_idx int, pause_like boolean")
    summary = quality.timing_summary(segments, None, figures)
    got = {r.utt_id: (r.passed, r.reasons) for r in quality.alignment_gate(summary).collect()}
    assert got[1] == (True, "") and got[5] == (True, "") and got[4] == (True, "")
    assert got[2] == (False, "coverage,very_low_ratio,log_prob,blank_ratio,final_phones")
    assert got[3] == (False, "internal_gap")
    paused = {r.utt_id: r for r in quality.timing_summary(segments, pauses, figures).collect()}
    assert paused[3].pause_gap_count == 1 and paused[3].max_unexplained_internal_gap == 0 and paused[3].quality_level == "usable_with_warnings"


def test_soft_gates_and_usage(spark):
    rows = spark.createDataFrame([(1, True, 80.0, True), (2, False, 80.0, True), (3, None, 50.0, True), (4, None, 80.0, None), (5, True, 75.0, False)], "utt_id int, audio_passed boolean, coarse_score double, alignment_passed boolean")
    got = {r.utt_id: (r.coarse_passed, r.coarse_recovered, r.soft_accepted) for r in quality.soft_accept_gates(rows).collect()}
    assert got == {1: (True, False, False), 2: (True, False, True), 3: (True, True, False), 4: (True, False, True), 5: (True, False, True)}
    base = dict(quality_level="clean", warning_gap_count=0, large_gap_count=0, pause_gap_count=0, unexplained_large_gap_count=0, max_tail_gap=0.0, very_low_ratio=0.0, scope="none", evaluation_status="ready", gate_passed=True, audio_passed=None, coarse_passed=None, is_partial=False)
    cases = [{}, {"gate_passed": False}, {"is_partial": True}, {"coarse_passed": False}, {"quality_level": None}, {"evaluation_status": "retry"}, {"quality_level": "discardable", "max_tail_gap": 0.5}, {"quality_level": "usable_with_warnings", "very_low_ratio": 0.2, "scope": "mixed"}, {"quality_level": "minor_warnings"}]
    schema = "utt_id int, quality_level string, warning_gap_count int, large_gap_count int, pause_gap_count int, unexplained_large_gap_count int, max_tail_gap double, very_low_ratio double, scope string, evaluation_status string, gate_passed boolean, audio_passed boolean, coarse_passed boolean, is_partial boolean"
    frame = spark.createDataFrame([(i, *(base | c).values()) for i, c in enumerate(cases)], schema)
    used = [(r.recommended_usage, r.reasons, r.limited_by) for r in quality.prosody_usage(frame).orderBy("utt_id").collect()]
    assert used == [
        ("full", "", ""), ("limited", "alignment_gate_not_ready", "alignment_gate"), ("cautious", "partial_alignment_tail_excluded", "partial_tail"), ("cautious", "coarse_alignment_gate_failed,soft_accept_policy_applied", "coarse_alignment"),
        ("disabled", "forced_alignment_missing", ""), ("disabled", "evaluation_not_ready", ""), ("limited", "timing_quality_discardable,tail_gap_detected", "tail"),
        ("limited", "many_very_low_confidence_segments,confidence_limited_mixed", "confidence"), ("cautious", "minor_timing_warning", "")]


def test_tails(spark):
    targets = spark.createDataFrame([(1, list("abcd"), False), (2, list("abcd"), True), (3, ["a"], False), (4, ["a", "b"], False)], "utt_id int, labels array<string>, passed boolean")
    got = sorted((r.utt_id, r.trim, "".join(r.labels)) for r in quality.tail_attempts(targets).collect())
    assert got == [(1, 0, "abcd"), (1, 1, "abc"), (1, 2, "ab"), (2, 0, "abcd"), (3, 0, "a"), (4, 0, "ab"), (4, 1, "a")]
    columns = "utt_id int, trim int, passed boolean, quality_level string, coverage double, failure_gap_count int, warning_gap_count int, large_gap_count int, very_low_ratio double, low_ratio double, max_tail_gap double, max_unexplained_internal_gap double, max_internal_gap double, avg_confidence double, normalized_log_prob double"
    row = lambda u, trim, passed, level, conf: (u, trim, passed, level, 1.0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, conf, -1.0)
    attempts = [row(1, 0, False, "clean", 0.9), row(1, 1, True, "minor_warnings", 0.5), row(1, 2, True, "clean", 0.4), row(2, 0, False, "clean", 0.9), row(2, 1, False, "clean", 0.9), row(3, 0, False, "discardable", 0.1), row(3, 1, True, "clean", 0.5), row(3, 2, True, "clean", 0.9)]
    chosen = {r.utt_id: r.trim for r in quality.select_attempt(spark.createDataFrame(attempts, columns)).collect()}
    assert chosen == {1: 2, 2: 0, 3: 1}
    out = quality.excluded_tail(spark.createDataFrame([(1, ["a", "b", "c"], 2), (2, ["a"], 1)], "utt_id int, tokens array<string>, aligned_count int")).orderBy("utt_id", "index").collect()
    assert [(r.utt_id, r.is_excluded, r.reason is not None, r.alignment_is_partial) for r in out] == [(1, False, False, True), (1, False, False, True), (1, True, True, True), (2, False, False, False)]


def test_segment_boundaries_one_after_another(spark):
    """Against a version that narrows the boundaries pair by pair."""
    rng = random.Random(4)
    rows, want = [], {}
    for u in range(40):
        n, at, ranges = 120, 0, []
        for _ in range(rng.randint(0, 6)):
            first = at + rng.choice([0, 1, 3, 21, 26, 40])
            last = first + rng.randint(0, 5)
            if last >= n:
                break
            ranges.append((first, last) if rng.random() < 0.85 else None)
            at = last + 1
        rows += [(u, i, *(r or (None, None)), n) for i, r in enumerate(ranges)]
        present = [i for i, r in enumerate(ranges) if r]
        bounds = {i: [max(0, ranges[i][0] - 2), max(max(0, ranges[i][0] - 2) + 1, min(n, ranges[i][1] + 3))] for i in present}
        for a, b in zip(present, present[1:]):
            gap = ranges[b][0] - ranges[a][1] - 1
            left, right = (ranges[a][1] + 1 + gap // 2,) * 2 if gap <= 20 else (min(bounds[a][1], ranges[a][1] + 3), max(bounds[b][0], ranges[b][0] - 2))
            bounds[a][1], bounds[b][0] = max(bounds[a][0] + 1, left), min(right, bounds[b][1] - 1)
        want |= {(u, i): tuple(bounds[i]) if i in bounds else (None, None) for i in range(len(ranges))}
    got = frames.segment_boundaries(spark.createDataFrame(rows, "utt_id int, label_idx int, first int, last int, n_frames int")).collect()
    assert {(r.utt_id, r.label_idx): (r.start_frame, r.end_frame) for r in got} == want


def test_frame_boundaries(spark):
    rows = [([0.0, 1.0, 2.0, 3.0], 2), ([0.0, 1.0, 2.0], 3), ([0.5, 0.7], 4), ([0.5], 2), ([], 2), (None, 1), ([1.0], 0), ([3.0], 1)]
    got = [r.b for r in spark.createDataFrame(rows, "x array<double>, n int").select(frames.frame_boundaries(F.col("x"), F.col("n")).alias("b")).collect()]
    want = [[0, 1, 2], [0, 2 / 3, 4 / 3, 2], [0.5, 0.7, 0.9, 1.1, 1.3], [0.5, 0.52, 0.54], [0, 1, 2], [0, 1], [0], [3, 3.02]]
    assert all(a == pytest.approx(b) for a, b in zip(got, want)) and len(got) == len(want)


def test_weak_tokens_take_their_peak(spark):
    """A label of three frames with one clear frame: the mean, or the peak where its token is weak."""
    logits = [[6.0, 0.0], [0.0, 0.4], [0.0, 6.0], [0.0, 0.4], [6.0, 0.0]]
    em = spark.createDataFrame([(1, i, x) for i, x in enumerate(logits)], "utt_id long, frame_idx int, logits array<double>")
    labels = spark.createDataFrame([(1, [1])], "utt_id long, labels array<int>")
    plain, weak = (frames.force_align(em, labels, weak=w).first().segments[0] for w in ((), (1,)))
    assert plain.last - plain.first == 2 and weak.confidence > plain.confidence + 0.05


def test_frame_energy_rounds_half_to_even(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0]
    samples = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "utt_id int, idx long, x double")
    counts = spark.createDataFrame([(1, 2), (2, 3)], "utt_id int, frame_count int")
    got = {r.frame_idx: r.energy for r in frames.frame_energy(samples, counts).collect()}
    cut = round(5 / 2)
    assert got == pytest.approx({0: math.sqrt(np.mean(np.square(x[:cut]))), 1: math.sqrt(np.mean(np.square(x[cut:])))})


def test_syllables_words_and_hints(spark):
    positions = ["onset", "nucleus", "coda", "onset", "nucleus", "nucleus", "other", "onset", "onset"]
    segments = spark.createDataFrame([(1, i, float(i), i + 0.9) for i in range(9)] + [(2, 0, 0.0, 1.0)], "utt_id int, seg_idx int, start_time double, end_time double")
    marks = spark.createDataFrame([(1, i, p) for i, p in enumerate(positions)], "utt_id int, seg_idx int, position string")
    syllables = spans.syllable_spans(segments, marks)
    got = syllables.orderBy("utt_id", "syl_idx").collect()
    assert [(r.utt_id, r.syl_idx, r.t0, r.t1, r.error) for r in got] == [(1, 0, 0.0, 2.9, None), (1, 1, 3.0, 4.9, None), (1, 2, 5.0, 8.9, None), (2, None, None, None, "length mismatch")]
    texts = spark.createDataFrame([(1, " 가 12  나다라 "), (2, "가")], "utt_id int, text string")
    words = spans.word_spans(syllables, texts).orderBy("eojeol_idx").collect()
    assert [(r.eojeol_idx, r.t0, r.t1, r.label) for r in words] == [(0, 0.0, 2.9, "가"), (1, 3.0, 8.9, "12")]  # a word without letters has no span and shifts the labels
    windows = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 0.0, 9.0), (1, 2, 4.5, 5.0), (1, 3, 20.0, 21.0)], "utt_id int, k int, w0 double, w1 double")
    named = syllables.where("error is null").select("utt_id", F.col("syl_idx").alias("pos"), "t0", "t1", F.element_at(F.array(*map(F.lit, "가나다")), F.col("syl_idx") + 1).alias("label"))
    hints = {r.k: r.hint for r in spans.syllable_hints(windows, named, ["utt_id", "k"]).collect()}
    assert hints == {0: "첫 음절 (가)", 1: "첫 음절~마지막 음절 (가나다)", 2: None, 3: None}


def savgol(values, window=11):
    n = len(values)
    if n < 3:
        return [0.0] * n
    w = min(window, n if n % 2 else n - 1)
    h, out = w // 2, []
    for i in range(n):
        c = min(max(i, h), n - 1 - h)
        fit = np.polyfit(np.arange(c - h, c + h + 1) - c, values[c - h : c + h + 1], 2)
        out.append(2 * fit[0] * (i - c) + fit[1])
    return out


def test_delta_equals_polynomial_fits(spark):
    rng = random.Random(2)
    rows = [(n, [rng.uniform(-2, 2) for _ in range(n)]) for n in (0, 1, 2, 3, 4, 5, 10, 11, 12, 40)]
    got = {r.n: r.d for r in spark.createDataFrame(rows, "n int, v array<double>").select("n", comparison.delta(F.col("v")).alias("d")).collect()}
    assert all(got[n] == pytest.approx(savgol(v), abs=1e-9) for n, v in rows)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(7)
    make = lambda n: [(i, i * 0.01, math.sin(i / 5) + rng.uniform(-0.2, 0.2), i % 7 != 3) for i in range(n)]
    schema = "utt_id int, idx int, t double, v double, voiced boolean"
    data = {u: (make(a), make(b)) for u, a, b in ((1, 60, 45), (2, 8, 30), (3, 2, 5))}
    frame = lambda k: spark.createDataFrame([(u, *x) for u, s in data.items() for x in s[k]], schema)
    return data, frame(0), frame(1)


def test_paths_and_lens(spark, sides):
    data, native, learner = sides
    paths = comparison.dtw_paths(native, learner, ["utt_id"], 3)
    got = {}
    for r in paths.orderBy("utt_id", "step").collect():
        got.setdefault(r.utt_id, []).append((r.n_idx, r.l_idx))
    plain = {u: kernels.dtw_path(np.array([x[2] for x in a]), np.array([x[2] for x in b])) for u, (a, b) in data.items() if min(len(a), len(b)) >= 3}
    assert got == plain
    warped = comparison.warped(paths, native, learner, ["utt_id"])
    by_step = {(r.utt_id, r.step): r for r in warped.collect()}
    for u, path in plain.items():
        for step, (n, l) in enumerate(path):
            r = by_step[u, step]
            assert (r.native, r.learner, r.voiced) == (data[u][0][n][2], data[u][1][l][2], data[u][0][n][3] and data[u][1][l][3])
    even = comparison.evenly_paired(native, learner, ["utt_id"], 50)
    r = even.where("utt_id = 1 and step = 10").first()
    assert r.native == pytest.approx(np.interp(10 * 59 / 49, range(60), [x[2] for x in data[1][0]]))
    view = comparison.lens_view(even, prosody.contour_metrics(even.withColumn("x", F.col("step")), ["utt_id"]), ["utt_id"], []).orderBy("utt_id").collect()
    assert [(r.start_idx, r.end_idx) for r in view] == [(0, 50), (50, 100), (100, 150)]


def test_shape_windows_equal_plain_loops(spark, sides):
    data, native, learner = sides
    paths = comparison.dtw_paths(native, learner, ["utt_id"], 3)
    whole = learner.groupBy("utt_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    rows = comparison.shape_windows(paths, native, learner, whole, ["utt_id"])
    want = {}
    for u, (a, b) in data.items():
        if min(len(a), len(b)) < 3:
            continue
        path, t0, dur = kernels.dtw_path(np.array([x[2] for x in a]), np.array([x[2] for x in b])), b[0][1], b[-1][1] - b[0][1]
        for k in range(19):
            w0 = t0 + k * (0.05 * dur)
            w1 = w0 + 0.1 * dur
            inside = [x[0] for x in b if w0 <= x[1] < w1]
            mapped = [n for n, l in path if inside and inside[0] <= l <= inside[-1]]
            lv = [x[2] for x in b if x[0] in inside and x[3]]
            nv = [x[2] for x in a if mapped and min(mapped) <= x[0] <= max(mapped) and x[3]]
            if lv and nv:
                want[u, k] = np.mean(lv) - np.mean(nv)
    assert {(r.utt_id, r.k): r.diff for r in rows.collect()} == pytest.approx(want)
    records = comparison.shape_records(rows, ["utt_id"]).collect()
    for r in records:
        sign = 1 if r.rule_label == "pitch_rising_excess" else -1
        hit = {k: d for (u, k), d in want.items() if u == r.utt_id and sign * d > 0.1}
        assert [w.k for w in r.windows] == sorted(hit) and r.value == pytest.approx(max(map(abs, hit.values()))) and r.severity == ("major" if r.value >= 0.2 else "minor")
    assert records


def test_buckets_and_sentences(spark):
    w = lambda *starts: [(i, s, s + 0.1, 0.5) for i, s in enumerate(starts)]
    rows = [
        (1, 0, "pitch_rising_excess", "minor", 0.12, "가나", w(0.0, 0.1, 0.5), None), (1, 1, "pitch_falling_excess", "major", 0.3, "다", w(0.0, 0.9), None), (1, 2, "pitch_offset", "major", -2.0, "라", None, None),
        (1, 3, "syllable_elongation", "minor", 2.6, "마바", None, "바"), (1, 4, "eojeol_slow", "minor", 0.2, "사", None, None)]
    schema = "utt_id int, eojeol_idx int, rule_label string, severity string, value double, eojeol_label string, windows array<struct<k: int, ratio_start: double, ratio_end: double, delta_diff: double>>, syllable_label string"
    payload = {r.utt_id: r for r in comparison.prosody_payload(spark.range(1, 3).select(F.col("id").cast("int").alias("utt_id")), spark.createDataFrame(rows, schema)).collect()}
    assert payload[1].feedback == [
        "'다' 어절 전반에서 음이 너무 떨어졌어요. 확실히 더 평평하게 말해봐요.", "'라' 어절 전체 음높이가 너무 낮아요. 확실히 높게 말해봐요.", "'가나' 어절의 초반에서 음이 조금 올라갔어요. 조금만 더 평평하게 말해봐요.",
        "'마바' 어절의 '바' 음절을 조금 길게 발음했어요. 짧게 말해봐요.", "'사' 어절 전체를 조금 빠르게 발화했어요. 천천히 말해봐요."]
    assert payload[1].summary_when_no_outlier is None and payload[2].feedback == [] and payload[2].summary_when_no_outlier == comparison.PRAISE


def test_plot_boundaries(spark):
    paths = spark.createDataFrame([(1, s, s, s) for s in range(5)], "utt_id int, step int, n_idx int, l_idx int")
    side = spark.createDataFrame([(1, i, i * 0.1, float(i)) for i in range(5)], "utt_id int, idx int, t double, f0 double")
    series = comparison.plot_series(paths, side, side)
    words = spark.createDataFrame([(1, 0, 0.0, "a"), (1, 1, 0.15, "b"), (1, 2, 9.0, "c")], "utt_id int, eojeol_idx int, t0 double, label string")
    got = comparison.word_boundaries(series, words).orderBy("eojeol_idx").collect()
    assert [(r.path_step, r.label) for r in got] == [(0, "a"), (2, "b"), (4, "c"), (4, None)]


def test_made_up_faults_get_their_labels(spark):
    """A moved vector is classified as the fault it was moved to."""
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(0, i, rng.normal(0, 1, 12).tolist()) for i in range(40)], "eojeol_idx int, utt_id int, v array<double>")
    models = distributions.moments(vectors, ["eojeol_idx"]).withColumns({"mode": F.lit("diagonal"), "cov_inv": F.lit(None).cast("array<double>")})
    cases = comparison.labelled_cases(models, ["eojeol_idx"], 5).withColumn("utt_id", F.monotonically_increasing_id())
    scored = distributions.scored(cases.select("eojeol_idx", "utt_id", "v"), models, ["eojeol_idx"]).join(cases.select("utt_id", "expected_label", "kind"), "utt_id").collect()
    assert len(scored) == 25 and {r.kind for r in scored} == set(t.PERTURBATIONS) and all(r.expected_label in r.classes for r in scored)
    few = distributions.quality(spark.createDataFrame([(1, 11), (2, 12)], "eojeol_idx int, n int"), ["eojeol_idx"]).orderBy("eojeol_idx").collect()
    assert [(r.mode, r.warning is None) for r in few] == [("diagonal", False), ("full", True)]


def test_made_up_cases_do_not_depend_on_partitions(spark):
    models = spark.createDataFrame([(k, [float(i) for i in range(12)], [1.0 + k] * 12) for k in range(6)], "eojeol_idx int, mean array<double>, std array<double>")
    key = lambda rows: sorted((r.eojeol_idx, r.case, r.kind, tuple(r.v)) for r in rows.collect())
    one, seven = (key(comparison.labelled_cases(models.repartition(n), ["eojeol_idx"], 8)) for n in (1, 7))
    assert one == seven and len(one) == 6 * 8 * 5
    other = key(comparison.labelled_cases(models, ["eojeol_idx"], 8, seed=1))
    assert other != one
    z = [(x - i) / (1 + k) / 0.3 for k, _, kind, v in one if kind == "slow" for i, x in enumerate(v) if i != t.DIMS.index("duration")]
    assert len(set(z)) == len(z) == 528 and abs(np.mean(z)) < 0.15 and 0.85 < np.std(z) < 1.15


def test_routing(spark):
    e = spark.createDataFrame([(1, "ready"), (2, "retry"), (3, None)], "utt_id int, evaluation_status string")
    p = spark.createDataFrame([(1, "x"), (2, "y")], "utt_id int, result string")
    got = {r.utt_id: (r.prosody_executed, r.reason, r.result) for r in comparison.routed(e, p).collect()}
    assert got == {1: (True, "ready", "x"), 2: (False, "retry", None), 3: (False, "discarded", None)}


def test_rule_config(tmp_path):
    assert prosody.load_rule_config() == {"thresholds": t.RULES, "window": t.WINDOW}
    (tmp_path / "r.toml").write_text("[thresholds]\npitch_offset = 1.5\n[window]\nsize_ratio = 0.2\n")
    read = prosody.load_rule_config(str(tmp_path / "r.toml"))
    assert read["thresholds"]["pitch_offset"] == 1.5 and read["window"] == t.WINDOW | {"size_ratio": 0.2}
    (tmp_path / "bad.toml").write_text("[thresholds]\nother = 1\n")
    with pytest.raises(ValueError):
        prosody.load_rule_config(str(tmp_path / "bad.toml"))


def test_token_comparison_equals_difflib(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for i in range(60)] + [(60, None, ["a"]), (61, [], [])]
    frame = spark.createDataFrame(rows, "id int, target array<string>, user array<string>")
    got = {r.id: r for r in handoff.compare_tokens(frame).withColumn("s", handoff.op_summary(F.col("compared.details"))).withColumn("lines", handoff.diff_lines(F.col("compared.details"))).withColumn("text", handoff.diff_feedback(F.col("compared.details"), F.col("compared.score"))).collect()}
    assert len(got) == 62
    for i, a, b in rows:
        m = SequenceMatcher(a=a or [], b=b or [])
        codes = m.get_opcodes()
        assert got[i].compared.score == round(m.ratio() * 100, 2)
        assert got[i].lines == "\n".join(f"[{tag}] target: {' '.join((a or [])[i1:i2]) or '∅'} | user: {' '.join((b or [])[j1:j2]) or '∅'}" for tag, i1, i2, j1, j2 in codes)
        for kind in ("equal", "replace", "delete", "insert"):
            assert got[i].s[kind] == sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in codes if tag == kind)
        assert got[i].text.endswith(handoff.DIFF_NOTE) and ("누락 구간" in got[i].text) == any(c[0] == "delete" for c in codes)


def test_rows_and_tips_of_an_alignment(spark):
    tok = "array<struct<symbol: string, category: string, position: string>>"
    rows = [(1, [("k", "consonant", "onset"), ("a", "vowel", "nucleus")], [("kʰ", "consonant", "onset"), ("a", "vowel", "nucleus"), ("m", "consonant", "coda")]), (2, [], [])]
    df = alignment.align(spark.createDataFrame(rows, f"id int, ref {tok}, hyp {tok}"))
    df = df.withColumns({"s": alignment.breakdown(F.col("alignment")), "i": alignment.issues(F.col("alignment"))}).withColumn("report", alignment.feedback(F.col("i"), F.col("s.overall")))
    every = handoff.alignment_rows(df, ["id"]).orderBy("number").collect()
    assert [(r.number, r.ref, r.hyp, r.op) for r in every] == [(1, "k", "kʰ", "substitute"), (2, "a", "a", "match"), (3, "∅", "m", "insert")]
    assert [(r.ref, r.hyp) for r in handoff.mismatch_rows(df, ["id"]).orderBy("i").collect()] == [("k", "kʰ"), ("∅", "m")]
    tips = {r.id: r.t for r in df.select("id", handoff.feedback_report(F.col("report")).alias("t")).collect()}
    assert tips[2].tips == [handoff.DEFAULT_TIP] and tips[2].headline == handoff.HEADLINES["excellent"]
    assert any("기준 k / 사용자 kʰ." in x and "러시아어권" in x for x in tips[1].tips) and any(x.startswith(handoff.MESSAGES["consonant_insertion"][0]) for x in tips[1].tips)


def test_records_are_written_and_read(spark, tmp_path):
    when = datetime.datetime(2024, 5, 1, 10)
    judged = spark.createDataFrame([(1, "ready", True, 80.0, None, True, True, True, None, "text", when), (2, "retry", None, None, None, None, False, False, None, "text", when)], "utt_id long, evaluation_status string, audio_passed boolean, coarse_score double, coarse_passed boolean, alignment_passed boolean, has_forced boolean, has_score boolean, score_is_final boolean, reference_text string, created_at timestamp")
    segments = spark.createDataFrame([(1, 0, "a", "A", 0.0, 0.5, 0, 24, 0.9), (1, 1, "n", "N", 0.5, 0.4, 25, 26, 0.5)], "utt_id long, seg_idx int, token string, label string, start_time double, end_time double, frame_start int, frame_end int, confidence double")
    records = handoff.evaluation_records(judged, segments)
    one = {r.utt_id: r for r in records.collect()}
    assert one[1].llm_feedback_input.score_is_final and one[1].prosody_input.phoneme_segments[1].duration == 0 and one[1].gates.coarse_token_alignment_gate.passed
    assert not one[2].llm_feedback_input.score_is_final and not one[2].gates.audio_quality_gate.performed and one[2].alignment.forced.segments is None
    stores.write_artifacts(records, str(tmp_path / "out"), "day")
    back = stores.read_artifacts(spark, str(tmp_path / "out"), lines=True).collect()
    assert sorted(r.status.evaluation_status for r in back) == ["ready", "retry"]
    ready = next(r for r in back if r.status.evaluation_status == "ready")
    assert [s.token for s in ready.alignment.forced.segments] == ["a", "n"] and ready.gates.alignment_confidence_gate.passed


def test_cmvn(spark):
    frame = spark.createDataFrame([(1, 0, [1.0, 5.0]), (1, 1, [3.0, 5.0]), (2, 0, [7.0, 1.0])], "utt_id int, frame_idx int, c array<double>")
    got = {(r.utt_id, r.frame_idx): r.c for r in comparison.cmvn(frame, 2).collect()}
    assert got == {(1, 0): [-1.0, 0.0], (1, 1): [1.0, 0.0], (2, 0): [0.0, 0.0]}
