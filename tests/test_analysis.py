"""Requests end as verdicts or named errors; the twelve values and distances against a plain loop."""

import math

import numpy as np
import pytest

from soripark import tables as t
from soripark.operators import analysis, prosody

MODEL = "text string, eojeol_idx int, eojeol string, mean array<double>, std array<double>, cov_inv array<double>, mode string, n int, syllable_contours array<array<double>>"


def plain_vector(frames, t0, t1, syllables):
    inside = [f for f in frames if t0 <= f[1] < t1]
    voiced = [(i / max(len(inside) - 1, 1), f[2]) for i, f in enumerate(inside) if f[3]]
    z = [v for _, v in voiced]
    durations = [b - a for a, b in syllables]
    ratio = durations[-1] / (sum(durations) / len(durations)) if len(durations) >= 2 else 1.0
    tail = [t1 - t0, float(len(durations)), ratio, len(voiced) / len(inside) if inside else 0.0]
    if len(z) < 2:
        return [0.0, 0.0, 0.0, 0.0, 0.5, 0.5, 0.0, 0.0, *tail]
    slope = np.polyfit(*zip(*voiced), 1)[0] if len(z) >= 3 else z[-1] - z[0]
    return [np.mean(z), np.std(z), slope, max(z) - min(z), voiced[int(np.argmax(z))][0], voiced[int(np.argmin(z))][0], z[0], z[-1], *tail]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(6)
    requests = [(1, "가나 다"), (2, "가나 다"), (3, "없는 말"), (4, "가나! 다"), (5, "가나 다"), (6, "나 너"), (7, "가나 다"), (8, "")]
    times = {1: [0, 0.1, 0.2, 0.3, 0.5, 0.6, 0.8], 2: [0, 0.1, 0.2, 0.3, 0.5, 0.6], 3: [0, 1, 2], 4: [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 6: [0, 0.1, 0.2, 0.3, 0.4], 7: [0, 0.1, 0.2, 0.3, 0.5, 3.0, 3.1]}
    segments = [(u, i, float(a), float(b)) for u, ts in times.items() for i, (a, b) in enumerate(zip(ts, ts[1:]))]
    frames = [(u, i, i * 0.005, float(rng.normal()), bool(rng.random() < 0.7)) for u in times for i in range(170)]
    frames = [(u, i, at, f if v else 0.0, v) for u, i, at, f, v in frames]
    one, contour = [1.0] * 12, [[0.0] * 50]
    models = [("가나 다", j, w, [0.1 * j] * 12, one, None, "diagonal", 5, contour) for j, w in enumerate(["가나", "다"])]
    models += [("가나! 다", j, w, [0.0] * 12, one, None, "diagonal", 5, contour) for j, w in enumerate(["가나!", "다"])]
    models += [("나 너", j, w, [0.0] * 12, one, None, "diagonal", 5, contour) for j, w in enumerate(["나", "넌"])]
    make = spark.createDataFrame
    out = analysis.analyze(
        make(requests, "utt_id int, text string"), make(segments, "utt_id int, seg_idx int, start_time double, end_time double").repartition(3),
        make(frames, "utt_id int, frame_idx int, t double, f0 double, voiced boolean"), make(models, MODEL), inside=2.5)
    return out, times, frames


def test_every_request_has_one_outcome(world):
    got = {r.utt_id: (r.error, r.n_words, r.verdict is not None) for r in world[0].outcomes.collect()}
    done = (None, 2, True)
    assert got == {
        1: done, 2: (analysis.TOKEN_COUNT, None, False), 3: (analysis.UNKNOWN_TEXT, None, False), 4: done, 5: (analysis.TOKEN_COUNT, None, False),
        6: (analysis.SYLLABLES, None, False), 7: done, 8: (analysis.UNKNOWN_TEXT, None, False)}


def test_vectors_and_distances_equal_a_plain_loop(world):
    out, times, frames = world
    rows = {(r.utt_id, r.eojeol_idx): r for r in out.words.collect()}
    assert set(rows) == {(u, j) for u in (1, 4, 7) for j in (0, 1)}
    for (u, j), r in rows.items():
        ts = times[u]
        spans = [[(ts[0], ts[2]), (ts[2], ts[4])], [(ts[4], ts[6])]][j]
        want = plain_vector([f[1:] for f in frames if f[0] == u], spans[0][0], spans[-1][1], spans)
        assert r.v == pytest.approx(want, abs=1e-9)
        assert r.distance == pytest.approx(math.dist(want, [0.0 if u == 4 else 0.1 * j] * 12)) and r.inside == (r.distance <= 2.5)
    assert rows[7, 1].v[t.DIMS.index("duration")] == pytest.approx(2.6)
    mean = {u: np.mean([r.distance for k, r in rows.items() if k[0] == u]) for u in (1, 4, 7)}
    for r in out.outcomes.where("error is null").collect():
        assert r.avg_distance == pytest.approx(mean[r.utt_id]) and r.verdict == ("natural" if mean[r.utt_id] < 1.5 else "borderline" if mean[r.utt_id] < 2.5 else "unnatural")


def test_only_words_that_stand_out_are_looked_into(world):
    out, _, frames = world
    far = {(r.utt_id, r.eojeol_idx) for r in out.words.collect() if not r.inside}
    rows = out.syllables.collect()
    assert {(r.utt_id, r.eojeol_idx) for r in rows} == far and far
    for r in rows:
        assert (r.rmse is None) == (r.syl_idx > 0)  # the models hold one syllable's contour
        if r.rmse is not None:
            assert r.rmse == pytest.approx(math.sqrt(sum(x * x for x in r.contour) / 50))


def test_a_word_without_frames_and_a_key_without_voice(spark):
    frames = spark.createDataFrame([], "k int, pos int, total int, f0 double, voiced boolean")
    words = spark.createDataFrame([(1, 0.5, 0.75)], "k int, t0 double, t1 double")
    syllables = spark.createDataFrame([(1, 0, 0.25)], "k int, idx int, duration double")
    v = prosody.word_vectors(frames, ["k"], syllables, words).select(prosody.as_array().alias("v")).first().v
    assert v == [0, 0, 0, 0, 0.5, 0.5, 0, 0, 0.25, 1, 1, 0]
    pairs = spark.createDataFrame([(1, 0, 1.0, 2.0, False)], "k int, x int, native double, learner double, voiced boolean")
    lengths = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.0, 1.0)], "k int, native_duration double, learner_duration double")
    got = {r.k: (r.duration_ratio, r.voiced_count, r.rmse, r.pearson) for r in prosody.contour_metrics(pairs, ["k"], lengths).collect()}
    assert got == {1: (2.0, 0, None, None), 2: (None, 0, None, None)}


def test_empty_tables(spark):
    make = lambda schema: spark.createDataFrame([], schema)
    out = analysis.analyze(make("utt_id int, text string"), make("utt_id int, seg_idx int, start_time double, end_time double"), make("utt_id int, frame_idx int, t double, f0 double, voiced boolean"), make(MODEL))
    assert out.outcomes.count() == out.words.count() == out.syllables.count() == 0
