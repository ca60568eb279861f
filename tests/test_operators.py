
import numpy as np
import pytest
from pyspark.sql import functions as F

from soripark import kernels
from soripark import tables as t
from soripark.functions import hangul as h
import plain_kernels
from soripark.operators import alignment, calibration, catalogue, distributions, frames, prosody, quality


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# text


def test_every_syllable_comes_back(spark):
    rows = spark.range(0xAC00, 0xD7A4).select(h.compose(F.floor((F.col("id") - h.FIRST) / 588), F.floor((F.col("id") - h.FIRST) % 588 / 28), (F.col("id") - h.FIRST) % 28).alias("s"), "id")
    assert all(ord(r.s) == r.id for r in rows.collect())


@pytest.mark.parametrize("digits,words", [("0", "영"), ("00", "영"), ("007", "영영칠"), ("1", "일"), ("10", "십"), ("11", "십일"), ("10000", "일만"), ("110000", "십일만"), ("20305", "이만삼백오"), ("100000000", "일억"), ("1234567890123456", "천이백삼십사조오천육백칠십팔억구천십이만삼천사백오십육"), ("12345678901234567", "일이삼사오육칠팔구영일이삼사오육칠")])
def test_numerals(spark, digits, words):
    assert one(spark, h.numeral(F.lit(digits))) == words


@pytest.mark.parametrize("text,standard,linked", [
    ("같이", "가치", "가치"), ("놓고", "노코", "노코"), ("국물", "궁물", "궁물"), ("신라", "실라", "실라"), ("닭고기", "달꼬기", "달꼬기"), ("옷이", "옷이", "오시"), ("밥 을", "밥 을", "바 블"), ("않고", "안코", "안코"), ("학교", "학꾜", "학꾜"), ("밥, 물", "밤, 물", "밤, 물"),
])
def test_sound_changes(spark, text, standard, linked):
    assert one(spark, h.pronounce(F.lit(text), False)) == standard
    assert one(spark, h.pronounce(F.lit(text), True)) == linked


def test_candidates_in_order_without_repeats(spark):
    got = one(spark, h.candidates(F.lit("옷이")))
    assert [(c.rank, c.pronunciation, c.is_primary) for c in got] == [(0, "옷이", True), (1, "오시", False)]
    assert one(spark, h.candidates(F.lit(" "))) is None


def test_normal_text_and_hours(spark):
    assert one(spark, h.normalize(F.lit("  3시  13시\t12개 "))) == "세시 십삼시 십이개"
    assert one(spark, h.normalize(F.lit("가 12345678901234567 나"))) == "가 일이삼사오육칠팔구영일이삼사오육칠 나"


def test_ipa_positions_and_quirks(spark):
    tokens = lambda s: [(x.symbol, x.position) for x in one(spark, h.positioned_tokens(h.ipa_symbols(F.lit(s))))]
    assert tokens("신") == [("ɕ", "onset"), ("i", "nucleus"), ("n", "coda")]
    assert tokens("야") == [("j", "onset"), ("a", "nucleus")]  # one symbol has no space and is split
    assert tokens("신!") == [("ɕ", "onset"), ("i", "nucleus"), ("n", "onset")]  # punctuation: positions are guessed
    assert one(spark, h.positioned_tokens(h.ipa_symbols(F.lit("")))) == []


def test_labels_both_ways(spark):
    labels = F.array(*map(F.lit, ["S", "I", "[PAD]", "SS", "A", "|", "??"]))
    assert one(spark, h.labels_to_ipa(labels)) == ["ɕ", "i", "s͈", "a", "??"]
    good, bad = one(spark, h.ipa_to_labels(F.array(F.lit("we"), F.lit("k̚")))), one(spark, h.ipa_to_labels(F.array(F.lit("k"), F.lit("q"))))
    assert good.labels == ["oE", "k"] and (bad.labels, bad.unsupported) == (None, ["q"])


# kernels against plain versions


def plain_edit(sub, dele, ins):
    m, n = len(dele), len(ins)
    d = [[0.0] * (n + 1) for _ in range(m + 1)]
    for i in range(m + 1):
        for j in range(n + 1):
            if i or j:
                d[i][j] = min(([d[i - 1][j - 1] + sub[i - 1][j - 1]] if i and j else []) + ([d[i - 1][j] + dele[i - 1]] if i else []) + ([d[i][j - 1] + ins[j - 1]] if j else []))
    return d[m][n]


def test_edit_path():
    rng = np.random.default_rng(1)
    for _ in range(60):
        m, n = rng.integers(0, 7, 2)
        sub, dele, ins = rng.integers(0, 4, (m, n)) / 2, rng.integers(1, 4, m) / 2, rng.integers(1, 4, n) / 2
        cost, moves = kernels.edit_path(sub, dele, ins)
        i = j = 0
        spent = 0.0
        for k in moves:
            spent += sub[i][j] if k == kernels.SUBSTITUTE else dele[i] if k == kernels.DELETE else ins[j]
            i, j = i + (k != kernels.INSERT), j + (k != kernels.DELETE)
        assert (i, j) == (m, n) and abs(spent - cost) < 1e-9 and abs(cost - plain_edit(sub, dele, ins)) < 1e-9


def test_dtw_path():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.normal(size=rng.integers(1, 8)), rng.normal(size=rng.integers(1, 8))
        path = kernels.dtw_path(a, b)
        assert path[0] == (0, 0) and path[-1] == (len(a) - 1, len(b) - 1)
        assert all((x2 - x1, y2 - y1) in ((1, 1), (1, 0), (0, 1)) for (x1, y1), (x2, y2) in zip(path, path[1:]))
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
        assert abs(sum((a[i] - b[j]) ** 2 for i, j in path) - d[-1, -1]) < 1e-9


def all_paths(f, labels, blank):
    import itertools

    states = kernels.ctc_states(labels, blank)
    for p in itertools.product(range(len(states)), repeat=f):
        if p[0] > 1 or p[-1] < len(states) - 2:
            continue
        if all(b == a or b == a + 1 or (b == a + 2 and states[b] != blank and states[b] != states[a]) for a, b in zip(p, p[1:])):
            yield p, states


def test_ctc():
    rng = np.random.default_rng(3)
    for labels in ([1], [1, 2], [1, 1]):
        labels = np.array(labels)
        logits = rng.normal(size=(4, 3))
        lp = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        scored = [(sum(lp[t, s[x]] for t, x in enumerate(p)), p) for p, s in all_paths(4, labels, 0)]
        path, score = kernels.ctc_viterbi(lp, labels)
        assert abs(score - max(scored)[0]) < 1e-4 and abs(sum(lp[t, kernels.ctc_states(labels, 0)[x]] for t, x in enumerate(path)) - score) < 1e-4
        post = plain_kernels.ctc_posteriors(lp, labels)
        total = sum(np.exp(v) for v, _ in scored)
        want = np.zeros_like(post)
        for v, p in scored:
            for t_, x in enumerate(p):
                want[t_, x] += np.exp(v) / total
        assert np.allclose(post, want, atol=1e-9) and np.allclose(post.sum(1), 1)
    assert len(kernels.ctc_viterbi(np.zeros((2, 3)), np.array([1, 1]))[0]) == 0 and plain_kernels.ctc_posteriors(np.zeros((2, 3)), np.array([1, 1])) is None


def test_savgol_is_exact_on_parabolas():
    x = np.arange(25.0)
    assert np.allclose(plain_kernels.savgol_delta(3 + 2 * x + 0.5 * x**2), 2 + x)
    assert np.allclose(plain_kernels.savgol_delta([1.0, 2.0]), 0) and np.allclose(plain_kernels.savgol_delta([1.0, 3.0, 5.0, 7.0]), 2)


# alignment


def test_phone_costs():
    cost = lambda a, b, pos="onset", profile="ru", ka="consonant", kb="consonant": alignment.substitution(a, ka, pos, b, kb, profile)[:2]
    assert cost("k", "k") == (0.0, "match")
    assert cost("k", "k̚") == (0.0, "feature-similar substitution")
    assert abs(cost("k", "kʰ")[0] - 0.06) < 1e-9 and cost("k", "kʰ")[1] == "laryngeal contrast confusion"
    assert cost("k", "a", kb="vowel") == (1.25, "cross-category confusion")
    assert cost("t", "k̚", pos="coda")[1] == "coda neutralization"
    assert cost("a", "a", ka="vowel", kb="vowel") == (0.0, "vowel confusion") and cost("l", "l") == (0.0, "liquid realization issue")
    assert alignment.insertion("a", "vowel", "ru")[0] == 0.70 and alignment.insertion("a", "vowel", "x")[0] == 0.85
    assert alignment.deletion("n", "consonant", "coda")[0] == 0.75 and alignment.deletion("n", "consonant", "onset")[0] == 1.05


def test_alignment_scores_and_issues(spark):
    tok = "array<struct<symbol: string, category: string, position: string>>"
    ref = [("k", "consonant", "onset"), ("a", "vowel", "nucleus"), ("n", "consonant", "coda")]
    rows = [(1, ref, ref), (2, ref, ref[:2]), (3, ref, []), (4, [], []), (5, ref, [("kʰ", "consonant", "onset"), ("a", "vowel", "nucleus"), ("ɯ", "vowel", "nucleus"), ("n", "consonant", "coda")]), (6, ref, ref)]
    df = alignment.align(spark.createDataFrame(rows, f"id int, ref {tok}, hyp {tok}"))
    df = df.withColumns({"s": alignment.breakdown(F.col("alignment")), "i": alignment.issues(F.col("alignment"))}).withColumn("r", alignment.feedback(F.col("i"), F.col("s.overall")))
    got = {r.id: r for r in df.collect()}
    assert len(got) == 6 and got[1].alignment.total_cost == 0 and got[1].s.overall == 100 and got[1].i == [] and got[1].r.level == "excellent"
    assert [x.op for x in got[2].alignment.steps] == ["match", "match", "delete"] and got[2].alignment.total_cost == 0.75 and got[2].i[0].issue_type == "coda_deletion"
    assert abs(got[2].s.coda - 100 * (1 - 0.75 / 1.4)) < 1e-9
    assert [x.op for x in got[3].alignment.steps] == ["delete"] * 3 and got[4].alignment.steps == [] and got[4].alignment.score == 100
    assert [x.op for x in got[5].alignment.steps] == ["substitute", "match", "insert", "match"] and [x.issue_type for x in got[5].i] == ["epenthetic_vowel_insertion", "aspiration_or_tense_confusion"]
    sums = {r.id: (r.p, r.e, r.a, r.b) for r in df.select("id", alignment.summed_penalties(F.col("alignment")).alias("p"), alignment.segment_errors(F.col("alignment")).alias("e"), alignment.aligned_symbols(F.col("alignment"), "ref").alias("a"), alignment.aligned_symbols(F.col("alignment"), "hyp").alias("b")).collect()}
    for i, r in got.items():
        want = {}
        for x in r.alignment.steps:
            for k, v in (x.penalties or {}).items():
                want[k] = want.get(k, 0.0) + v
        assert sums[i][0] == pytest.approx(want) and sums[i][1] == [x.detail for x in reversed(r.alignment.steps) if x.cost > 0]
    assert sums[5][0] and sums[5][1] == ["ɯ inserted", "k -> kʰ"] and sums[5][2] == ["k", "a", "∅", "n"] and sums[2][3] == ["k", "a", "∅"] and sums[4] == ({}, [], [], [])
    two = df.withColumnRenamed("i", "issues").withColumn("profile", F.when(F.col("id") < 3, "ru").otherwise("en"))
    by = {(r.profile, r.issue_type, r.severity): r.n for r in alignment.issue_rollup(two, ["profile"]).collect()}
    assert by[(None, None, None)] == by[("ru", None, None)] + by[("en", None, None)] == sum(len(r.i) for r in got.values()) and by[("ru", "coda_deletion", None)] == 1
    rolled = {(r.issue_type, r.severity): r.n for r in alignment.issue_rollup(df.withColumnRenamed("i", "issues")).collect()}
    assert rolled[(None, None)] == sum(len(r.i) for r in got.values())


# segments, calibration, catalogue


SEG = "utt_id int, seg_idx int, token string, start_time double, end_time double, confidence double"


def test_gates_at_their_limits(spark):
    def utt(u, confidence, gap_at=None, gap=0.0, n=12):
        rows, now = [], 0.0
        for i in range(n):
            now += gap if i == gap_at else 0.0
            rows.append((u, i, "a", now, now + 0.25, confidence))
            now += 0.25
        return rows

    rows = utt(1, 0.9) + utt(2, 0.9, 11, 0.5) + utt(3, 0.9, 3, 1.25) + utt(4, 0.9, 3, 1.0) + utt(5, 0.04) + utt(6, 0.9, n=1)
    seg = calibration.with_thresholds(spark.createDataFrame(rows, SEG), None)
    timing = {r.utt_id: r for r in quality.timing_summary(seg).collect()}
    assert [timing[i].quality_level for i in range(1, 7)] == ["clean", "discardable", "discardable", "usable_with_warnings", "usable_with_warnings", "clean"]
    gate = {r.utt_id: r.reasons for r in quality.alignment_gate(quality.timing_summary(seg)).collect()}
    assert [gate[i] for i in range(1, 7)] == ["", "tail_gap", "internal_gap", "", "avg_confidence,low_ratio,very_low_ratio,final_phones", ""]
    assert {r.utt_id: r.trim for r in quality.tail_hint(seg).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 2, 6: 0}
    scope = {r.utt_id: r.scope for r in quality.confidence_issues(seg).collect()}
    assert scope[1] == "none" and scope[5] == "global"


def test_calibration_counts_29_and_30(spark):
    rows = [("a", i / 100) for i in range(29)] + [("b", i / 100) for i in range(30)] + [("", 0.5)]
    art = spark.createDataFrame([(("ready",), ((True, ok),), ((([(t_, c) for t_, c in rows],)),)) for ok in (True, False)],
                                "status struct<evaluation_status: string>, gates struct<alignment_confidence_gate: struct<performed: boolean, passed: boolean>>, alignment struct<forced: struct<segments: array<struct<token: string, confidence: double>>>>")
    stats = calibration.distribution(calibration.token_confidences(art))
    got = calibration.thresholds(stats).collect()
    assert [r.token for r in got] == ["b"] and abs(got[0].calibrated_low_threshold - np.quantile([i / 100 for i in range(30)], 0.25)) < 1e-9
    assert abs(got[0].calibrated_very_low_threshold - 0.029) < 1e-9
    assert calibration.summary(stats).first().artifact_token_count == 59


def test_puzzles(spark):
    cards = spark.createDataFrame([(0, "c_1", "t", 1, "g", [("c_1_p1", ["x", "y"])])], "pos int, id string, type string, unit int, grade string, puzzles array<struct<id: string, answer: array<string>>>")
    asked = [("c_1_p1", ["x", "y"]), ("c_1_p1", ["x", "z", "w"]), ("c_1_p2", ["x"]), ("d_1_p1", ["x"]), ("c_1_p1", []), (None, ["x"])]
    got = catalogue.check_puzzles(cards, spark.createDataFrame(asked, "puzzle_id string, answer array<string>")).collect()
    rows = sorted((str(r.puzzle_id), r.status, r.is_correct, r.wrong_indices) for r in got)
    assert rows == sorted([("c_1_p1", "OK", True, []), ("c_1_p1", "OK", False, [1, -1]), ("c_1_p2", "PUZZLE_NOT_FOUND", None, None), ("d_1_p1", "CARD_NOT_FOUND", None, None), ("c_1_p1", "INVALID_INPUT", None, None), ("None", "INVALID_INPUT", None, None)], key=str)


# frames and prosody


def test_frames_without_voice(spark):
    rows = [(1, i, 0.0) for i in range(3)] + [(2, i, 5.0) for i in range(3)] + [(3, 0, 0.0), (3, 1, 1.0), (3, 2, 0.0), (3, 3, 3.0)]
    z = prosody.interpolated(prosody.zscore(spark.createDataFrame(rows, "utt_id int, frame_idx int, f0_raw double")))
    got = {(r.utt_id, r.frame_idx): (r.f0, r.f0_filled) for r in z.collect()}
    assert all(got[1, i] == (0.0, 0.0) and got[2, i] == (0.0, 0.0) for i in range(3))
    assert [got[3, i][1] for i in range(4)] == [-1.0, -1.0, 0.0, 1.0]


def test_forced_alignment_reports_bad_input(spark):
    em = spark.createDataFrame([(u, i, [0.0, float(i == 1), 0.0]) for u in (1, 2, 3, 4) for i in range(3)], "utt_id long, frame_idx int, logits array<double>")
    targets = spark.createDataFrame([(1, [1]), (2, []), (3, [1, 0]), (4, [1, 1, 1, 1])], "utt_id long, labels array<int>")
    got = {r.utt_id: r for r in frames.force_align(em, targets).collect()}
    assert got[1].error is None and got[1].coverage == 1.0 and [s.label for s in got[1].segments] == [1]
    assert [got[i].error for i in (2, 3, 4)] == ["no labels", "blank label", "too few frames"]


def test_fit_equals_the_block_version_at_any_partitioning(spark):
    rng = np.random.default_rng(4)
    rows = [(g, rng.normal(size=12).tolist()) for g, n in ((1, 11), (2, 12), (3, 40)) for _ in range(n)]
    df = spark.createDataFrame(rows, "eojeol_idx int, v array<double>")
    for parts in (1, 5):
        got = {r.eojeol_idx: r for r in distributions.fit(df.repartition(parts), ["eojeol_idx"]).collect()}
        assert [got[i].mode for i in (1, 2, 3)] == ["diagonal", "full_shrunk", "full_shrunk"]
        for g in (2, 3):
            want = plain_kernels.shrunk_inverse(np.array([v for k, v in rows if k == g]))
            assert np.allclose(np.array(got[g].cov_inv).reshape(12, 12), want)


