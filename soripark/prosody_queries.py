"""Queries of spans, contours, pitch comparison and records; SQL twins where no warping path is asked."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from soripark import bridge as b
from soripark.operators import analysis, comparison, distributions, prosody, ranges, spans
from soripark.queries import _F0, _PAIRED, _SEG, _VEC, _WORDS, _paired, _pitch, _rounded, query
from soripark.sources import stores
from soripark.sources.shared import new_folder, staged

_POSITIONS = ["onset", "nucleus", "coda", "onset", "nucleus", "other"]
_TEXTS = ["가나 다", "가 12 나다", "나", "가나다 라 마바 사"]
_LETTERS = "가나다라마바사"
_listed = lambda values: "[" + ", ".join(f"'{x}'" for x in values) + "]"


# spans


def _spans(spark, d, more: float = 0.0):
    """A span every eight frames of a user, ``more`` frames longer."""
    n = b.f0_frames(spark, d).groupBy("utt_id").agg(F.max("frame_idx").alias("last"))
    k = n.select("utt_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 8).cast("int"))).alias("span_idx"))
    return k.select("utt_id", "span_idx", ((F.col("span_idx") * 8 - 0.5) * 0.005).alias("t0"), ((F.col("span_idx") * 8 + 7.5 + more) * 0.005).alias("t1"))


_SPANS = "sn as (select utt_id, k as span_idx, (k * 8 - 0.5::double) * 0.005::double as t0, (k * 8 + 7.5::double + {more}::double) * 0.005::double as t1 from (select utt_id, unnest(range(0, max(frame_idx) // 8 + 1)) as k from fr group by 1))"


@query(f"""with {_F0}, {_SPANS.format(more=4)} select sn.utt_id, span_idx, count(*)::bigint as frames, min(frame_idx) as first_frame, max(frame_idx) as last_frame, round(sum(f0), 6) as f0_sum
from sn join z on z.utt_id = sn.utt_id and z.t >= t0 and z.t < t1 group by 1, 2""")
def slice_frames(spark, d):
    rows = spans.slice_frames(_pitch(spark, d), _spans(spark, d, 4.0))
    return _rounded(rows.groupBy("utt_id", "span_idx").agg(F.count("*").alias("frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.sum("f0").alias("f0_sum")))


_SYLLABLES = f"""
ps as (select utt_id, seg_idx, start_time, end_time, ({_listed(_POSITIONS)})[part % 6 + 1] as position, utt_id % 17 = 0 and max(seg_idx) over (partition by utt_id) > 0 as odd
  from (select seg.*, (end_ticks - ticks) / 10000.0::double as start_time, end_ticks / 10000.0::double as end_time from seg)),
pl as (select *, lag(position) over (partition by utt_id order by seg_idx) as before_ from ps where not odd),
pg as (select *, sum(case when before_ is null or (before_ in ('coda', 'nucleus') and position in ('onset', 'nucleus')) then 1 else 0 end) over (partition by utt_id order by seg_idx) as g from pl),
sg as (select utt_id, g, min_by(start_time, seg_idx) as t0, max_by(end_time, seg_idx) as t1 from pg group by 1, 2 having bool_or(position = 'nucleus')),
sy as (select utt_id, (row_number() over (partition by utt_id order by g) - 1)::int as syl_idx, t0, t1 from sg)"""


def _syllables(spark, d):
    s = b.segments(spark, d)
    positions = s.select("utt_id", "seg_idx", F.get(F.array(*map(F.lit, _POSITIONS)), (F.col("part") % 6).cast("int")).alias("position"))
    last = s.groupBy("utt_id").agg(F.max("seg_idx").alias("last"))
    positions = positions.join(last, "utt_id").where("utt_id % 17 <> 0 or seg_idx < last or last = 0").drop("last")
    return spans.syllable_spans(s, positions)


@query(f"""with {_SEG}, {_SYLLABLES} select utt_id, syl_idx, round(t0, 6) as t0, round(t1, 6) as t1, null::varchar as error from sy
union all select distinct utt_id, null, null, null, 'length mismatch' from ps where odd""")
def syllable_spans(spark, d):
    return _rounded(_syllables(spark, d))


def _text_of():
    return F.get(F.array(*map(F.lit, _TEXTS)), (F.col("utt_id") % 4).cast("int"))


@query(f"""with {_SEG}, {_SYLLABLES}, n as (select utt_id, count(*) as n, string_split(({_listed(_TEXTS)})[utt_id % 4 + 1], ' ') as w from sy group by utt_id),
x as (select utt_id, n, w, unnest(range(0, len(w))) as k from n), y as (select *, len(regexp_extract_all(w[k + 1], '[가-힣]')) as h from x),
v as (select *, sum(h) over (partition by utt_id order by k) - h as a, len(w) - 1 as last from y), r as (select *, case when k = last then n else least(n, a + h) end as e from v),
g as (select r.utt_id, k, w, min_by(t0, syl_idx) as t0, max_by(t1, syl_idx) as t1, min(syl_idx) as first_syl, max(syl_idx) as last_syl from r join sy on sy.utt_id = r.utt_id and syl_idx >= a and syl_idx < e group by r.utt_id, k, w),
o as (select *, row_number() over (partition by utt_id order by k) - 1 as i from g)
select utt_id, i::int as eojeol_idx, round(t0, 6) as t0, round(t1, 6) as t1, w[i + 1] as label, first_syl, last_syl from o""")
def eojeol_spans(spark, d):
    s = _syllables(spark, d)
    return _rounded(spans.word_spans(s, s.select("utt_id").distinct().withColumn("text", _text_of())))


@query(f"with {_F0} select utt_id, 0.0::double as t0, round(max(t), 6) as t1, '전체' as label from z group by 1")
def whole_spans(spark, d):
    return _rounded(spans.whole_spans(_pitch(spark, d)))


@query(f"""with {_SEG}, {_SYLLABLES}, n as (select utt_id, count(*) as total from sy group by 1), w as (select utt_id, total, unnest(range(0, 3)) as k from n), wt as (select *, k * 0.4::double as w0, k * 0.4::double + 0.7::double as w1 from w),
h as (select wt.utt_id, k, total, syl_idx, substr('{_LETTERS}', syl_idx % 7 + 1, 1) as label from wt join sy on sy.utt_id = wt.utt_id where t1 > t0 and greatest(0, least(w1, t1) - greatest(w0, t0)) / (t1 - t0) >= 0.3),
g as (select utt_id, k, total, count(*) as c, min(syl_idx) as a, max(syl_idx) as b, string_agg(label, '' order by syl_idx) as l from h group by 1, 2, 3),
p as (select *, case when total = 1 then '유일 음절' when a = 0 then '첫 음절' when a = total - 1 then '마지막 음절' else (a + 1) || '번째 음절' end as pa, case when total = 1 then '유일 음절' when b = 0 then '첫 음절' when b = total - 1 then '마지막 음절' else (b + 1) || '번째 음절' end as pb from g)
select w.utt_id, w.k::int as k, case when c = 1 then pa else pa || '~' || pb end || ' (' || l || ')' as hint from w left join p on p.utt_id = w.utt_id and p.k = w.k""")
def syllable_hints(spark, d):
    s = _syllables(spark, d).where("error is null")
    label = F.substring(F.lit(_LETTERS), (F.col("syl_idx") % 7 + 1).cast("int"), F.lit(1))
    windows = s.select("utt_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    windows = windows.withColumns({"w0": F.col("k") * F.lit(0.4), "w1": F.col("k") * F.lit(0.4) + F.lit(0.7)})
    return spans.syllable_hints(windows, s.select("utt_id", F.col("syl_idx").alias("pos"), "t0", "t1", label.alias("label")), ["utt_id", "k"])


# contours


def _contours(spark, d):
    c = spans.span_contours(_pitch(spark, d), _spans(spark, d), ["utt_id", "span_idx"])
    return c.select("utt_id", (F.col("utt_id") % 10).alias("text_id"), F.floor(F.col("span_idx") / 2).cast("int").alias("eojeol_idx"), (F.col("span_idx") % 2).alias("syl_idx"), "contour")


_CONTOURS = f"""{_F0}, ca as (select utt_id, frame_idx // 8 as k, list(f0 order by frame_idx) as v from z group by 1, 2), cb as (select utt_id, k, v, unnest(range(0, 50)) as i from ca),
cc as (select *, i * (len(v) - 1) / 49.0::double as p, floor(i * (len(v) - 1) / 49.0::double)::int as f from cb),
ct as (select utt_id, utt_id % 10 as text_id, (k // 2)::int as eojeol_idx, k % 2 as syl_idx, i, v[f + 1] + (coalesce(v[f + 2], v[f + 1]) - v[f + 1]) * (p - f) as x from cc),
mc as (select text_id, eojeol_idx, syl_idx, i, avg(x) as m, count(*) as n from ct group by all)"""


@query(f"with {_CONTOURS} select text_id, eojeol_idx, syl_idx, i::int as i, round(m, 6) as mean, n::bigint as n from mc")
def mean_contours(spark, d):
    m = spans.mean_contours(_contours(spark, d), ["text_id", "eojeol_idx", "syl_idx"])
    return _rounded(m.select("text_id", "eojeol_idx", "syl_idx", F.posexplode("mean_contour").alias("i", "mean"), "n"))


@query(f"with {_CONTOURS} select utt_id, ct.text_id, ct.eojeol_idx, ct.syl_idx, round(sqrt(avg((x - m) * (x - m))), 6) as rmse from ct join mc using (text_id, eojeol_idx, syl_idx, i) where (utt_id + ct.eojeol_idx) % 3 = 0 group by 1, 2, 3, 4")
def syllable_drilldown(spark, d):
    """Every third word stands for an outlier."""
    c = _contours(spark, d)
    outliers = c.where("(utt_id + eojeol_idx) % 3 = 0").select("utt_id", "eojeol_idx")
    means = spans.mean_contours(c, ["text_id", "eojeol_idx", "syl_idx"])
    return _rounded(spans.syllable_drilldown(c, means, outliers, ["utt_id", "eojeol_idx"], ["text_id", "eojeol_idx", "syl_idx"]))


@query(f"""with {_F0}, f as (select *, last_value(case when voiced then f0 end ignore nulls) over a as v0, last_value(case when voiced then frame_idx end ignore nulls) over a as i0,
  first_value(case when voiced then f0 end ignore nulls) over b as v1, first_value(case when voiced then frame_idx end ignore nulls) over b as i1 from z
  window a as (partition by utt_id order by frame_idx rows between unbounded preceding and current row), b as (partition by utt_id order by frame_idx rows between current row and unbounded following)),
g as (select utt_id, list(coalesce(case when voiced then f0 end, v0 + (v1 - v0) * (frame_idx - i0) / nullif(i1 - i0, 0), v0, v1, f0) order by frame_idx) as v from f group by 1),
h as (select *, (least(11, case when len(v) % 2 = 1 then len(v) else len(v) - 1 end) - 1) // 2 as h, unnest(range(0, len(v))) as i from g),
c as (select *, least(greatest(i, h), len(v) - 1 - h) as c from h), j as (select *, unnest(range(-h, h + 1)) as j from c where len(v) >= 3),
k as (select utt_id, i, c, h * (h + 1) / 3.0::double as m, j, v[c + j + 1] as x from j)
select utt_id, i as frame_idx, round(sum(j * x) / sum(j * j) + 2 * (i - any_value(c)) * sum((j * j - m) * x) / sum((j * j - m) * (j * j - m)), 6) as delta from k group by utt_id, i
union all select utt_id, i, 0.0 from c where len(v) < 3""")
def delta_f0(spark, d):
    return _rounded(comparison.delta_f0(prosody.interpolated(_pitch(spark, d))))


@query("""with c as (select label::bigint * 1000000 + vec_id // 2000 as utt_id, vec_id, row_number() over (partition by label, vec_id // 2000 order by vec_id) - 1 as frame_idx, embedding from embeddings),
x as (select utt_id, frame_idx, unnest(range(0, len(embedding))) as i, unnest(embedding)::double * 10 as v from c), s as (select *, avg(v) over w as m, stddev_pop(v) over w as sd from x window w as (partition by utt_id, i))
select utt_id, frame_idx, i::int as i, round((v - m) / case when sd = 0 then 1 else sd end, 6) as c from s""")
def cmvn(spark, d):
    rows = comparison.cmvn(b.emissions(spark, d).withColumnRenamed("logits", "c"), 64)
    return _rounded(rows.select("utt_id", "frame_idx", F.posexplode("c").alias("i", "c")))


# comparison


def _sides(spark, d, *values: str):
    """Frames of an odd user (learner) and of the even one before it (native) under the odd one's id, with each of ``values`` (the pitch, if none); staged, as each side is read more than once."""
    rows = prosody.interpolated(_pitch(spark, d))
    if "delta" in values:
        rows = rows.join(comparison.delta_f0(rows), ["utt_id", "frame_idx"])
    rows = rows.select("utt_id", F.col("frame_idx").cast("int").alias("idx"), "t", *{"f0_filled": 0} | dict.fromkeys(values), "voiced").withColumn("_native", F.col("utt_id") % 2 == 0)
    pair = rows.withColumn("utt_id", F.col("utt_id") + F.col("_native").cast("int"))
    both = F.count_if("_native").over(Window.partitionBy("utt_id")) * F.count_if(~F.col("_native")).over(Window.partitionBy("utt_id")) > 0
    pair = staged(pair.withColumn("_both", both).where("_both").drop("_both").withColumn("f0", F.col("f0_filled")), "sides")
    return tuple(pair.where(side).drop("_native") for side in (F.col("_native"), ~F.col("_native")))


def _valued(sides, value: str = "f0_filled"):
    """Both sides with one value as v."""
    return tuple(side.withColumn("v", F.col(value)) for side in sides)


@query()
def dtw_align(spark, d):
    """Pitch of a learner warped on the native one's: mean squared difference and voiced steps of each path."""
    native, learner = _valued(_sides(spark, d))
    rows = comparison.warped(comparison.dtw_paths(native, learner, ["utt_id"]), native, learner, ["utt_id"])
    return _rounded(rows.groupBy("utt_id").agg(F.count("*").alias("steps"), F.count_if("voiced").alias("voiced_steps"), F.avg(F.pow(F.col("native") - F.col("learner"), 2)).alias("mean_square")))


@query()
def lens_views(spark, d):
    """Words of eight frames under both aligners, pitch and its velocity."""
    sides, out = _sides(spark, d, "f0_filled", "delta"), None
    for feature in ("f0_filled", "delta"):
        word = lambda df: df.withColumns({"eojeol_idx": F.floor(F.col("idx") / 8).cast("int"), "idx": F.col("idx") % 8})
        native, learner = map(word, _valued(sides, feature))
        by = ["utt_id", "eojeol_idx"]
        for aligner, pairs in (("none", comparison.evenly_paired(native, learner, by)), ("dtw", comparison.warped(comparison.dtw_paths(native, learner, by), native, learner, by))):
            metrics = prosody.contour_metrics(pairs.withColumn("x", F.col("step")), by)
            view = comparison.lens_view(pairs, metrics, by, ["utt_id"]).withColumns({"feature": F.lit(feature), "aligner": F.lit(aligner)})
            out = view if out is None else out.unionByName(view)
    return _rounded(out)


def _shape_records(spark, d):
    native, learner = _valued(_sides(spark, d, "delta"), "delta")
    by = ["utt_id"]
    whole = learner.groupBy("utt_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    paths = staged(comparison.dtw_paths(native, learner, by, 3), "paths")
    return comparison.shape_records(comparison.shape_windows(paths, native, learner, whole, by), by)


@query()
def pitch_shape_records(spark, d):
    """Each user's whole frames stand for one word."""
    rows = _shape_records(spark, d)
    return _rounded(rows.select("utt_id", "rule_label", "severity", "value", F.size("windows").alias("n_windows"), comparison.window_bucket(F.col("windows")).alias("bucket")))


_SUNG = f"""{_F0}, sy as (select utt_id, frame_idx // 6 as syl_idx, min(t) as t0, max(t) + 0.005::double as t1 from z group by 1, 2), n as (select utt_id, count(*) as n, string_split(({_listed(_TEXTS)})[(utt_id - utt_id % 2) % 4 + 1], ' ') as w from sy group by utt_id),
  x as (select utt_id, n, w, unnest(range(0, len(w))) as k from n), y as (select *, len(regexp_extract_all(w[k + 1], '[가-힣]')) as h from x),
  v as (select *, sum(h) over (partition by utt_id order by k) - h as a, len(w) - 1 as last from y), r as (select *, case when k = last then n else least(n, a + h) end as e from v),
  g as (select r.utt_id, k, min_by(t0, syl_idx) as t0, max_by(t1, syl_idx) as t1 from r join sy on sy.utt_id = r.utt_id and syl_idx >= a and syl_idx < e group by r.utt_id, k),
  sp as (select utt_id, (row_number() over (partition by utt_id order by k) - 1)::int as eojeol_idx, t0, t1 from g)"""


def _sung_words(spark, d):
    """Pitch frames and word spans of each user: six frames stand for a syllable, and the words of a text, which a pair of users shares, take as many syllables as they have letters."""
    frames = staged(_pitch(spark, d), "pitch")
    syllables = frames.groupBy("utt_id", F.floor(F.col("frame_idx") / 6).cast("int").alias("syl_idx")).agg(F.min("t").alias("t0"), (F.max("t") + F.lit(0.005)).alias("t1"))
    text = F.get(F.array(*map(F.lit, _TEXTS)), ((F.col("utt_id") - F.col("utt_id") % 2) % 4).cast("int"))
    return frames, spans.word_spans(syllables, syllables.select("utt_id").distinct().withColumn("text", text))


@query(f"""with {_SUNG}, m as (select sp.utt_id, eojeol_idx, avg(f0) filter (voiced) as mean from sp join z on z.utt_id = sp.utt_id and t >= t0 and t < t1 group by 1, 2),
p as (select l.utt_id, l.eojeol_idx, round(l.mean - n.mean, 9) as value from m l join m n on l.utt_id = n.utt_id + 1 and l.utt_id % 2 = 1 and l.eojeol_idx = n.eojeol_idx)
select utt_id, eojeol_idx, 'pitch_offset' as rule_label, round(value, 6) as value, case when abs(value) >= 1.6 then 'major' else 'minor' end as severity from p where abs(value) >= 0.8""")
def word_pitch_offset(spark, d):
    """Mean pitch of the words of a text, by their spans."""
    frames, words = _sung_words(spark, d)
    means = ranges.span_means(frames, words, ["utt_id"], "t", ["eojeol_idx"], "f0", "voiced").select("utt_id", "eojeol_idx", F.round("mean", 10).alias("mean"))
    native = means.where("utt_id % 2 = 0").select((F.col("utt_id") + 1).alias("utt_id"), "eojeol_idx", F.col("mean").alias("native_mean"))
    learner = means.where("utt_id % 2 = 1").withColumnRenamed("mean", "learner_mean")
    return _rounded(prosody.pitch_offset(learner.join(native, ["utt_id", "eojeol_idx"])))


@query()
def word_shape_records(spark, d):
    """Pitch shapes of the words of a text: each word's frames by its span, warped on the native word's, and compared window by window."""
    frames, words = _sung_words(spark, d)
    rows = prosody.interpolated(frames)
    rows = rows.join(comparison.delta_f0(rows), ["utt_id", "frame_idx"])
    inside = spans.slice_frames(rows, words.select("utt_id", "eojeol_idx", "t0", "t1"))
    place = F.row_number().over(Window.partitionBy("utt_id", "eojeol_idx").orderBy("frame_idx")) - 1
    inside = staged(inside.select("utt_id", "eojeol_idx", place.alias("idx"), "t", F.col("delta").alias("v"), "voiced"), "words")
    by = ["utt_id", "eojeol_idx"]
    learner = inside.where("utt_id % 2 = 1")
    native = inside.where("utt_id % 2 = 0").withColumn("utt_id", F.col("utt_id") + 1)
    paths = staged(comparison.dtw_paths(native, learner, by, 3), "paths")
    out = comparison.shape_records(comparison.shape_windows(paths, native, learner, words.where("utt_id % 2 = 1").select(*by, "t0", "t1"), by), by)
    return _rounded(out.select(*by, "rule_label", "severity", "value", F.size("windows").alias("n_windows"), comparison.window_bucket(F.col("windows")).alias("bucket")))


_RECORDS = f"""{_F0}, {_WORDS}, {_PAIRED},
rc as (select utt_id, eojeol_idx, 'pitch_offset' as rule_label, learner_mean - native_mean as value, case when abs(learner_mean - native_mean) >= 1.6 then 'major' else 'minor' end as severity, 3 as o from pr where abs(learner_mean - native_mean) >= 0.8
  union all select utt_id, eojeol_idx, 'eojeol_slow', learner_duration / native_duration, case when learner_duration / native_duration >= 5.0 then 'major' else 'minor' end, 4 from pr where abs(learner_duration / native_duration - 1) >= 1.5),
so as (select *, row_number() over (partition by utt_id order by severity <> 'major', eojeol_idx, o)::int as place from rc)"""


def _records(spark, d):
    paired = _paired(spark, d)
    rows = prosody.pitch_offset(paired).unionByName(prosody.eojeol_slow(paired))
    windows = F.lit(None).cast("array<struct<k: int, ratio_start: double, ratio_end: double, delta_diff: double>>")
    return rows.withColumns({"eojeol_label": F.concat(F.lit("w"), F.col("eojeol_idx").cast("string")), "windows": windows, "syllable_label": F.lit(None).cast("string")})


@query(f"with {_RECORDS} select utt_id, eojeol_idx, rule_label, round(value, 6) as value, severity, place from so")
def sorted_records(spark, d):
    return _rounded(comparison.sort_records(_records(spark, d)).select("utt_id", "eojeol_idx", "rule_label", "value", "severity", "place"))


@query(f"""with {_RECORDS}, f as (select utt_id, place, case when rule_label = 'pitch_offset' then '''w' || eojeol_idx || ''' 어절 전체 음높이가 ' || case when severity = 'major' then '너무' else '조금' end || ' ' || case when value > 0 then '높' else '낮' end || '아요. '
    || case when severity = 'major' then '확실히' else '조금만' end || ' ' || case when value > 0 then '낮게' else '높게' end || ' 말해봐요.'
  else '''w' || eojeol_idx || ''' 어절 전체를 ' || case when severity = 'major' then '너무' else '조금' end || case when value > 1 then ' 천천히 발화했어요. 빠르게' else ' 빠르게 발화했어요. 천천히' end || ' 말해봐요.' end as s from so),
g as (select utt_id, string_agg(s, '|' order by place) as s from f group by 1)
select u.utt_id, coalesce(s, '') as feedback, case when s is null then '잘 발화했어요!' end as summary_when_no_outlier from (select distinct utt_id from fr) u left join g using (utt_id)""")
def prosody_feedback(spark, d):
    users = b.f0_frames(spark, d).select("utt_id").distinct()
    return comparison.prosody_payload(users, _records(spark, d)).withColumn("feedback", F.array_join("feedback", "|"))


def _warped_vectors(spark, d):
    """Vectors of even labels (native) and of the odd ones after them (learner), twelve values a frame after normalisation."""
    rows = comparison.cmvn(b.emissions(spark, d).withColumnRenamed("logits", "c"), 64)
    rows = rows.select("utt_id", F.col("frame_idx").cast("int").alias("idx"), (F.col("frame_idx") * F.lit(0.01)).alias("t"), F.slice("c", 2, 12).alias("v"), F.get("c", F.lit(0)).alias("f0"))
    odd = F.floor(F.col("utt_id") / 1_000_000) % 2 == 1
    return rows.where(~odd).withColumn("utt_id", F.col("utt_id") + 1_000_000), rows.where(odd)


@query()
def mfcc_dtw_path(spark, d):
    native, learner = _warped_vectors(spark, d)
    return comparison.dtw_paths(native, learner, ["utt_id"], 2)


@query()
def prosody_plot_series(spark, d):
    """Boundaries of words of twenty frames along the warped path."""
    native, learner = _warped_vectors(spark, d)
    series = comparison.plot_series(comparison.dtw_paths(native, learner, ["utt_id"], 2), native, learner)
    words = learner.where("idx % 20 = 0").select("utt_id", F.floor(F.col("idx") / 20).cast("int").alias("eojeol_idx"), "t").withColumnRenamed("t", "t0").withColumn("label", F.concat(F.lit("w"), F.col("eojeol_idx").cast("string")))
    return comparison.word_boundaries(series, words)


# models


@query("""with c as (select label as eojeol_idx, vec_id % 7 as side, count(*)::bigint as n from embeddings group by 1, 2)
select eojeol_idx, side, case when n < 12 then 'diagonal' else 'full' end as mode, n, case when n < 12 then 'n=' || n || ' < 12: diagonal' end as warning from c""")
def distribution_quality(spark, d):
    models = distributions.moments(b.vectors(spark, d).withColumn("side", F.col("utt_id") % 7), ["eojeol_idx", "side"])
    return distributions.quality(models, ["eojeol_idx", "side"])


@query(f"""with {_VEC}, k as (select * from (values ('rising', 3, 1, 'rising 과도'), ('falling', 3, -1, 'falling 과도'), ('flat', 4, -1, '억양 평탄'), ('elongation', 11, 1, '마지막 음절 elongation'), ('slow', 9, 1, '어절 전체 느림')) t(kind, d, sign, expected_label)),
x as (select utt_id, v.eojeol_idx, kind, expected_label, i, case when i = k.d then m + sign * 3.5 * s when kind = 'flat' and i = 3 then m else v[i] end as y from v, k, unnest(range(1, 13)) r(i) join mo on mo.d = r.i where mo.eojeol_idx = v.eojeol_idx)
select utt_id, eojeol_idx, kind, expected_label, round(sum(y), 6) as total, round(max(y) filter (i = 3), 6) as slope, round(max(y) filter (i = 4), 6) as range from x group by 1, 2, 3, 4""")
def perturbed_vectors(spark, d):
    v = b.vectors(spark, d)
    rows = comparison.perturbed(v, distributions.moments(v, ["eojeol_idx"]), ["eojeol_idx"])
    return _rounded(rows.select("utt_id", "eojeol_idx", "kind", "expected_label", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get("v", F.lit(2)).alias("slope"), F.get("v", F.lit(3)).alias("range")))


@query(f"""with {_F0}, m as (select utt_id, f0_raw, max(frame_idx) over (partition by utt_id) as last, max(frame_idx) over (partition by utt_id) - frame_idx as i from fr)
select utt_id, i as frame_idx, round(case when f0_raw > 0 then f0_raw * pow(2.0, (2.0 + 4.0 * i / greatest(last, 1)) / 12) else 0 end, 6) as f0_raw from m""")
def perturbed_contour(spark, d):
    return _rounded(comparison.perturb_contour(b.f0_frames(spark, d), 2.0, 4.0, True).select("utt_id", "frame_idx", "f0_raw"))


@query("""with e as (select o_orderkey as utt_id, case min(o_orderstatus) when 'P' then 'retry' when 'O' then 'ready' end as evaluation_status from orders group by 1), p as (select l_orderkey as utt_id, count(*)::bigint as n_records from lineitem group by 1)
select e.utt_id, evaluation_status, coalesce(evaluation_status = 'ready', false) as prosody_executed, coalesce(evaluation_status, 'discarded') as reason, case when evaluation_status = 'ready' then n_records end as n_records from e left join p using (utt_id)""")
def full_evaluation(spark, d):
    status = F.min("o_orderstatus")
    evaluations = b.table(spark, d, "orders").groupBy(F.col("o_orderkey").alias("utt_id")).agg(F.when(status == "P", "retry").when(status == "O", "ready").alias("evaluation_status"))
    return comparison.routed(evaluations, b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("utt_id")).agg(F.count("*").alias("n_records")))


_SAID = ["가나 다", "나무 바다", "다 마"]
_ASKED = f"""
tx(k, j, n) as (values (0, 0, 4), (0, 1, 2), (1, 0, 4), (1, 1, 4), (2, 0, 2), (2, 1, 2)), ex as (select k, sum(n) as e from tx group by 1),
us as (select utt_id, count(*) as nf, utt_id % 4 as k from z group by 1), un as (select us.*, e, coalesce(e, 6) + case when utt_id % 5 = 0 then 1 else 0 end as nt from us left join ex using (k)),
sg as (select *, (i * nf // nt) * 0.005::double as s0, ((i + 1) * nf // nt) * 0.005::double as s1 from (select *, unnest(range(0, nt::bigint)) as i from un)),
oc as (select utt_id, k, case when e is null then 'unknown text' when nt <> e then 'token count mismatch' end as error from un),
wk as (select oc.utt_id, k, j, n, (sum(n) over (partition by oc.utt_id order by j) - n) as off from oc join tx using (k) where error is null),
wd as (select wk.utt_id, wk.k, j, n, off, a.s0 as t0, b.s1 as t1 from wk join sg a on a.utt_id = wk.utt_id and a.i = off join sg b on b.utt_id = wk.utt_id and b.i = off + n - 1),
sy as (select wd.utt_id, j, y, b.s1 - a.s0 as dur from (select *, unnest(range(0, n::bigint // 2)) as y from wd) wd join sg a on a.utt_id = wd.utt_id and a.i = off + 2 * y join sg b on b.utt_id = wd.utt_id and b.i = off + 2 * y + 1),
sl as (select utt_id, j, count(*) as sc, case when count(*) >= 2 and avg(dur) > 0 then max_by(dur, y) / avg(dur) else 1.0 end as lr from sy group by 1, 2),
ins as (select wd.utt_id, j, f0, voiced, row_number() over w - 1 as pos, count(*) over (partition by wd.utt_id, j) as total from wd join z on z.utt_id = wd.utt_id and t >= t0 and t < t1 window w as (partition by wd.utt_id, j order by frame_idx)),
nr as (select *, pos / greatest(total - 1, 1)::double as x from ins),
ga as (select utt_id, j, count(*) filter (voiced) as n, count(*) as tf, avg(f0) filter (voiced) as m, stddev_pop(f0) filter (voiced) as sd, max(f0) filter (voiced) - min(f0) filter (voiced) as rg,
  arg_min(x, [-f0, pos]) filter (voiced) as xp, arg_min(x, [f0, pos]) filter (voiced) as np, arg_min(f0, pos) filter (voiced) as st, arg_max(f0, pos) filter (voiced) as en, regr_slope(f0, x) filter (voiced) as sl from nr group by 1, 2),
gv as (select wd.utt_id, k, j, [case when ga.n >= 2 then m else 0 end, case when ga.n >= 2 then sd else 0 end, case when ga.n >= 3 then sl when ga.n >= 2 then en - st else 0 end, case when ga.n >= 2 then rg else 0 end, case when ga.n >= 2 then xp else 0.5 end,
  case when ga.n >= 2 then np else 0.5 end, case when ga.n >= 2 then st else 0 end, case when ga.n >= 2 then en else 0 end, t1 - t0, coalesce(sc, 0), coalesce(lr, 1.0), coalesce(ga.n / tf, 0)]::double[] as v
  from wd left join ga using (utt_id, j) left join sl using (utt_id, j)),
ds as (select utt_id, k, j, sqrt(sum(((v[d] - m) / (2 * s)) * ((v[d] - m) / (2 * s)))) as dist from gv join mo on mo.eojeol_idx = k * 2 + j group by 1, 2, 3)"""


def _requests(spark, d):
    """Each user's frames as an utterance of one of three texts or of an unknown one, cut in even segments; some have one too many."""
    frames = staged(_pitch(spark, d), "pitch")
    k = F.col("utt_id") % 4
    text = F.coalesce(F.get(F.array(*map(F.lit, _SAID)), k.cast("int")), F.lit("모르는 말"))
    n = F.coalesce(F.get(F.array(F.lit(6), F.lit(8), F.lit(4)), k.cast("int")), F.lit(6)) + F.when(F.col("utt_id") % 5 == 0, 1).otherwise(0)
    users = frames.groupBy("utt_id").agg(F.count("*").alias("frames")).withColumns({"text": text, "n": n})
    cut = users.select("utt_id", "frames", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seg_idx"))
    at = lambda i: F.floor(i * F.col("frames") / F.col("n")) * F.lit(0.005)
    segments = cut.select("utt_id", "seg_idx", at(F.col("seg_idx")).alias("start_time"), at(F.col("seg_idx") + 1).alias("end_time"))
    return users.select("utt_id", "text"), segments, frames


def _said_models(spark, d):
    """Diagonal models of the three texts' words from the vectors of labels 0 to 5, twice as wide."""
    m = distributions.moments(b.vectors(spark, d), ["eojeol_idx"]).where("eojeol_idx < 6")
    k = F.floor(F.col("eojeol_idx") / 2).cast("int")
    text = F.get(F.array(*map(F.lit, _SAID)), k)
    j = (F.col("eojeol_idx") % 2).cast("int")
    rows = m.select(text.alias("text"), j.alias("eojeol_idx"), F.get(F.split(text, " "), j).alias("eojeol"), "mean", F.transform("std", lambda s: s * 2).alias("std"), F.col("n").cast("int").alias("n"))
    flat = F.array(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: i * F.lit(0.01)))
    return rows.withColumns({"cov_inv": F.lit(None).cast("array<double>"), "mode": F.lit("diagonal"), "syllable_contours": flat})


@query(f"""with {_F0}, {_VEC}, {_ASKED}, av as (select utt_id, avg(dist) as a, count(*)::bigint as n from ds group by 1)
select oc.utt_id, error, n as n_words, round(a, 6) as avg_distance, case when a < 1.5 then 'natural' when a < 2.5 then 'borderline' when a is not null then 'unnatural' end as verdict from oc left join av using (utt_id)""")
def analyze_prosody(spark, d):
    """Every request's verdict or error, from segments and frames."""
    outcomes = analysis.analyze(*_requests(spark, d), _said_models(spark, d)).outcomes
    return _rounded(outcomes.select("utt_id", "error", "n_words", "avg_distance", "verdict"))


@query(f"""with {_F0}, {_VEC}, {_ASKED} select gv.utt_id, gv.j::int as eojeol_idx, round(v[1], 6) as f0_mean, round(v[3], 6) as f0_slope, round(v[9], 6) as duration, v[10]::bigint as syllable_count, round(v[11], 6) as last_syl_ratio,
  round(v[12], 6) as voiced_ratio, round(dist, 6) as distance, dist <= 2.5 as inside from gv join ds using (utt_id, j)""")
def analyzed_words(spark, d):
    """All twelve values of each word of the requests that have a verdict, and its distance."""
    w = analysis.analyze(*_requests(spark, d), _said_models(spark, d)).words
    of = lambda i: F.get("v", F.lit(i))
    return _rounded(w.select("utt_id", "eojeol_idx", of(0).alias("f0_mean"), of(2).alias("f0_slope"), of(8).alias("duration"), of(9).cast("long").alias("syllable_count"), of(10).alias("last_syl_ratio"), of(11).alias("voiced_ratio"), "distance", "inside"))


_KINDS = "kd as (select * from (values ('rising', 3, 1, 'rising 과도'), ('falling', 3, -1, 'falling 과도'), ('flat', 4, -1, '억양 평탄'), ('elongation', 11, 1, '마지막 음절 elongation'), ('slow', 9, 1, '어절 전체 느림')) t(kind, d, sign, expected_label))"
_DRAW = "((('0x' || substr(md5('0|' || eojeol_idx || '|' || c || '|' || (d - 1) || '|{0}'), 1, 12))::bigint + 0.5::double) / 281474976710656::double)"


@query(f"""with {_VEC}, {_KINDS}, cs as (select mo.*, unnest(range(0, 10)) as c from mo), dr as (select eojeol_idx, d, c, m, s, m + sqrt(-2 * ln({_DRAW.format('r')})) * cos({_DRAW.format('a')} * 2 * pi()) * s * 0.3::double as x from cs),
y as (select dr.eojeol_idx, c, kind, expected_label, dr.d, case when dr.d = kd.d then m + sign * 3.5 * s when kind = 'flat' and dr.d = 3 then m else x end as y from dr, kd)
select eojeol_idx, c::int as "case", kind, expected_label, round(sum(y), 6) as total, round(max(y) filter (d = 1), 6) as f0_mean, round(max(y) filter (d = 3), 6) as f0_slope, round(max(y) filter (d = 9), 6) as duration from y group by 1, 2, 3, 4""")
def labelled_cases(spark, d):
    """Ten made-up vectors a word model and kind of fault."""
    rows = comparison.labelled_cases(distributions.moments(b.vectors(spark, d), ["eojeol_idx"]), ["eojeol_idx"])
    of = lambda i: F.get("v", F.lit(i))
    return _rounded(rows.select("eojeol_idx", "case", "kind", "expected_label", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"), of(0).alias("f0_mean"), of(2).alias("f0_slope"), of(8).alias("duration")))


@query(f"""with {_VEC}, w as (select eojeol_idx, max(n) as n, list(m order by d) as m, list(s order by d) as s from mo group by 1)
select 's' || (eojeol_idx // 3) as text, (eojeol_idx % 3)::int as eojeol_idx, 'w' || eojeol_idx as eojeol, case when n >= 12 then 'full_shrunk' else 'diagonal' end as mode, n::int as n, round(list_sum(m), 6) as mean_sum, round(list_sum(s), 6) as std_sum, case when n >= 12 then 144 else 0 end as n_cells, true as same from w""")
def distribution_store(spark, d):
    """Word models with their full covariances written to a sharded store, read back and held against what was written."""
    m = distributions.fit(b.vectors(spark, d), ["eojeol_idx"])
    k = F.col("eojeol_idx")
    flat = F.array(F.transform("mean", lambda x: x / 3))
    words = staged(m.select(
        F.concat(F.lit("s"), F.floor(k / 3).cast("string")).alias("text"), (k % 3).cast("int").alias("eojeol_idx"), F.concat(F.lit("w"), k.cast("string")).alias("eojeol"), "mean", "std",
        F.when(F.col("cov_inv").isNotNull(), stores.nested(F.col("cov_inv"), 12)).alias("cov_inv"), "mode", F.col("n").cast("int").alias("n"), flat.alias("syllable_contours")), "models")
    path = new_folder(spark, "distributions")
    stores.write_distributions(words, path, 3)
    key = ["text", "eojeol_idx"]
    back = stores.read_distributions(spark, path)
    whole = lambda df, name: df.select(*key, F.struct(*(c for c in words.columns if c not in key)).alias(name))
    both = whole(words, "a").join(whole(back, "b"), key, "full")
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x)
    return _rounded(both.select(*key, "b.eojeol", "b.mode", "b.n", total("b.mean").alias("mean_sum"), total("b.std").alias("std_sum"), F.coalesce(F.size(F.flatten("b.cov_inv")), F.lit(0)).alias("n_cells"), F.col("a").eqNullSafe(F.col("b")).alias("same")))
