"""Queries of what an evaluation hands on: rows, comparisons, tips, records; and the narrow transcription."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from soripark import bridge as b
from soripark.functions import composition
from soripark.functions import hangul as h
from soripark.operators import handoff
from soripark.sources import stores
from soripark.sources.shared import new_folder, staged
from soripark.queries import _SEG, _evaluated, _rounded, query

_KEY = ["conv_id", "turn"]


@query()
def alignment_rows(spark, d):
    return handoff.alignment_rows(_evaluated(spark, d), _KEY)


@query()
def mismatch_rows(spark, d):
    return _rounded(handoff.mismatch_rows(_evaluated(spark, d), _KEY))


@query()
def feedback_tips(spark, d):
    e = _evaluated(spark, d).select(*_KEY, handoff.feedback_report(F.col("report")).alias("r"))
    return e.select(*_KEY, "r.headline", F.size("r.tips").alias("n_tips"), F.sha2(F.array_join("r.tips", "\n"), 256).alias("tips_sha256"))


def _compared(spark, d):
    """Letters of the two sides of each pair of turns."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    rows = b.label_pairs(spark, d).select(*_KEY, letters("ref").alias("target"), letters("hyp").alias("user"))
    return handoff.compare_tokens(rows)


@query()
def compare_tokens(spark, d):
    c = _compared(spark, d)
    return c.select(*_KEY, "compared.score", handoff.op_summary(F.col("compared.details")).alias("s")).select(*_KEY, "score", "s.*")


@query()
def diff_feedback(spark, d):
    c = F.col("compared.details")
    return _compared(spark, d).select(*_KEY, F.sha2(handoff.diff_lines(c), 256).alias("lines_sha256"), handoff.diff_feedback(c, F.col("compared.score")).alias("feedback"))


def _judged(spark, d):
    rows = b.alignments(spark, d)
    return rows.withColumns({
        "reference_text": F.concat(F.lit("utt "), F.col("utt_id").cast("string")), "coarse_score": F.when(F.col("utt_id") % 6 != 0, F.col("coarse_score")), "coarse_passed": F.when(F.col("utt_id") % 3 == 0, F.col("coarse_score") >= 75),
        "alignment_passed": F.when(F.col("utt_id") % 4 != 0, F.col("coverage") >= 0.95), "has_forced": F.col("utt_id") % 5 == 0, "has_score": F.col("utt_id") % 7 != 0, "score_is_final": F.when(F.col("utt_id") % 8 == 0, F.lit(False))})


_JUDGED = """al as (select utt_id, (100 - c % 13) / 100 as coverage, case when s = 'P' then 'retry' else 'ready' end as evaluation_status, case when c % 11 <> 0 then c % 7 <> 0 end as audio_passed, (60 + c % 40)::double as cs
  from (select o_orderkey as utt_id, min(o_custkey) as c, min(o_orderstatus) as s from orders group by 1)),
ju as (select *, case when utt_id % 6 <> 0 then cs end as coarse_score, case when utt_id % 4 <> 0 then coverage >= 0.95 end as alignment_passed, utt_id % 5 = 0 as has_forced, utt_id % 7 <> 0 as has_score, case when utt_id % 8 = 0 then false end as score_is_final from al),
gj as (select *, coalesce(case when utt_id % 3 = 0 then cs >= 75 end, case when coarse_score is not null then has_forced or alignment_passed is not null or has_score end) as coarse_gate from ju)"""


@query(f"""with {_JUDGED} select utt_id, 'utt ' || utt_id as reference_text, evaluation_status as status, 'coarse_token_alignment' as score_source, case when not has_score then false else coalesce(score_is_final, evaluation_status = 'ready') end as score_is_final, coarse_score,
  audio_passed is not null as audio_performed, audio_passed, coarse_score is not null as coarse_performed, coarse_gate as coarse_passed, alignment_passed is not null as alignment_performed, alignment_passed from gj""")
def feedback_handoff(spark, d):
    g = "gate_summary."
    rows = handoff.feedback_handoff(_judged(spark, d))
    return rows.select("utt_id", "reference_text", "status", "score_source", "score_is_final", "coarse_score", F.col(g + "audio_quality_gate.performed").alias("audio_performed"), F.col(g + "audio_quality_gate.passed").alias("audio_passed"),
                       F.col(g + "coarse_token_alignment_gate.performed").alias("coarse_performed"), F.col(g + "coarse_token_alignment_gate.passed").alias("coarse_passed"),
                       F.col(g + "alignment_confidence_gate.performed").alias("alignment_performed"), F.col(g + "alignment_confidence_gate.passed").alias("alignment_passed"))


@query(f"""with {_SEG}, {_JUDGED}, g as (select utt_id, count(*)::bigint as n, sum(greatest(0, end_time - start_time)) as total, string_agg(token, ' ' order by seg_idx) as tokens from s group by 1)
select gj.utt_id, coarse_gate as coarse_passed, coalesce(n, -1)::bigint as n_segments, round(total, 6) as duration, tokens from gj left join g using (utt_id)""")
def prosody_handoff(spark, d):
    rows = handoff.prosody_handoff(_judged(spark, d), b.segments(spark, d))
    x = F.col("phoneme_segments")
    total = F.aggregate(x, F.lit(0.0), lambda a, e: a + e["duration"])
    return _rounded(rows.select("utt_id", F.col("gate_summary.coarse_token_alignment_gate.passed").alias("coarse_passed"), F.coalesce(F.size(x), F.lit(-1)).cast("long").alias("n_segments"), total.alias("duration"), F.array_join(F.transform(x, lambda e: e["token"]), " ").alias("tokens")))


@query(f"""with {_SEG}, {_JUDGED}, g as (select utt_id, count(*)::bigint as n from s group by 1)
select gj.utt_id, 1 as schema_version, evaluation_status, n as n_segments, coarse_gate as coarse_passed, alignment_passed from gj left join g using (utt_id)""")
def evaluation_records(spark, d):
    """The nested records that the writer takes, a few of their fields."""
    rows = handoff.evaluation_records(_judged(spark, d).withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp")), b.segments(spark, d))
    gates = "llm_feedback_input.gate_summary."
    return rows.select("utt_id", "schema_version", "status.evaluation_status", F.when(F.col("alignment.forced.segments").isNotNull(), F.size("alignment.forced.segments").cast("long")).alias("n_segments"),
                       F.col(gates + "coarse_token_alignment_gate.passed").alias("coarse_passed"), F.col("gates.alignment_confidence_gate.passed").alias("alignment_passed"))


_NARROW = f"""with d as (select doc_id, regexp_extract_all(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{b.SYLLABLES}'), '[가-힣]') as s from documents), x as (select doc_id, s, unnest(range(1, len(s) + 1)) as i from d),
c as (select doc_id, i, unicode(s[i]) - 44032 as k from x), v as (select doc_id, i, k // 588 as o, (k % 588) // 28 as n, k % 28 as e from c)"""


@query(f"""{_NARROW} select doc_id, count(*)::bigint as syllables, sum((o <> 11)::int + 1 + (e > 0)::int)::bigint as symbols, sum((n in (11, 16, 19))::int)::bigint as narrow_vowels, sum((e in (9, 10, 11, 12, 13, 14, 15))::int)::bigint as double_codas from v group by 1""")
def narrow_ipa(spark, d):
    """Symbols of the narrow transcription, and how many are those that only it has."""
    rows = b.texts(spark, d).select("doc_id", F.regexp_extract_all("text", F.lit(f"({h.SYLLABLE})"), F.lit(1)).alias("s")).where(F.size("s") > 0)
    rows = rows.withColumn("x", F.flatten(F.transform("s", h.narrow_symbols_of))).withColumn("y", F.transform("x", lambda e: e["symbol"]))
    among = lambda values: F.size(F.filter("y", lambda e: e.isin(values))).cast("long")
    return rows.select("doc_id", F.size("s").cast("long").alias("syllables"), F.size("x").cast("long").alias("symbols"), among(["ø", "y", "ɯi"]).alias("narrow_vowels"), among(["lk̚", "lm", "lp̚", "ls", "ltʰ", "lpʰ", "lh"]).alias("double_codas"))


_STORED = f"""{_SEG}, od as (select o_orderkey as utt_id, min(o_orderdate) as at_, min(o_orderstatus) as st from orders group by 1), n as (select utt_id, count(*) as n from s group by 1),
rc as (select n.utt_id, n, last_day(at_::date)::varchar as day, n.utt_id % 97 = 0 as bad from n left join od using (utt_id))"""


@query(f"""with {_STORED}, f as (select min(day) as d0, max(day) as d1 from rc)
select coalesce(day, '__HIVE_DEFAULT_PARTITION__') as day, count(*) filter (not bad or day = d0)::bigint as n_good, coalesce(sum(n) filter (not bad or day = d0), 0)::bigint as n_segments, count(*) filter (bad and day <> d0)::bigint as n_broken
from rc, f where day < d1 or day is null group by 1""")
def artifact_store(spark, d):
    """Records written a folder a month, some of them broken; the first month is written anew without fault; all but the last month are read back, broken records counted by file."""
    day = F.last_day(F.min("o_orderdate").cast("date")).cast("string")
    days = b.table(spark, d, "orders").groupBy(F.col("o_orderkey").alias("utt_id")).agg(day.alias("day"))
    records = b.artifacts(spark, d).join(days, "utt_id", "left")
    text = F.to_json(F.struct("status", "gates", "alignment"))
    lines = staged(records.select("utt_id", F.coalesce("day", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("day"), text.alias("text")), "records")
    path, apart = new_folder(spark, "artifacts"), new_folder(spark, "quarantine")
    ends = lines.where(F.col("day") < "_").agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    broken = F.when(F.col("utt_id") % 97 == 0, F.expr("substring(text, 1, length(text) div 2)")).otherwise(F.col("text"))
    lines.select("day", broken.alias("value")).repartition("day").write.partitionBy("day").text(path)
    parsed = F.from_json("text", "status struct<evaluation_status: string>, gates struct<alignment_confidence_gate: struct<performed: boolean, passed: boolean>>, alignment struct<forced: struct<segments: array<struct<seg_idx: int, token: string, label: string, start_time: double, end_time: double, confidence: double>>>>")
    stores.write_artifacts(lines.where(F.col("day") == ends["first"]).select("day", parsed.alias("r")).select("day", "r.*"), path, "day", replace=True)
    scanned = stores.scan_artifacts(spark, path).withColumn("day", F.col("day").cast("string")).where(F.coalesce(F.col("day") != ends["last"], F.lit(True)))
    files = stores.quarantine(scanned, apart).withColumn("day", F.url_decode(F.regexp_extract("file", "day=([^/]*)/", 1)))
    bad = files.groupBy("day").agg(F.sum("n_broken").alias("n_broken"))
    name = F.coalesce("day", F.lit("__HIVE_DEFAULT_PARTITION__"))
    good = scanned.groupBy(name.alias("day")).agg(F.count_if(F.col("broken").isNull()).alias("n_good"), F.coalesce(F.sum(F.when(F.col("broken").isNull(), F.size("alignment.forced.segments"))), F.lit(0)).cast("long").alias("n_segments"))
    return good.join(bad, "day", "left").fillna(0, ["n_broken"])


@query("select doc_id, sha256(nfc_normalize(translate(lower(text), 'aeo', 'ɑəɔ'))) as composed_sha256 from documents")
def composed_texts(spark, d):
    """Whole texts taken apart into letters and marks, and composed again: their accents come back as one character each."""
    lowered = F.translate(F.lower("text"), "aeo", "ɑəɔ")
    apart = lowered
    for letter in "éèêëçáíóúüöäñàâîôûïùœ":
        apart = F.replace(apart, F.lit(letter), F.lit(unicodedata.normalize("NFD", letter)))
    return b.table(spark, d, "documents").select("doc_id", apart.alias("text")).select("doc_id", F.sha2(composition.composed(F.col("text")), 256).alias("composed_sha256"))
