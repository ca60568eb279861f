"""The driver's tables as inputs of the speech jobs, over their whole rows and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from soripark import tables as t

#: One syllable a letter, chosen so that every sound change occurs.
SYLLABLES = "닭같이국물신라좋다않싫밥먹는앞문해옷안값여꽃일책학굳"
TOKENS = list(t.LABEL_IPA.values())
#: Ten-thousandths of a second in a frame.
FRAME_TICKS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hangul(text) -> F.Column:
    return F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", SYLLABLES)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: documents in Hangul letters."""
    return table(spark, sf_dir, "documents").select("doc_id", hangul(F.col("text")).alias("text"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone segments from order lines; times are whole ten-thousandths, so sums are exact."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    length, gap = F.round(F.col("l_quantity") * 100).cast("long"), F.round(F.col("l_tax") * 50000).cast("long")
    rows = table(spark, sf_dir, "lineitem").repartition("l_orderkey").select(  # dealt out by itself, so that what is computed from the columns is not shuffled beside them
        F.col("l_orderkey").alias("utt_id"), (F.row_number().over(w) - 1).alias("seg_idx"), F.get(F.array(*map(F.lit, TOKENS)), (F.col("l_partkey") % 40).cast("int")).alias("token"),
        (F.round(F.col("l_discount") * 100) / 10).alias("confidence"), length.alias("ticks"), F.sum(length + gap).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("end_ticks"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"), gap.alias("gap_ticks"))
    frame = lambda ticks: F.floor(ticks / FRAME_TICKS)
    return rows.select("utt_id", "seg_idx", "token", F.col("token").alias("label"), ((F.col("end_ticks") - F.col("ticks")) / 10000).alias("start_time"), (F.col("end_ticks") / 10000).alias("end_time"),
                       frame(F.col("end_ticks") - F.col("ticks")).alias("frame_start"), frame(F.col("end_ticks") - 1).alias("frame_end"), "confidence", "flag", "part", "ticks", "end_ticks", "gap_ticks")


def segment_frames() -> F.Column:
    """Frames of 20 ms of a segment and the gap before it, as an array of structs; gaps of some parts are mostly blank."""
    start, p = F.col("end_ticks") - F.col("ticks"), F.col("part")
    begin = F.floor((start - F.col("gap_ticks") + FRAME_TICKS - 1) / FRAME_TICKS)
    blank = lambda f: F.when(f * FRAME_TICKS < start, F.least(F.lit(99), 55 + 4 * (p % 11) + f % 5)).otherwise(10 + 5 * (f % 7))
    one = lambda f: F.struct(f.alias("frame_idx"), (blank(f) / 100).alias("blank_posterior"), ((f * 7 + p) % 20 / 20).alias("confidence"))
    return F.when(begin <= F.col("frame_end"), F.transform(F.sequence(begin, F.col("frame_end")), one))


def frames(spark: SparkSession, sf_dir: str, segs: DataFrame | None = None) -> DataFrame:
    """The frames of the segments (``segs``, if they are at hand), a row a frame."""
    s = segments(spark, sf_dir) if segs is None else segs
    return s.select("utt_id", F.explode(segment_frames()).alias("f")).select("utt_id", "f.*")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of forced alignments and gates from the customers of orders."""
    c = F.col("c")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("utt_id")).agg(F.min("o_custkey").alias("c"), F.min("o_orderstatus").alias("s"))
    return rows.select("utt_id", ((100 - c % 13) / 100).alias("coverage"), (-(c % 40) / 20).alias("normalized_log_prob"), ((90 + c % 10) / 100).alias("blank_ratio"), F.when(F.col("s") == "P", "retry").otherwise("ready").alias("evaluation_status"),
                       F.when(c % 11 != 0, c % 7 != 0).alias("audio_passed"), (60 + c % 40).cast("double").alias("coarse_score"), (c % 5 == 0).alias("is_partial"))


SEGMENT_FIELDS = ("seg_idx", "token", "label", "start_time", "end_time", "confidence")


def artifacts(spark: SparkSession, sf_dir: str, segs: DataFrame | None = None, fields: tuple[str, ...] = SEGMENT_FIELDS) -> DataFrame:
    """One nested evaluation record an order: status, gate, forced segments with those ``fields`` that are asked for."""
    of = (segments(spark, sf_dir) if segs is None else segs).groupBy("utt_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("segments"), F.min_by("flag", "seg_idx").alias("flag"))
    status = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("utt_id")).agg(F.min("o_orderstatus").alias("s"))
    gate = F.struct(F.lit(True).alias("performed"), (F.col("flag") != "R").alias("passed"))
    return of.join(status, "utt_id", "left").select(
        "utt_id", F.struct(F.when(F.col("s") == "P", "retry").otherwise("ready").alias("evaluation_status")).alias("status"),
        F.struct(gate.alias("alignment_confidence_gate")).alias("gates"), F.struct(F.struct("segments").alias("forced")).alias("alignment"))


def f0_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch frames from events: a user is an utterance, errors are unvoiced, 5 ms a frame."""
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    raw = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("utt_id"), idx.alias("frame_idx"), raw.alias("f0_raw")).withColumn("t", F.col("frame_idx") * F.lit(0.005))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 prosody values an utterance from embeddings, grouped by label."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("eojeol_idx"), F.col("vec_id").alias("utt_id"), F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double")).alias("v"))


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame logits from embeddings: an utterance a label and 2,000 ids, so some 200 frames, frames by id."""
    utt = F.col("label").cast("long") * 1_000_000 + F.floor(F.col("vec_id") / 2000)
    idx = F.row_number().over(Window.partitionBy(utt).orderBy("vec_id")) - 1
    return table(spark, sf_dir, "embeddings").select(utt.alias("utt_id"), idx.alias("frame_idx"), F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card a part with one puzzle, whose answer is the name's words."""
    answer = F.split("p_name", " ")
    card_id = F.concat(F.lit("card_"), F.col("p_partkey"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), card_id.alias("id"), F.col("p_type").alias("type"), F.col("p_size").alias("unit"), F.col("p_brand").alias("grade"),
        F.array(F.struct(F.concat(card_id, F.lit("_p1")).alias("id"), answer.alias("answer"))).alias("puzzles"))


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and recognised text of a user turn and the turn after it, letters as syllables."""
    letters = hangul(F.regexp_replace(F.lower("text"), "[^a-z]", ""))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", letters.alias("ref"), F.lead(letters).over(w).alias("hyp"))
    return rows.where("role = 'user' and hyp is not null").select("conv_id", "turn", "ref", "hyp")
