"""A corpus from raw documents: known language, no near copies, no repeated passages, mixed sources, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
one's rows as Parquet in the cluster's shared folder and reads them for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soripark.llm import jaccard_join, language_id, mixing, piece_encoding, substring_dedup
from soripark.llm.common import shared_folder, table

#: A document whose language is less probable than this, or that has no letter, is rejected.
LEAST_PROBABLE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts of no probable language; the model learns from all labelled rows."""
    judged = language_id.identify(docs, language_id.train(docs), into="__sp_language")
    kept = judged.where((F.col("__sp_language.lang_pred") != "und") & (F.col("__sp_language.score") >= LEAST_PROBABLE))
    return kept.select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least doc_id."""
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of windows that occur earlier; a text that loses nothing stays as it is, one that loses all goes."""
    cut = substring_dedup.without_repeats(docs, into="__sp_kept")
    changed = F.col("__sp_kept.n_removed") > 0
    rows = cut.where(~changed | (F.col("__sp_kept.n_removed") < F.col("__sp_kept.n_words")))
    text = F.when(changed, F.col("__sp_kept.text")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))})
    return rows.select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding the ids gives the text (space marks read as spaces)."""
    vocabulary = piece_encoding.load_vocabulary(piece_encoding.default_model_path())
    rows = piece_encoding.encode_checked(docs, vocabulary, into="__sp_pieces")
    ids = F.col("__sp_pieces.ids")
    return rows.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), F.col("__sp_pieces.round_trip").alias("round_trip"))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("mixing", mixed_sources),
    ("pieces", token_ids),
]

#: The first and last stages have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; rows of the last."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
