"""Reading and writing evaluation records, calibration tables, cards and word models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTIFACT = (
    "status string, evaluation_status string, gates struct<alignment_confidence_gate: struct<performed: boolean, passed: boolean>>, "
    "alignment struct<forced: struct<segments: array<struct<token: string, label: string, start_time: double, end_time: double, frame_start: int, frame_end: int, confidence: double>>>>, _corrupt_record string"
)


def read_artifacts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Every *.json under a folder, a record a file or (``lines``, as ``write_artifacts`` makes them) a line; broken ones are skipped; the three shapes of status become one."""
    rows = spark.read.schema(ARTIFACT).option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").select(_status().alias("status"), "gates", "alignment")


def _status(of: str = "") -> Column:
    """struct<evaluation_status> from the three shapes: a struct, a plain string, a field of its own."""
    status, own = (F.col(f"{of}.{c}" if of else c) for c in ("status", "evaluation_status"))
    nested = F.from_json(status, "evaluation_status string")["evaluation_status"]
    return F.struct(F.coalesce(F.when(status.startswith("{"), nested).otherwise(status), own).alias("evaluation_status"))


def write_artifacts(records: DataFrame, path: str, by: str | None = None, replace: bool = False) -> None:
    """Nested records as JSON lines, a folder a value of ``by``; not a file a record.

    Records of one value of ``by`` go through one task to one file.  A store that exists already is an error, unless
    ``replace``: then the folders of the values at hand are written anew, and all others stay.
    """
    if by is None:
        records.write.mode("overwrite" if replace else "errorifexists").json(path)
        return
    writer = records.repartition(by).write.partitionBy(by)
    (writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if replace else writer.mode("errorifexists")).json(path)


def scan_artifacts(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Every record of a store, good or broken: status, gates, alignment, the folder's column (as ``write_artifacts`` made it), file and broken (the raw text, else null).

    A filter on the folder's column leaves the other folders unread.  Records are JSON lines, or whole files without ``lines``.
    """
    rows = spark.read.option("wholetext", not lines).text(path).withColumn("file", F.col("_metadata.file_path")).where(F.trim("value") != "")
    parsed = rows.withColumn("r", F.from_json("value", ARTIFACT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    folders = [c for c in rows.columns if c not in ("value", "file")]
    return parsed.select(_status("r").alias("status"), "r.gates", "r.alignment", *folders, "file", F.when(bad, F.col("value")).alias("broken"))


def quarantine(scanned: DataFrame, path: str) -> DataFrame:
    """Writes the broken records of ``scan_artifacts`` with their files as JSON lines, and returns how many each file has."""
    scanned.where("broken is not null").select("file", "broken").write.mode("overwrite").json(path)
    kept = scanned.sparkSession.read.schema("file string, broken string").json(path)
    return kept.groupBy("file").agg(F.count("*").alias("n_broken"))


def write_calibration(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def load_calibration(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none yet; a folder without the threshold columns is an error."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    table = spark.read.parquet(path)
    missing = {"token", "calibrated_low_threshold", "calibrated_very_low_threshold"} - set(table.columns)
    if missing:
        raise ValueError(f"not a calibration table, it lacks {sorted(missing)}")
    return table


CARDS = "array<struct<id: string, type: string, unit: int, grade: string, puzzles: array<struct<id: string, answer: array<string>>>>>"


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards of a JSON array file in file order."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.from_json("value", CARDS)).alias("pos", "c"))
    return rows.select("pos", "c.*")


DISTRIBUTIONS = "sentences map<string, struct<eojeols: array<struct<text: string, mean: array<double>, std: array<double>, cov_inv: array<array<double>>, mode: string, n: int, syllable_contours: array<array<double>>>>>>"


#: Sentences that a row of the store holds, about.
SHARD_SENTENCES = 1000


def read_distributions(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """One row a sentence's word from the nested store: a map a line, or (without ``lines``) one map a file, over any number of lines of text."""
    rows = spark.read.schema(DISTRIBUTIONS).option("multiLine", not lines).json(path).select(F.explode("sentences").alias("text", "s"))
    return rows.select("text", F.posexplode("s.eojeols").alias("eojeol_idx", "e")).select("text", "eojeol_idx", F.col("e.text").alias("eojeol"), "e.mean", "e.std", "e.cov_inv", "e.mode", "e.n", "e.syllable_contours")


def write_distributions(words: DataFrame, path: str, shards: int | None = None) -> None:
    """The reverse of ``read_distributions``: sentences are dealt out by a hash of their text to ``shards`` files of one map each.

    Without a number, a file for each ``SHARD_SENTENCES`` sentences; so no task, row or file holds them all.
    """
    columns = ["mean", "std", "cov_inv", "mode", "n", "syllable_contours"]
    entry = F.struct("eojeol_idx", F.struct(F.col("eojeol").alias("text"), *columns).alias("e"))
    if shards is None:
        shards = words.select("text").distinct().count() // SHARD_SENTENCES + 1
    sentences = words.groupBy("text").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("eojeols"))
    dealt = sentences.groupBy(F.pmod(F.xxhash64("text"), F.lit(shards)).alias("shard")).agg(F.map_from_entries(F.collect_list(F.struct("text", F.struct("eojeols")))).alias("sentences"))
    dealt.repartition(shards, "shard").select("sentences").write.mode("errorifexists").json(path)


def nested(cov_inv: Column, width: int) -> Column:
    """A flat square matrix as rows, as the store holds it."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.slice(cov_inv, i * width + 1, width))
