"""Small helpers shared by the operators: tables, shared storage, guarded broadcasts, text batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code point classes of the contracts' word pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that a task holds at a time on their way to Python and back.
TEXT_ROWS = 1000
#: A table of at most this many short rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a temporary one (one machine only)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return named.rstrip("/")


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` computed once, written to the shared folder and read from there: no lineage, and no loss with an executor.  A filter on column ``by`` reads its rows only."""
    path = f"{shared_folder(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what ``saved`` wrote for these tables; nothing may read them later."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(df: DataFrame) -> None:
    """Has the driver collect its garbage, on which Spark deletes the shuffle files of jobs that have ended; else these stay on disk beside those of the next ones."""
    gc.collect()
    time.sleep(0.3)  # until the events of the last job, which still name its plan, are through
    df.sparkSession._jvm.System.gc()


def whole_texts(df: DataFrame) -> SparkSession:
    """The session of a table of whole texts, set to send them to Python in batches of ``TEXT_ROWS`` rows unless it has a setting of its own."""
    spark, rows = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(TEXT_ROWS))
    return spark


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its known row count is within the limit; else as it is."""
    return F.broadcast(df) if rows <= limit else df


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text (0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % F.lit(n)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that what a task holds of whole texts at a time stays small."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def give_back() -> None:
    """Returns a Python worker's free memory to the system.  Workers live on and wait beside the tasks of later stages; without this each keeps the most it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, with ``give_back`` at a task's end, when all that ``run`` held is free."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole
