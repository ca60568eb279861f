"""Tables written once to the folder that all executors share, and read from there: short lineage, nothing lost with an executor."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, which holds for one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage, on which Spark deletes the shuffle files of jobs that have ended; else these stay on disk beside those of the next ones."""
    gc.collect()
    time.sleep(0.3)  # until the events of the last job, which still name its plan, are through
    spark._jvm.System.gc()


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    drop_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
