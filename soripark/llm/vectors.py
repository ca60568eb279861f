"""Rows and shards of vector tables for the two searches.

Vectors are dealt to shards by a hash of their id, so a shard's size is bounded
whatever the data: many equal vectors spread like any others.  Queries meet every
shard of their dimension, block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2048


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    x = vector
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite, F.lit(False))


def dealt(vectors: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """``vectors`` (vec_id, v) with ``dim`` and ``shard``, and the number of shards."""
    n = max(1, math.ceil(vectors.count() / shard_rows))
    return vectors.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")), n


def searched(pages: DataFrame, queries: DataFrame, n_shards: int, search, schema: str) -> DataFrame:
    """Each block of queries (query_id, v) against each shard's pages, by ``search(pages, queries)`` in pandas."""
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    spread = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = (
        queries.withColumn("dim", F.size("v"))
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    )
    key = ["dim", "shard", "block"]
    return spread.groupBy(key).cogroup(asked.groupBy(key)).applyInPandas(search, schema)


def nearest(found: DataFrame, k: int, score_order: Column) -> DataFrame:
    """The k best rows a query over all shards, ties to the smaller vec_id."""
    w = Window.partitionBy("query_id").orderBy(score_order, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column: pd.Series, dtype=np.float64) -> np.ndarray:
    return np.stack([np.asarray(x, dtype) for x in column]) if len(column) else np.zeros((0, 0), dtype)
