"""Word models of native prosody: fitting, distances, classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soripark import tables as t

FULL_FROM = 12


def moments(vectors: DataFrame, by: list[str]) -> DataFrame:
    """n, mean and sample deviation (at least 1e-8) of each of the 12 values, by partial sums; one row: no deviation."""
    per = vectors.select(*by, F.posexplode("v").alias("d", "x")).groupBy(*by, "d").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    rows = per.groupBy(*by).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("d", "m", "s"))).alias("x"))
    std = F.transform("x", lambda e: F.when(F.isnan(e["s"]), F.lit(None)).otherwise(F.greatest(e["s"], F.lit(1e-8))))
    return rows.select(*by, "n", F.transform("x", lambda e: e["m"]).alias("mean"), std.alias("std"))


def fit(vectors: DataFrame, by: list[str], full_from: int = FULL_FROM) -> DataFrame:
    """``moments`` with the mode and, from 12 vectors on, the inverse of the shrunk covariance.

    The covariance needs sums of x and of products, and the shrinkage of squares' products: all are
    summed on the executors a partition at a time, so a hot word is no large group.
    """
    base = moments(vectors, by)
    width = len(t.DIMS)
    centred = vectors.join(base.select(*by, "mean"), by).select(*by, F.zip_with("v", "mean", lambda a, b: a - b).alias("x"))

    def sums(batches):
        for pdf in batches:
            out = []
            for key, rows in pdf.groupby(by, dropna=False):
                x = np.stack(rows["x"].to_numpy())
                out.append((*key, len(x), (x.T @ x).ravel().tolist(), ((x**2).T @ (x**2)).ravel().tolist()))
            yield pd.DataFrame(out, columns=[*by, "n", "xx", "qq"])

    kinds = dict(vectors.dtypes)
    parts = centred.mapInPandas(sums, ", ".join(f"{b} {kinds[b]}" for b in by) + ", n long, xx array<double>, qq array<double>")
    cells = parts.select(*by, F.posexplode(F.arrays_zip("xx", "qq")).alias("i", "c")).groupBy(*by, "i").agg(F.sum("c.xx").alias("xx"), F.sum("c.qq").alias("qq"))
    packed = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "xx", "qq"))).alias("cells"))

    @F.pandas_udf("array<double>")
    def inverse(n: pd.Series, cells: pd.Series) -> pd.Series:
        return pd.Series([_shrunk(int(a), np.array([(c["xx"], c["qq"]) for c in b]), width) for a, b in zip(n, cells)])

    rows = base.join(packed, by).withColumn("cov_inv", F.when(F.col("n") >= full_from, inverse("n", "cells"))).drop("cells")
    return rows.withColumn("mode", F.when(F.col("cov_inv").isNotNull(), "full_shrunk").otherwise("diagonal"))


def _shrunk(n: int, cells: np.ndarray, width: int) -> list[float] | None:
    sample, fourth = (cells[:, i].reshape(width, width) / n for i in (0, 1))
    mu = np.trace(sample) / width
    spread = ((sample - mu * np.eye(width)) ** 2).sum() / width
    noise = (fourth - sample**2).sum() / (n * width)
    weight = 0.0 if spread == 0 else min(noise, spread) / spread
    try:
        return np.linalg.inv((1 - weight) * sample + weight * mu * np.eye(width)).ravel().tolist()
    except np.linalg.LinAlgError:
        return None


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scored(vectors: DataFrame, models: DataFrame, by: list[str], inside: float = 2.5) -> DataFrame:
    """Distance of each vector to its word's model, z of each value, whether inside, and the classes."""
    rows = vectors.join(models, by)
    d = F.zip_with("v", "mean", lambda a, b: a - b)
    z = F.zip_with(d, "std", lambda a, b: F.try_divide(a, b))
    width = len(t.DIMS)
    full = _dot(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: _dot(F.slice("cov_inv", i * width + 1, width), F.col("d"))), F.col("d"))
    diagonal = _dot(F.col("z"), F.col("z"))
    rows = rows.withColumns({"d": d, "z": z}).withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), F.when(F.col("mode") == "full_shrunk", full).otherwise(diagonal))))
    return rows.withColumns({"inside": F.col("distance") <= inside, "classes": classes(F.col("z"))}).drop("d")


def classes(z: Column) -> Column:
    """Names of what is off, by z of slope, range, last syllable, duration and voicing."""
    of = lambda name: F.get(z, F.lit(t.DIMS.index(name)))
    rules = {
        "rising 과도": of("f0_slope") > 2, "falling 과도": of("f0_slope") < -2, "억양 평탄": (F.abs(of("f0_slope")) < 0.5) & (of("f0_range") < -2),
        "마지막 음절 elongation": of("last_syl_ratio") > 2, "어절 전체 느림": of("duration") > 2, "voiced 비율 낮음": of("voiced_ratio") < -2,
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))


def sentence_verdict(words: DataFrame, by: list[str]) -> DataFrame:
    """Mean distance over a rendering's words: natural below 1.5, borderline below 2.5, else unnatural."""
    mean = words.groupBy(*by).agg(F.avg("distance").alias("avg_distance"), F.count("*").alias("n_words"))
    return mean.withColumn("verdict", F.when(F.col("avg_distance") < 1.5, "natural").when(F.col("avg_distance") < 2.5, "borderline").otherwise("unnatural"))


def quality(models: DataFrame, by: list[str]) -> DataFrame:
    """mode, n and, with too few samples for a full covariance, a warning for each word model (``by``, n)."""
    few = F.col("n") < FULL_FROM
    return models.select(*by, F.when(few, "diagonal").otherwise("full").alias("mode"), "n", F.when(few, F.concat(F.lit("n="), F.col("n").cast("string"), F.lit(f" < {FULL_FROM}: diagonal"))).alias("warning"))
