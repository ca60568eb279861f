"""Sums over ranges of ordered points by running sums: a range costs two look-ups, however many points it holds and ranges overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_sums(points: DataFrame, ranges: DataFrame, by: list[str], at: str, key: list[str], sums: dict[str, Column], low: str = "low", high: str = "high") -> DataFrame:
    """``by``, ``key``, n_before (points before the range), n_points and the ``sums`` of the points with low <= at < high.

    ``points``: ``by``, ``at`` and what ``sums`` are made of (null counts as 0); ``ranges``: ``by``, ``key`` (unique within ``by``),
    ``low`` and ``high``; one with high <= low is empty.  Points and ends of ranges meet in one order a group
    of ``by``; equal places: ends come before points.  Whole numbers sum exactly; sums of doubles are differences of running
    sums.  A group without points has zeros; null ends, no row.
    """
    names = list(sums)
    kind = points.schema[at].dataType
    values = points.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_point"), *(F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()))
    numbers = {f.name: f.dataType for f in values.schema}
    ends = F.explode(F.array(F.struct(F.col(low).cast(kind).alias("_at"), F.lit(-1).alias("_sign")), F.struct(F.greatest(low, high).cast(kind).alias("_at"), F.lit(1).alias("_sign"))))
    borders = ranges.where(F.col(low).isNotNull() & F.col(high).isNotNull()).select(*by, *key, ends.alias("_end")).select(*by, *key, "_end._at", "_end._sign", F.lit(0).alias("_point"))
    nothing = {k: F.lit(None).cast(borders.schema[k].dataType) for k in key} | {"_sign": F.lit(None).cast("int")}
    both = values.withColumns(nothing).unionByName(borders.withColumns({n: F.lit(0).cast(numbers[n]) for n in names}))
    return between(both, by, key, names)


def between(both: DataFrame, by: list[str], key: list[str], names: list[str]) -> DataFrame:
    """The sums of ``range_sums`` from points (_point 1, with their ``names``) and ends of ranges (_point 0, with ``key`` and _sign -1 or 1) in one table."""
    w = Window.partitionBy(*by).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumns({"_n": F.sum("_point").over(w)} | {n: F.sum(n).over(w) for n in names}).where("_point = 0")
    total = [F.sum(F.col("_sign") * F.col(n)).alias(n) for n in names]
    return run.groupBy(*by, *key).agg(F.min("_n").alias("n_before"), F.sum(F.col("_sign") * F.col("_n")).alias("n_points"), *total)


def span_means(points: DataFrame, spans: DataFrame, by: list[str], at: str, key: list[str], value: str, where: str, low: str = "t0", high: str = "t1") -> DataFrame:
    """``by``, ``key``, n_points, n (points of ``where`` in the span) and the mean of their ``value``; null without one."""
    own = F.col(where)
    out = range_sums(points, spans, by, at, key, {"n": own.cast("long"), "total": F.when(own, F.col(value))}, low, high)
    return out.select(*by, *key, "n_points", "n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"))
