"""Exact quantiles of groups of any size by nested histograms.

A double's bits, turned so that they rise with the value, are a whole number.  Each
level counts the values of every group by their next few bits, only within the
bins that hold a rank in demand, and so finds the bin a level finer; at the last level a
bin is one value.  Counts are added up before they are shuffled, so no task ever
holds a group's values: it holds at most the bins of a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soripark.sources.shared import staged

#: Low bits left open by each level: 2**16 bins at the first (sign, exponent, four bits of the fraction), 2**12 at each of the others.
LEVELS = (48, 36, 24, 12, 0)
#: Ranks in demand, of all groups together, that are sent to every task; more are joined by shuffle.
BROADCAST_RANKS = 100_000


def rising_bits(value: Column) -> Column:
    """A long that orders as the doubles do; NaN is last, as in Spark's own order."""
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double")).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def _same(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def order_statistics(values: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """``ranks`` (``by``, rank from 0) with the value at that rank of its group; ``values``: ``by``, value, n (how often).

    Groups are compared null-safe, so a null key is a group.  A rank beyond its group's last has no row.
    """
    coded = staged(values.select(*by, "value", "n", rising_bits(F.col("value")).alias("bits")), "quantiles")
    open_ = staged(ranks.select(*by, "rank").distinct().withColumns({"bin": F.lit(None).cast("long"), "left": F.col("rank")}), "quantiles")
    total = open_.count()
    for level, low in enumerate(LEVELS):
        asked = open_.select(*by, "bin").distinct()
        asked = F.broadcast(asked) if total <= BROADCAST_RANKS else asked
        outer = F.shiftright("bits", LEVELS[level - 1]) if level else F.lit(None).cast("long")
        rows = coded.withColumn("bin", outer)
        held = rows.alias("a").join(asked.alias("b"), _same([*by, "bin"], "a", "b"), "left_semi")
        counts = held.groupBy(*by, "bin", F.shiftright("bits", low).alias("inner")).agg(F.sum("n").alias("n"), F.min("value").alias("value"))
        w = Window.partitionBy(*by, "bin").orderBy("inner")
        counts = counts.withColumn("before", F.sum("n").over(w) - F.col("n"))
        here = open_.alias("a").join(counts.alias("b"), _same([*by, "bin"], "a", "b") & (F.col("a.left") >= F.col("b.before")) & (F.col("a.left") < F.col("b.before") + F.col("b.n")))
        found = here.select(*(F.col(f"a.{k}").alias(k) for k in by), "a.rank", F.col("b.inner").alias("bin"), (F.col("a.left") - F.col("b.before")).alias("left"), F.col("b.value").alias("value"))
        if low == 0:
            return found.select(*by, "rank", "value")
        open_ = staged(found.drop("value"), "quantiles")
    raise AssertionError("the last level leaves no bit open")


def quantiles(values: DataFrame, by: list[str], shares: list[float], sizes: DataFrame) -> DataFrame:
    """``by`` and q, the quantiles of each group by linear interpolation between neighbours; ``sizes``: ``by``, count."""
    asked = sizes.select(*by, "count", F.posexplode(F.array(*map(F.lit, shares))).alias("i", "share"))
    place = F.col("share") * (F.col("count") - 1)
    asked = asked.where("count > 0").withColumns({"low": F.floor(place), "part": place - F.floor(place)}).withColumn("high", F.ceil(place))
    asked = staged(asked, "quantiles")
    ranks = asked.select(*by, F.col("low").alias("rank")).unionByName(asked.select(*by, F.col("high").alias("rank")))
    at = order_statistics(values, by, ranks)
    for name in ("low", "high"):
        found = at.select(*(F.col(k).alias(f"_{k}") for k in by), F.col("rank").alias(f"_{name}"), F.col("value").alias(f"{name}_value"))
        same = F.col(name) == F.col(f"_{name}")
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        asked = asked.join(found, same).drop(*(f"_{k}" for k in by), f"_{name}")
    value = F.when(F.col("part") == 0, F.col("low_value")).otherwise(F.col("low_value") + (F.col("high_value") - F.col("low_value")) * F.col("part"))
    return asked.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))), lambda x: x["v"]).alias("q"))
