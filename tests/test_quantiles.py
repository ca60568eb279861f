import numpy as np
import pytest
from pyspark.sql import functions as F

from soripark.operators import calibration, quantiles


def counted(rows):
    return rows.groupBy("g", "value").agg(F.count("*").alias("n"))


def test_bits_rise_with_the_value(spark):
    values = [float("-inf"), -1e300, -2.5, -5e-324, 0.0, 5e-324, 1e-300, 0.1, 0.1 + 2**-56, 1.0, 1.5, 1e300, float("inf"), float("nan")]
    got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", quantiles.rising_bits(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) == len(set(map(repr, values)))


@pytest.mark.parametrize("limit", [0, 10**6])
def test_quantiles_of_all_kinds_of_doubles(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "BROADCAST_RANKS", limit)
    rng = np.random.default_rng(3)
    groups = {
        "wide": rng.normal(0, 1, 3001) * 10.0 ** rng.integers(-300, 300, 3001), "close": 1 + rng.integers(0, 50, 999) * 2.0**-52, "one": np.array([7.25]), "two": np.array([1.0, 2.0]),
        "equal": np.full(500, -3.5), "signs": np.array([-0.0, 0.0, -1.0, 1.0, 5e-324, -5e-324]), None: rng.random(2000),
    }
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, value double").repartition(5)
    sizes = rows.groupBy("g").agg(F.count("*").alias("count"))
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in quantiles.quantiles(counted(rows), ["g"], shares, sizes).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        with np.errstate(over="ignore"):
            assert np.allclose(got[g], np.quantile(vs, shares), rtol=1e-12), g


def test_ranks_beyond_the_end_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, value double")
    asked = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0)], "g string, rank long")
    assert sorted(map(tuple, quantiles.order_statistics(counted(rows), ["g"], asked).collect())) == [("a", 0, 1.0), ("a", 1, 2.0)]
    assert quantiles.order_statistics(counted(rows.limit(0)), ["g"], asked).count() == 0


def test_both_ways_of_the_distribution_agree_and_no_task_holds_a_group(spark):
    n = 60_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("token"), (F.rand(5)).alias("confidence")).repartition(4)
    rows = spark.createDataFrame(rows.toPandas())  # all different, and the same in both runs
    direct, nested = (sorted(map(tuple, calibration.distribution(rows, most).collect()), key=repr) for most in (10**9, 0))
    assert [r[:2] for r in direct] == [r[:2] for r in nested] and len(direct) == 9
    for a, b in zip(direct, nested):
        assert np.allclose(a[2:], b[2:], rtol=1e-12)
    # what one task sees of a group after the counts are added up: the bins of a level, not its 60,000 values
    coded = rows.select(quantiles.rising_bits(F.col("confidence")).alias("bits"))
    assert coded.select(F.shiftright("bits", quantiles.LEVELS[0])).distinct().count() < 600
    for outer, inner in zip(quantiles.LEVELS, quantiles.LEVELS[1:]):
        assert coded.groupBy(F.shiftright("bits", outer)).agg(F.countDistinct(F.shiftright("bits", inner)).alias("k")).agg(F.max("k")).first()[0] <= 1 << (outer - inner)
