"""Gap evidence from frames that segments make: the same as from a table of frames, with only segments shuffled."""

import random

from pyspark.sql import functions as F

from soripark import bridge
from soripark.operators import calibration, quality


def lineitem(spark, path):
    rng = random.Random(6)
    rows = []
    for order in range(60):
        for line in range(rng.randint(1, 6)):
            rows.append((order, line, rng.randrange(200), 1, float(rng.choice([0, 1, 7, 50])), 9.5, rng.choice([0.0, 0.03, 0.08, None if order == 7 else 0.01]), rng.choice([0.0, 0.02, 0.1]), "N", "1995-01-01"))
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_discount double, l_returnflag string, l_shipdate string"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_frames_as_an_array_equal_a_table_of_frames(spark, tmp_path):
    d = lineitem(spark, tmp_path)
    segs = bridge.segments(spark, d)
    want = quality.gap_evidence(segs, bridge.frames(spark, d))
    got = quality.gap_evidence(segs, bridge.segment_frames())
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 100
    # the timing summary of segments that carry their pauses equals the one that joins them
    th = calibration.with_thresholds(segs, None)
    joined = quality.timing_summary(th, want)
    carried = quality.timing_summary(quality.with_pauses(th, bridge.segment_frames(), ["start_time", "end_time", "confidence", "low_threshold", "very_low_threshold"]))
    assert sorted(map(repr, carried.select(joined.columns).collect())) == sorted(map(repr, joined.collect())) and joined.count() == 60


def test_frames_are_not_shuffled(spark, tmp_path):
    """One exchange, of the order lines; before, each frame was a row of another."""
    d = lineitem(spark, tmp_path)
    segs = bridge.segments(spark, d)
    rows = quality.with_pauses(calibration.with_thresholds(segs, None), bridge.segment_frames(), ["start_time", "end_time", "confidence", "low_threshold", "very_low_threshold"])
    for df in (quality.gap_evidence(segs, bridge.segment_frames()), quality.timing_summary(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1, plan
