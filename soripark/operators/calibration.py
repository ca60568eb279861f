"""Per-token confidence thresholds from past evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soripark import tables as t
from soripark.operators.quantiles import quantiles
from soripark.sources.shared import staged

QUANTILES = {"p05": 0.05, "p10": 0.10, "p20": 0.20, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
#: Different (token, confidence) pairs up to which one task takes a group's quantiles.
MOST_VALUES = 200_000
#: Tokens of a calibration table that is sent to every task.
BROADCAST_TOKENS = 100_000


def token_confidences(artifacts: DataFrame, status: str = "ready", need_gate: bool = True) -> DataFrame:
    """token, confidence of every segment of ready artifacts whose alignment gate passed; null or empty tokens left out."""
    rows = artifacts.where(F.col("status.evaluation_status") == status)
    if need_gate:
        rows = rows.where(F.coalesce(F.col("gates.alignment_confidence_gate.passed"), F.lit(False)))
    seg = rows.select(F.explode("alignment.forced.segments").alias("s")).select("s.token", "s.confidence")
    return seg.where((F.col("token") != "") & F.col("confidence").isNotNull())


def _shares(total: Column) -> dict[str, Column]:
    """Mean and low rates over counted values (confidence, n)."""
    n, c = F.col("n"), F.col("confidence")
    below = lambda limit: F.sum(F.when(c < limit, n).otherwise(0)) / total
    return {"mean": F.sum(c * n) / total, "raw_very_low_rate": below(t.VERY_LOW), "raw_low_rate": below(t.LOW)}


def distribution(confidences: DataFrame, most_values: int = MOST_VALUES) -> DataFrame:
    """Count, mean, quantiles and low rates of each token, and of all (token null), in one pass.

    Equal confidences are counted before anything is shuffled by token, so a token
    with a third of all rows sends as many rows as it has different values.  Up to ``most_values`` different ones, of all
    tokens together, quantiles are taken from the counts of a group at once; of more, by ``quantiles``, so that
    no task holds a token's or all tokens' values.  Both ways are exact.
    """
    counted = staged(confidences.groupBy("token", "confidence").agg(F.count("*").alias("n")), "confidences")
    token, total = F.col("token"), F.sum("n")
    base = counted.groupingSets([[token], []], token)
    if counted.count() <= most_values:
        q = F.percentile(F.col("confidence"), F.array(*map(F.lit, QUANTILES.values())), F.col("n"))
        stats = base.agg(total.alias("count"), q.alias("q"), *(c.alias(k) for k, c in _shares(total).items()))
    else:
        sizes = staged(base.agg(total.alias("count"), *(c.alias(k) for k, c in _shares(total).items())), "confidences")
        values = counted.select(F.explode(F.array(F.col("token"), F.lit(None).cast("string"))).alias("token"), F.col("confidence").alias("value"), "n")
        found = quantiles(values, ["token"], list(QUANTILES.values()), sizes).withColumnRenamed("token", "_token")
        stats = sizes.join(found, F.col("token").eqNullSafe(F.col("_token")))
    return stats.select("token", "count", "mean", F.col("q")[4].alias("median"), *(F.col("q")[i].alias(name) for i, name in enumerate(QUANTILES)), "raw_very_low_rate", "raw_low_rate")


def thresholds(stats: DataFrame, min_count: int = t.TOKEN_MIN_COUNT) -> DataFrame:
    """Tokens with enough observations and their relaxed thresholds."""
    very_low = F.greatest(F.lit(t.VERY_LOW_FLOOR), F.least(F.lit(t.VERY_LOW), F.col("p10")))
    low = F.greatest(F.lit(t.LOW_FLOOR), F.least(F.lit(t.LOW), F.col("p25")))
    return stats.where(F.col("token").isNotNull() & (F.col("count") >= min_count)).withColumns({"calibrated_very_low_threshold": very_low, "calibrated_low_threshold": low})


def with_thresholds(segments: DataFrame, calibration: DataFrame | None) -> DataFrame:
    """``segments`` with low_threshold, very_low_threshold and their source; the table has a row a phone token."""
    raw = {"low_threshold": F.lit(t.LOW), "very_low_threshold": F.lit(t.VERY_LOW)}
    if calibration is None:
        return segments.withColumns(raw | {"threshold_source": F.lit("raw_default")})
    known = calibration.select("token", F.col("calibrated_low_threshold").alias("low_threshold"), F.col("calibrated_very_low_threshold").alias("very_low_threshold"), F.lit("token_calibration").alias("threshold_source"))
    known = staged(known, "thresholds")
    rows = segments.join(F.broadcast(known) if known.count() <= BROADCAST_TOKENS else known, "token", "left")
    return rows.withColumns({k: F.coalesce(k, v) for k, v in raw.items()} | {"threshold_source": F.coalesce("threshold_source", F.lit("calibration_global_fallback"))})


def summary(stats: DataFrame, min_count: int = t.TOKEN_MIN_COUNT) -> DataFrame:
    """Schema version, calibrated tokens, least count and observations."""
    used = F.col("token").isNotNull() & (F.col("count") >= min_count)
    return stats.agg(F.lit(1).alias("schema_version"), F.count_if(used).alias("token_count"), F.lit(min_count).alias("token_min_count"), F.max(F.when(F.col("token").isNull(), F.col("count"))).alias("artifact_token_count"))
