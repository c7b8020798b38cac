"""Roll-ups that can be merged: counts, and sketches of distinct users and of times, kept for each day.

A day's rows are read once. Its sketches are small binaries (HyperLogLog for distinct counts, KLL for quantiles),
so any later period is a merge of days, without their rows. Errors are those of the sketches: distinct counts
within about 1.6 % (2 standard errors at ``HLL_LOG2`` 14), ranks of quantiles within about 0.4 % (``KLL_K`` 800).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HLL_LOG2, KLL_K = 14, 800


def daily(log: DataFrame, by: list[str], day: str = "day", user: str = "user_id", value: str = "duration_ms") -> DataFrame:
    """One row for each group and day: ``n``, ``most`` and the sketches ``users`` and ``values``."""
    return log.groupBy(*by, day).agg(
        F.count("*").alias("n"), F.max(value).alias("most"), F.hll_sketch_agg(user, HLL_LOG2).alias("users"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("values"))


def merged(days: DataFrame, by: list[str]) -> DataFrame:
    """Days of any kind (also merges themselves) put together for each group of ``by``."""
    return days.groupBy(*by).agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("values", KLL_K).alias("values"))


def quantile(values: Column, rank: float) -> Column:
    return F.kll_sketch_get_quantile_double(values, F.lit(rank))


def told(days: DataFrame, by: list[str], ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """What the sketches say: requests, users (about), max_ms, and a quantile (about) for each rank, p50_ms, p95_ms, ..."""
    quantiles = [quantile(F.col("values"), r).alias(f"p{round(r * 100)}_ms") for r in ranks]
    return days.select(*by, F.col("n").alias("requests"), F.hll_sketch_estimate("users").alias("users"), F.col("most").alias("max_ms"), *quantiles)
