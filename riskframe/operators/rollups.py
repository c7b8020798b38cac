"""Operational roll-ups: plain partial and final aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.limits import ACCEPTANCE_LIMIT_S


def percent(c: Column) -> Column:
    return F.rtrim(F.trim(c), F.lit("%")).try_cast("double")


def metric_rollup(samples: DataFrame, key: str = "container") -> DataFrame:
    """Peak and mean CPU and memory percent per container; unreadable values are skipped,
    a container without any readable value is left out."""
    cpu, mem = percent(F.col("cpu_pct")), percent(F.col("mem_pct"))
    return (
        samples.groupBy(key)
        .agg(
            F.coalesce(F.max(cpu), F.lit(0.0)).alias("cpu_peak_pct"),
            F.coalesce(F.avg(cpu), F.lit(0.0)).alias("cpu_avg_pct"),
            F.coalesce(F.max(mem), F.lit(0.0)).alias("mem_peak_pct"),
            F.coalesce(F.avg(mem), F.lit(0.0)).alias("mem_avg_pct"),
            F.greatest(F.count(cpu), F.count(mem)).alias("samples"),
        )
        .where("samples > 0")
    )


def acceptance(runs: DataFrame, limit_s: int = ACCEPTANCE_LIMIT_S) -> DataFrame:
    """``passed`` per run: completed, within the time limit and with findings."""
    return runs.withColumn(
        "passed",
        (F.col("status") == "completed")
        & (F.col("elapsed_s") > 0)
        & (F.col("elapsed_s") < limit_s)
        & (F.col("total_findings") > 0),
    )


def key_usage(requests: DataFrame) -> DataFrame:
    """Accepted requests and last use per user of a key."""
    return (
        requests.where("auth = 'ok'")
        .groupBy("auth_user")
        .agg(F.count("*").alias("usage_count"), F.max("ts").alias("last_used_at"))
    )


def audit_summary(log: DataFrame, percentile: float = 0.95) -> DataFrame:
    """Requests, errors and times by endpoint, status and day."""
    return log.groupBy("endpoint", "status_code", "day").agg(
        F.count("*").alias("requests"),
        F.countDistinct("user_id").alias("users"),
        F.max("duration_ms").alias("max_ms"),
        F.percentile_approx("duration_ms", percentile, 10_000).alias("p95_ms"),
    )


def risk_by_class(findings: DataFrame) -> DataFrame:
    """Corpus view: findings, reports and levels by category and class."""
    return findings.groupBy("category", "risk_class").agg(
        F.count("*").alias("findings"),
        F.countDistinct("report_id").alias("reports"),
        F.count_if(F.col("risk_level").isin("critical", "high")).alias("severe"),
        F.max(F.col("likelihood") * F.col("impact")).alias("max_score"),
    )
