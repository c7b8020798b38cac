"""Sinks: reports as JSON, assessment texts, and metadata without bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.report import PART_KEYS
from riskframe.schemas import CONTENT_COLUMNS


def write_reports(reports: DataFrame, parts: DataFrame, path: str, key: str = "report_id") -> None:
    """A folder for each project: report headers and their parts as JSON lines, in order within a report."""
    headers = reports.withColumn("kind", F.lit("header")).withColumn("part_no", F.lit(-1).cast("bigint"))
    body = parts.join(reports.select(key, "project_id"), key)
    rows = headers.select("project_id", key, "part_no", F.to_json(F.struct(*headers.columns)).alias("json")).unionByName(
        body.select("project_id", key, F.col("part_no").cast("bigint"), F.to_json(F.struct(*body.columns)).alias("json"))
    )
    rows.repartition("project_id", key).sortWithinPartitions("project_id", key, "part_no").write.partitionBy("project_id").json(path)


def write_assessments(payload: DataFrame, path: str, key: str = "report_id") -> None:
    """The parts of each text with script id and status code, in order within a report."""
    rows = payload.select(key, "script_id", "status_code", *PART_KEYS, "assessment")
    rows.repartition(key).sortWithinPartitions(key, *PART_KEYS).write.json(path)


def write_metadata(df: DataFrame, path: str, by: str | None = None) -> None:
    """Append rows to a metadata table; a column with content is an error, since content must not stay."""
    bodies = sorted(set(df.columns) & set(CONTENT_COLUMNS))
    if bodies:
        raise ValueError(f"metadata must not hold {', '.join(bodies)}")
    out = df.write.mode("append")
    (out.partitionBy(by) if by else out).parquet(path)
