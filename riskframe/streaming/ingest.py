"""Continuous ingest: submissions to scenes, findings and report summaries, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.access import latest_jobs
from riskframe.operators.classify import keyword_findings
from riskframe.operators.enrich import validate_findings
from riskframe.operators.report import risk_summary
from riskframe.operators.segment import split_scenes
from riskframe.streaming import machines, published


def first_submissions(stream: DataFrame, horizon: str) -> DataFrame:
    """Each idempotency key once within the horizon; rows without a key always pass."""
    rows = stream.withWatermark("ts", horizon)
    blank = F.coalesce("idempotency_key", F.lit("")) == ""
    return rows.where(~blank).dropDuplicatesWithinWatermark(["idempotency_key"]).unionByName(rows.where(blank))


def answered_submissions(stream: DataFrame, horizon_hours: int, delay: str = "10 minutes", settle: bool = True) -> DataFrame:
    """(idempotency_key, submission_id, job_id, is_new): later submissions of a key are answered with the first one's job.

    A key is kept for ``horizon_hours`` after its last submission. Submissions without a key are new ones; they go past the state."""
    horizon_ms = horizon_hours * 3_600_000

    def step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
        job = row["submission_id"] if state is None else state["job"]
        return {"job": job, "until": row["ms"] + horizon_ms}, [{"submission_id": row["submission_id"], "job_id": job, "is_new": state is None}]

    rows = stream.select("ts", F.col("submission_id").cast("string").alias("submission_id"), F.nullif(F.col("idempotency_key"), F.lit("")).alias("idempotency_key"))
    out = "idempotency_key string, submission_id string, job_id string, is_new boolean"
    if stream.isStreaming:
        answered = machines.stream(rows, "idempotency_key", ["submission_id"], ["submission_id"], "job string, until long", out, step, delay=delay, settle=settle)
    else:
        answered = machines.batch(rows, "idempotency_key", ["submission_id"], ["submission_id"], out, step)
    free = rows.where("idempotency_key IS NULL").select("idempotency_key", "submission_id", F.col("submission_id").alias("job_id"), F.lit(True).alias("is_new"))
    return answered.unionByName(free)


def findings_of(scripts: DataFrame, lexicon: DataFrame, risk_class: DataFrame, measure: DataFrame, measure_applies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenes, findings) of scripts (report_id, full_text): segment, find terms, score, classify, attach measures."""
    scenes = split_scenes(scripts).withColumnRenamed("block_index", "scene_ix")
    raw = keyword_findings(scenes, lexicon, ["report_id", "scene_ix"])
    none = lambda kind: F.lit(None).cast(kind)
    raw = raw.withColumns({"rule_id": none("string"), "category": none("string"), "confidence": none("double"), "measure_codes": none("array<string>"), "finding_ix": F.xxhash64("risk_class")})
    return scenes, validate_findings(raw, risk_class, measure, measure_applies)


def run_ingest(stream: DataFrame, folder: str, lexicon: DataFrame, risk_class: DataFrame, measure: DataFrame, measure_applies: DataFrame):
    """A query that publishes scenes, findings and summaries below ``folder``, all tables of a micro-batch at once.

    The scenes and findings of a batch are made once: the summaries are made of the findings that were written. Readers go by
    :func:`published.read`, so a batch that failed between two tables isn't seen, and one that is run again is seen once."""

    def write(batch: DataFrame, number: int) -> None:
        def tables(attempt: published.Attempt) -> None:
            rows = attempt.write("submissions", batch.select("report_id", "full_text"), keep=False)
            scenes, findings = findings_of(rows, lexicon, risk_class, measure, measure_applies)
            attempt.write("scenes", scenes)
            found = attempt.write("findings", findings)
            attempt.write("reports", risk_summary(found, rows.select("report_id")).drop("other_levels"))

        published.publish(batch.sparkSession, folder, number, tables)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def job_states(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The latest state of every job, for update mode; late events with an older time change nothing."""
    return latest_jobs(events, order or ["ts"])
