"""Who may see what: keys, ownership, idempotency, one-shot reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.text import head


def authenticate(requests: DataFrame, api_keys: DataFrame, at: str = "ts") -> DataFrame:
    """Adds auth_user and ``auth``: ok, missing, unknown, inactive or expired."""
    keys = (
        api_keys.select(
            F.col("key_hash").alias("_hash"),
            F.col("user_id").alias("auth_user"),
            F.col("is_active").alias("_active"),
            F.col("expires_at").alias("_until"),
        )
    )
    hashed = requests.withColumn("_hash", F.sha2("token", 256))
    auth = (
        F.when(F.coalesce("token", F.lit("")) == "", "missing")
        .when(F.col("auth_user").isNull(), "unknown")
        .when(~F.col("_active"), "inactive")
        .when(F.col("_until") <= F.col(at), "expired")
        .otherwise("ok")
    )
    return (
        hashed.join(keys, "_hash", "left")
        .withColumn("auth", auth)
        .withColumn("auth_user", F.when(F.col("auth") == "ok", F.col("auth_user")))
        .drop("_hash", "_active", "_until")
    )


def authorise(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (job_id, user_id, actor_id) with ``access``: forbidden if the claimed actor
    is another user, not_found for absent and foreign jobs, else ok."""
    owned = jobs.select("job_id", F.col("user_id"), F.lit(True).alias("_owned"))
    return (
        requests.join(owned, ["job_id", "user_id"], "left")
        .withColumn(
            "access",
            F.when(F.coalesce("actor_id", F.lit("")).isin("") | (F.col("actor_id") == F.col("user_id")),
                   F.when(F.col("_owned"), "ok").otherwise("not_found")).otherwise("forbidden"),
        )
        .drop("_owned")
    )


def resolve_idempotent(submissions: DataFrame, jobs: DataFrame, order: list[str]) -> DataFrame:
    """Adds job_id (the job that answers the submission) and is_new.

    A key that is stored, or that an earlier submission of the batch carries, is answered
    with that job. NULL and empty keys are always new. ``submission_id`` becomes the id of
    a new job, so a task that runs twice gives the same id. The winner per key is a partial
    aggregate; rows without a key never meet in one task.
    """
    key = F.nullif(F.col("idempotency_key"), F.lit(""))
    keyed = submissions.withColumn("_key", key)
    first = (
        keyed.where("_key IS NOT NULL")
        .groupBy("_key")
        .agg(F.min(F.struct(*order, "submission_id"))["submission_id"].alias("_first"))
    )
    stored = jobs.where(F.coalesce("idempotency_key", F.lit("")) != "").select(
        F.col("idempotency_key").alias("_key"), F.col("job_id").alias("_stored")
    )
    verdict = first.join(stored, "_key", "left")
    with_key = keyed.where("_key IS NOT NULL").join(verdict, "_key", "left")
    without = keyed.where("_key IS NULL").withColumns(
        {"_first": F.col("submission_id"), "_stored": F.lit(None).cast("string")}
    )
    return (
        with_key.unionByName(without)
        .withColumn("job_id", F.coalesce(F.col("_stored"), F.col("_first").cast("string")))
        .withColumn("is_new", F.col("_stored").isNull() & (F.col("_first") == F.col("submission_id")))
        .drop("_key", "_first", "_stored")
    )


def retrieval_outcomes(requests: DataFrame, meta: DataFrame) -> DataFrame:
    """Requests (request_id, ts, report_id, user_id) with ``outcome``: not_found for unknown
    and foreign reports, served for the first request of the owner, expired if that first
    request came after the body was gone, gone for all later ones.

    ``meta`` may say that a report was read before (``is_retrieved``).
    """
    owned = meta.select("report_id", "user_id", F.col("is_retrieved").alias("_read"), F.col("expires_at").alias("_until"))
    first = requests.groupBy("report_id", "user_id").agg(F.min(F.struct("ts", "request_id")).alias("_f"))
    verdict = first.join(owned, ["report_id", "user_id"]).select(
        "report_id", "user_id", "_read", "_until", F.col("_f.request_id").alias("_first")
    )
    outcome = (
        F.when(F.col("_first").isNull(), "not_found")
        .when(F.col("_read") | (F.col("_first") != F.col("request_id")), "gone")
        .when(F.col("_until") <= F.col("ts"), "expired")
        .otherwise("served")
    )
    return (
        requests.join(verdict, ["report_id", "user_id"], "left")
        .withColumn("outcome", outcome)
        .drop("_first", "_read", "_until")
    )


def latest_jobs(events: DataFrame, order: list[str], max_error_chars: int | None = None) -> DataFrame:
    """One row per job: status of the latest event; progress, error and report of the
    latest event that set them. A late event with an older time changes nothing."""
    at = F.struct(*order)

    def latest(c: Column) -> Column:
        return F.max(F.when(c.isNotNull(), F.struct(at.alias("at"), c.alias("v"))))["v"]

    return events.groupBy("job_id").agg(
        latest(F.col("status")).alias("status"),
        latest(F.col("progress")).cast("int").alias("progress_percentage"),
        head(latest(F.col("error")), max_error_chars).alias("error_message"),
        F.max(order[0]).alias("updated_at"),
        F.count("*").alias("n_events"),
    )


def complete_jobs(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs with a report become completed, 100 %, with the report id."""
    done = reports.select("job_id", F.col("report_id").alias("_r"))
    has = F.col("_r").isNotNull()
    return (
        jobs.join(done, "job_id", "left")
        .withColumn("status", F.when(has, "completed").otherwise(F.col("status")))
        .withColumn("progress_percentage", F.when(has, 100).otherwise(F.col("progress_percentage")).cast("int"))
        .withColumn("report_id", F.coalesce("_r", "report_id"))
        .drop("_r")
    )
