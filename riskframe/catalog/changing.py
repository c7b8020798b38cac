"""Tables that change, roll-ups that merge, and screening by many rules, over whole tables."""

from pyspark.sql import functions as F

from riskframe.catalog.governance import events
from riskframe.catalog.inputs import documents, table
from riskframe.catalog.registry import query
from riskframe.catalog.store import _NOW, STORE, _now, store
from riskframe.operators import screening, sketches
from riskframe.session import run_dir
from riskframe.sources.tables import KnowledgeStore, LatestTable

_STATUS = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"


@query(
    "j5_job_table",
    f"""WITH e AS (SELECT 'job ' || user_id AS job_id, ts, {_STATUS} AS status, CASE WHEN event_type = 'click' THEN CAST(event_id % 101 AS INTEGER) END AS progress, CASE WHEN event_type = 'error' THEN 'failed at ' || event_id END AS error FROM events)
SELECT job_id, arg_max(status, ts) FILTER (status IS NOT NULL) AS status, arg_max(progress, ts) FILTER (progress IS NOT NULL) AS progress, arg_max(error, ts) FILTER (error IS NOT NULL) AS error FROM e GROUP BY job_id""",
)
def job_table(spark, folder):
    """The state of each job, upserted from three batches of events in no order of time."""
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
    rows = events(spark, folder).select(
        F.concat(F.lit("job "), F.col("user_id").cast("string")).alias("job_id"), "ts", "event_id", status.alias("status"), F.when(F.col("event_type") == "click", F.col("event_id") % 101).cast("int").alias("progress"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("error"))
    jobs = LatestTable(spark, run_dir(spark, "jobs"), "job_id", {"status": "string", "progress": "int", "error": "string"}, buckets=8)
    for batch in (1, 2, 0):
        jobs.apply(rows.where(F.col("event_id") % 3 == batch))
    return jobs.read().select("job_id", "status", "progress", "error")


@query("d9_physical_purge", f"WITH {STORE} SELECT doc_id, tenant_id, count(*) AS chunks FROM kb JOIN chunk USING (doc_id) WHERE expires_at > {_NOW} AND NOT (tenant_id = 'en' AND list_contains(tags, 'src3')) GROUP BY ALL")
def physical_purge(spark, folder):
    """Documents and chunks on disk after the expired ones and a tenant's tagged ones were taken away."""
    docs, chunks = store(spark, folder)
    chunks = chunks.join(docs.select("doc_id", "tenant_id"), "doc_id")
    kept = KnowledgeStore(spark, run_dir(spark, "store"), docs.schema, chunks.schema, buckets=4)
    kept.add(docs, chunks)
    kept.purge_expired(_now())
    kept.remove_by_tag("en", "src3")
    left = kept.chunks.read().groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return kept.documents.read().select("doc_id", "tenant_id").join(left, "doc_id")


@query("e16_merged_days")
def merged_days(spark, folder):
    """Requests, distinct users and quantiles of the whole period from the days' sketches (held against exact figures in the tests)."""
    log = table(spark, folder, "events").select(F.col("event_type").alias("endpoint"), F.to_date("ts").alias("day"), "user_id", F.col("value").alias("duration_ms"))
    return sketches.told(sketches.merged(sketches.daily(log, ["endpoint"]), ["endpoint"]), ["endpoint"])


@query(
    "b10_many_rules",
    r"""WITH r AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS ord, regexp_extract(lower(text), '[a-z]{5,}') AS w FROM benchmark),
h AS (SELECT doc_id, ord FROM documents JOIN r ON w <> '' AND regexp_matches(lower(text), '(^|[ \n])' || w || '[a-z]*[.,]'))
SELECT doc_id, 'rule ' || min(ord) AS rule, coalesce(count(ord), 0) AS n_rules, count(ord) = 0 AS is_safe FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id""",
)
def many_rules(spark, folder):
    """A rule for each benchmark item, from its first long word."""
    word = F.regexp_extract(F.lower("text"), "[a-z]{5,}", 0)
    words = [r["w"] for r in table(spark, folder, "benchmark").orderBy("item_id").select(word.alias("w")).limit(screening.MOST_RULES).collect()]  # rules are broadcast, so many at most
    rules = [screening.Rule(f"rule {i}", rf"(^|[ \n]){w}[a-z]*[.,]", True, w) for i, w in enumerate(words) if w]
    return screening.screen(documents(spark, folder), rules).select("doc_id", "rule", F.size("rules").cast("long").alias("n_rules"), "is_safe")
