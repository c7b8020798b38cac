"""Requests, keys, jobs, deliveries and checks, from events, conversations, pages and documents."""

from pyspark.sql import functions as F

from riskframe.catalog.inputs import documents, strip_sql, table
from riskframe.catalog.registry import query
from riskframe.functions import network, text as texts
from riskframe.operators import access, rollups, validate
from riskframe.streaming import limits, state

_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def events(spark, folder):
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# --- jobs and requests ------------------------------------------------------------------------------

_STATUS = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"


@query(
    "f8_latest_jobs",
    f"""WITH e AS (SELECT user_id AS job_id, ts, event_id, {_STATUS} AS status, CASE WHEN event_type = 'click' THEN CAST(event_id % 101 AS INTEGER) END AS progress,
  CASE WHEN event_type = 'error' THEN 'failed at ' || event_id END AS error FROM events)
SELECT job_id, arg_max(status, (ts, event_id)) FILTER (status IS NOT NULL) AS status, arg_max(progress, (ts, event_id)) FILTER (progress IS NOT NULL) AS progress_percentage,
  arg_max(error, (ts, event_id)) FILTER (error IS NOT NULL) AS error_message, count(*) AS n_events FROM e GROUP BY job_id""",
)
def latest_jobs(spark, folder):
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
    rows = events(spark, folder).select(
        F.col("user_id").alias("job_id"), "ts", "event_id", status.alias("status"), F.when(F.col("event_type") == "click", F.col("event_id") % 101).alias("progress"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("error"))
    return access.latest_jobs(rows, ["ts", "event_id"]).drop("updated_at")


_KEYED = "keyed AS (SELECT event_id AS submission_id, ts, CASE WHEN event_id % 7 <> 0 THEN user_id || ':' || event_type END AS k FROM events)"


@query(
    "d8_idempotent_submissions",
    f"""WITH {_KEYED}, first AS (SELECT k, arg_min(submission_id, (ts, submission_id)) AS f FROM keyed WHERE k IS NOT NULL GROUP BY k)
SELECT submission_id, CASE WHEN k IS NULL THEN CAST(submission_id AS VARCHAR) WHEN k LIKE '1%' THEN 'job ' || k ELSE CAST(f AS VARCHAR) END AS job_id,
  k IS NULL OR (k NOT LIKE '1%' AND f = submission_id) AS is_new FROM keyed LEFT JOIN first USING (k)""",
)
def idempotent_submissions(spark, folder):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    rows = events(spark, folder).select(F.col("event_id").alias("submission_id"), "ts", F.when(F.col("event_id") % 7 != 0, key).alias("idempotency_key"))
    jobs = rows.where("idempotency_key LIKE '1%'").select("idempotency_key").distinct().withColumn("job_id", F.concat(F.lit("job "), "idempotency_key"))
    return access.resolve_idempotent(rows, jobs, ["ts"]).select("submission_id", "job_id", "is_new")


@query(
    "d12_retrievals",
    f"""WITH r AS (SELECT event_id AS request_id, ts, event_id * 7919 % (SELECT 2 * count(*) FROM documents) AS report_id, user_id % 3 AS user_id FROM events),
m AS (SELECT doc_id AS report_id, doc_id % 3 AS user_id, doc_id % 5 = 0 AS is_read, {_NOW} AS until FROM documents),
f AS (SELECT report_id, user_id, arg_min(request_id, (ts, request_id)) AS f FROM r GROUP BY 1, 2)
SELECT request_id, CASE WHEN m.report_id IS NULL THEN 'not_found' WHEN is_read OR f <> request_id THEN 'gone' WHEN until <= ts THEN 'expired' ELSE 'served' END AS outcome
FROM r JOIN f USING (report_id, user_id) LEFT JOIN m USING (report_id, user_id)""",
)
def retrievals(spark, folder):
    """Every document is a report; half of the requests are for reports that aren't there, and of the others a third come from the owner."""
    n = 2 * documents(spark, folder).count()
    requests = events(spark, folder).select(F.col("event_id").alias("request_id"), "ts", (F.col("event_id") * 7919 % n).alias("report_id"), (F.col("user_id") % 3).alias("user_id"))
    meta = documents(spark, folder).select(
        F.col("doc_id").alias("report_id"), (F.col("doc_id") % 3).alias("user_id"), (F.col("doc_id") % 5 == 0).alias("is_retrieved"), F.lit("2024-01-20 00:00:00").cast("timestamp").alias("expires_at"))
    return access.retrieval_outcomes(requests, meta).select("request_id", "outcome")


@query(
    "b7_authenticated_requests",
    f"""WITH k AS (SELECT DISTINCT user_id, user_id % 4 <> 0 AS active, CASE WHEN user_id % 5 = 0 THEN {_NOW} ELSE TIMESTAMP '2030-01-01 00:00:00' END AS until FROM events WHERE user_id % 6 <> 0)
SELECT event_id AS request_id, CASE WHEN e.event_type = 'view' THEN 'missing' WHEN k.user_id IS NULL THEN 'unknown' WHEN NOT active THEN 'inactive' WHEN until <= ts THEN 'expired' ELSE 'ok' END AS auth
FROM events e LEFT JOIN k USING (user_id)""",
)
def authenticated_requests(spark, folder):
    rows = events(spark, folder)
    token = F.concat(F.lit("token-"), F.col("user_id").cast("string"))
    keys = rows.where("user_id % 6 <> 0").select("user_id").distinct().select(
        F.sha2(token, 256).alias("key_hash"), "user_id", (F.col("user_id") % 4 != 0).alias("is_active"),
        F.when(F.col("user_id") % 5 == 0, F.lit("2024-01-20 00:00:00")).otherwise(F.lit("2030-01-01 00:00:00")).cast("timestamp").alias("expires_at"))
    asked = rows.select(F.col("event_id").alias("request_id"), "ts", F.when(F.col("event_type") != "view", token).alias("token"))
    return access.authenticate(asked, keys).select("request_id", "auth")


@query("e15_key_usage", "SELECT user_id AS auth_user, count(*) AS usage_count, max(ts) AS last_used_at FROM events WHERE event_type <> 'error' GROUP BY 1")
def key_usage(spark, folder):
    rows = table(spark, folder, "events").select(F.col("user_id").alias("auth_user"), "ts", F.when(F.col("event_type") != "error", "ok").otherwise("unknown").alias("auth"))
    return rollups.key_usage(rows)


@query("e16_audit_summary", "SELECT event_type AS endpoint, CAST(event_id % 3 * 100 + 200 AS INTEGER) AS status_code, CAST(ts AS DATE) AS day, count(*) AS requests, count(DISTINCT user_id) AS users, max(value) AS max_ms FROM events GROUP BY 1, 2, 3")
def audit_summary(spark, folder):
    log = table(spark, folder, "events").select(F.col("event_type").alias("endpoint"), (F.col("event_id") % 3 * 100 + 200).cast("int").alias("status_code"), F.to_date("ts").alias("day"), "user_id", F.col("value").alias("duration_ms"))
    return rollups.audit_summary(log).drop("p95_ms")


_SAMPLES = "s AS (SELECT 'c' || (user_id % 5) AS container, ts, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS cpu, event_id % 100 AS mem FROM events)"


def _samples(spark, folder):
    return events(spark, folder).select(
        F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("container"), "ts",
        F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.concat(F.col("value").cast("string"), F.lit("%"))).alias("cpu_pct"), F.concat((F.col("event_id") % 100).cast("string"), F.lit(" %")).alias("mem_pct"))


@query("e13_metric_rollup", f"""WITH {_SAMPLES} SELECT container, coalesce(max(cpu), 0.0) AS cpu_peak_pct, coalesce(avg(cpu), 0.0) AS cpu_avg_pct, CAST(max(mem) AS DOUBLE) AS mem_peak_pct, avg(mem) AS mem_avg_pct, count(*) AS samples FROM s GROUP BY 1""")
def metric_rollup(spark, folder):
    return rollups.metric_rollup(_samples(spark, folder))


@query("j11_metric_windows", f"""WITH {_SAMPLES} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, container, max(cpu) AS cpu_peak_pct, CAST(max(mem) AS DOUBLE) AS mem_peak_pct, count(*) AS samples FROM s GROUP BY 1, 2""")
def metric_windows(spark, folder):
    per = state.metric_windows(_samples(spark, folder), "1 hour")
    return per.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "container", "cpu_peak_pct", "mem_peak_pct", "samples")


@query("j1_request_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, user_id, count(*) AS n, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY 1, 2")
def request_windows(spark, folder):
    per = limits.window_counts(events(spark, folder), "user_id", 2, 3600)
    return per.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "user_id", "n", "rejected")


_ATTEMPTS = """a AS (SELECT CAST(user_id AS VARCHAR) AS report_id, event_id AS attempt_id, ts, CASE WHEN event_id % 13 = 0 THEN 200 WHEN event_id % 29 = 0 THEN 404 ELSE 503 END AS code, event_type = 'error' AS broken FROM events),
f AS (SELECT report_id, min(ts) AS t0 FROM a GROUP BY 1), i AS (SELECT a.* FROM a JOIN f USING (report_id) WHERE ts < t0 + INTERVAL 48 HOUR),
e AS (SELECT report_id, min((ts, attempt_id)) AS at, arg_min(code, (ts, attempt_id)) AS final FROM i WHERE NOT broken AND code <> 503 GROUP BY 1)"""


@query(
    "j8_delivery_outcomes",
    f"""WITH {_ATTEMPTS} SELECT report_id, 'job ' || report_id AS job_id, CASE WHEN final = 200 THEN 'delivered' ELSE 'failed' END AS outcome,
  CASE WHEN final IS NULL THEN 'window exhausted' ELSE 'http ' || final END AS reason, count(*) AS attempts
FROM i LEFT JOIN e USING (report_id) WHERE e.at IS NULL OR (i.ts, i.attempt_id) <= e.at GROUP BY report_id, final""",
)
def delivery_outcomes(spark, folder):
    return state.delivery_outcomes(attempts(events(spark, folder)), hours=48)


def attempts(rows):
    report = F.col("user_id").cast("string")
    code = F.when(F.col("event_id") % 13 == 0, 200).when(F.col("event_id") % 29 == 0, 404).otherwise(503)
    return rows.select(report.alias("report_id"), F.concat(F.lit("job "), report).alias("job_id"), F.col("event_id").alias("attempt_id"), "ts", code.alias("http_status"), F.when(F.col("event_type") == "error", "timeout").alias("transport_error"))


@query("j9_delivery_failed", f"""WITH {_ATTEMPTS} SELECT 'job ' || report_id AS job_id, report_id, CASE WHEN final IS NULL THEN 'window exhausted' ELSE 'http ' || final END AS reason, count(*) AS attempts
FROM i LEFT JOIN e USING (report_id) WHERE coalesce(final, 0) <> 200 AND (e.at IS NULL OR (i.ts, i.attempt_id) <= e.at) GROUP BY report_id, final""")
def delivery_failed(spark, folder):
    return state.delivery_failed_events(state.delivery_outcomes(attempts(events(spark, folder)), hours=48))


# --- checks and text functions ------------------------------------------------------------------------


@query(
    "b5_callback_urls",
    r"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http://', 'https://') WHEN 2 THEN 'https://10.1.2.' || page_id % 250 || '/x' END AS url FROM pages),
h AS (SELECT *, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM p)
SELECT page_id, CASE WHEN url IS NULL THEN NULL WHEN scheme <> 'https' THEN 'not_https' WHEN host LIKE '10.%' THEN 'internal_address' WHEN host NOT IN ('www.thering.example.org', 'm.ththes.example.org') THEN 'host_not_allowed' END AS reason FROM h""",
)
def callback_urls(spark, folder):
    c = F.col("page_id") % 4
    url = F.when(c == 0, F.col("url")).when(c == 1, F.replace("url", F.lit("http://"), F.lit("https://"))).when(c == 2, F.concat(F.lit("https://10.1.2."), (F.col("page_id") % 250).cast("string"), F.lit("/x")))
    return table(spark, folder, "pages").select("page_id", network.callback_error(url, ["www.thering.example.org", "M.ththes.example.org"]).alias("reason"))


@query(
    "b3_project_ids",
    """WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '-' || doc_id WHEN 1 THEN source || ' ' || doc_id WHEN 2 THEN lang || repeat('_', CAST(doc_id % 130 AS INTEGER)) || doc_id WHEN 3 THEN text END AS id FROM documents)
SELECT doc_id, CASE WHEN NOT coalesce(regexp_full_match(id, '[A-Za-z0-9_-]{1,100}'), false) THEN 'project_id: not allowed' END AS error FROM p""",
)
def project_ids(spark, folder):
    """Ids of every kind, whole: plain, with a blank, too long, whole texts, and none."""
    at, number = F.col("doc_id"), F.col("doc_id").cast("string")
    made = F.when(at % 5 == 0, F.concat("source", F.lit("-"), number)).when(at % 5 == 1, F.concat("source", F.lit(" "), number)).when(at % 5 == 2, F.concat("lang", F.repeat(F.lit("_"), (at % 130).cast("int")), number)).when(at % 5 == 3, F.col("text"))
    return documents(spark, folder).select("doc_id", validate.project_error(made).alias("error"))


@query(
    "b2_body_checks",
    """WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN '*' || base64(encode(text)) WHEN 3 THEN base64(encode(text || chr(0))) ELSE base64(encode(text)) END AS c, CASE WHEN doc_id % 4 = 2 THEN 'pdf' ELSE 'fdx' END AS fmt FROM documents),
o AS (SELECT *, regexp_full_match(c, '(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?') AND c <> '' AS ok FROM p), b AS (SELECT *, CASE WHEN ok THEN from_base64(c) END AS body FROM o)
SELECT doc_id, list_filter([CASE WHEN c = '' THEN 'content: empty' WHEN NOT ok THEN 'content: not base64' END, CASE WHEN length(c) > 10485760 THEN 'content: encoded text too long' END,
  CASE WHEN octet_length(body) > 10485760 THEN 'content: body too large' END, CASE WHEN fmt = 'fdx' AND contains(decode(body), chr(0)) THEN 'content: null bytes' END,
  CASE WHEN fmt = 'pdf' AND NOT starts_with(decode(body), '%PDF') THEN 'content: not a PDF' END], lambda x: x IS NOT NULL) AS errors FROM b""",
)
def body_checks(spark, folder):
    """Whole bodies: a NUL at the very end is found, and a character of several bytes may stand anywhere."""
    c = F.col("doc_id") % 4
    body = F.when(c == 3, F.concat(F.col("text").cast("binary"), F.lit(b"\x00"))).otherwise(F.col("text").cast("binary"))
    content = F.when(c == 1, F.concat(F.lit("*"), F.base64(body))).otherwise(F.base64(body))
    plain = F.replace(F.replace(content, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    rows = documents(spark, folder).select("doc_id", plain.alias("content"), F.when(c == 2, "pdf").otherwise("fdx").alias("fmt"))
    return rows.select("doc_id", F.array_compact(validate.body_errors(F.col("content"), F.col("fmt"))).alias("errors"))


@query("b6_enumerations", "SELECT conv_id, turn, CASE WHEN upper(role) IN ('USER', 'SYSTEM') THEN upper(role) ELSE 'UNKNOWN' END AS role FROM conversations")
def enumerations(spark, folder):
    padded = F.concat(F.lit(" "), F.initcap("role"), F.lit("\n"))
    return table(spark, folder, "conversations").select("conv_id", "turn", texts.in_list(padded, ("USER", "SYSTEM")).alias("role"))


@query(
    "b11_tags",
    f"""WITH g AS (SELECT doc_id, ' ,' || lang || ' , ,' || replace(text, ' ', ',') || ',' || source || ',' AS given FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(given, ','), lambda t: {strip_sql("t")}), lambda t: t <> ''), '|') AS tags FROM g""",
)
def tags(spark, folder):
    """Lists with blanks, empty places and repeats, made of the texts' words."""
    given = F.concat(F.lit(" ,"), "lang", F.lit(" , ,"), F.replace("text", F.lit(" "), F.lit(",")), F.lit(","), "source", F.lit(","))
    return documents(spark, folder).select("doc_id", F.array_join(validate.parse_tags(given), "|").alias("tags"))


#: Screening rules are the caller's; these look for markup and for lines that speak as somebody else.
_SCREEN = (("markup", "form", r"<\s*/?\s*(nav|footer|form)\b", True), ("speaks-as", "voice", r"(^|\n)operator>", True))


@query("b10_screened_pages", r"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<\s*/?\s*(nav|footer|form)\b') THEN 'markup' WHEN regexp_matches(html, '(?i)(^|\n)operator>') THEN 'speaks-as' END AS rule,
  NOT regexp_matches(html, '(?i)<\s*/?\s*(nav|footer|form)\b|(^|\n)operator>') AS is_safe FROM pages""")
def screened_pages(spark, folder):
    return validate.screen_text(table(spark, folder, "pages"), _SCREEN, "html").select("page_id", "rule", "is_safe")


@query("i22_escaped_html", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def escaped_html(spark, folder):
    return table(spark, folder, "pages").select("page_id", texts.html_escape(F.col("html")).alias("escaped"))


@query("i17_redacted", "SELECT doc_id, '<redacted>(chars=' || length(text) || ')' AS text, source FROM documents")
def redacted(spark, folder):
    return texts.redact_frame(documents(spark, folder).select("doc_id", "text", "source"))


@query("i19_outcome_classes", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'retry' WHEN s BETWEEN 200 AND 299 THEN 'delivered' WHEN s BETWEEN 400 AND 499 THEN 'hard_fail' ELSE 'retry' END AS outcome FROM (SELECT *, event_id % 5 * 100 + 100 AS s FROM events)")
def outcome_classes(spark, folder):
    rows = table(spark, folder, "events")
    return rows.select("event_id", network.delivery_class(F.col("event_id") % 5 * 100 + 100, F.when(F.col("event_type") == "error", "timeout")).alias("outcome"))


@query("i18_progress", "SELECT event_id, CAST(CASE WHEN n > 0 THEN 20 + floor(60.0 * d / n) END AS INTEGER) AS percent FROM (SELECT event_id, event_id % 40 AS d, event_id % 41 AS n FROM events)")
def progress(spark, folder):
    from riskframe.functions.scoring import progress_percent

    return table(spark, folder, "events").select("event_id", progress_percent(F.lit(20), F.lit(80), F.col("event_id") % 40, F.col("event_id") % 41).alias("percent"))
