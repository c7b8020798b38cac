"""The keyed machines over whole tables of events: what their streams give, with SQL for each."""

from pyspark.sql import functions as F

from riskframe.catalog.governance import events
from riskframe.catalog.registry import query
from riskframe.streaming import ingest, limits, state

_DAY, _LIFE = 86_400, 24 * 10**6

# --- rate windows -------------------------------------------------------------------------------------------


def _windows(name: str, source: str, key: str, window_ms: int, limit: int) -> str:
    """CTEs: ``name`` has a verdict for each row of source (id, ms, key): windows open with the first request after the last one closed."""
    return f"""{name}_at AS (SELECT DISTINCT {key} AS k, ms FROM {source} WHERE {key} IS NOT NULL),
{name}_next AS (SELECT k, ms, min(ms) OVER (PARTITION BY k ORDER BY ms RANGE BETWEEN {window_ms} FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM {name}_at),
{name}_open AS (SELECT k, min(ms) AS s FROM {name}_at GROUP BY k UNION ALL SELECT o.k, n.after FROM {name}_open o JOIN {name}_next n ON o.k = n.k AND o.s = n.ms WHERE n.after IS NOT NULL),
{name}_seen AS (SELECT r.*, o.s FROM {source} r JOIN {name}_open o ON r.{key} = o.k AND r.ms >= o.s AND r.ms < o.s + {window_ms}),
{name}_nth AS (SELECT *, row_number() OVER (PARTITION BY {key}, s ORDER BY ts, id) AS n FROM {name}_seen),
{name} AS (SELECT id, {key} AS k, n <= {limit} AS ok, CASE WHEN n <= {limit} THEN 0.0 ELSE CAST(s + {window_ms} - ms AS DOUBLE) / 1000 END AS wait FROM {name}_nth
  UNION ALL SELECT id, {key}, true, 0.0 FROM {source} WHERE {key} IS NULL)"""


_REQUESTS = "req AS (SELECT event_id AS id, ts, (epoch_us(ts) // 1000) AS ms, CASE WHEN event_id % 11 <> 0 THEN 'ip ' || user_id END AS ip, CASE WHEN event_type <> 'view' THEN substr(sha256('t' || CAST(user_id % 40 AS VARCHAR)), 1, 16) END AS tk FROM events)"


def _requests(spark, folder):
    token = F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string"))
    return events(spark, folder).select(
        F.col("event_id").alias("request_id"), "ts", F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("ip "), F.col("user_id").cast("string"))).alias("client_ip"), F.when(F.col("event_type") != "view", token).alias("token"))


@query("j1_rate_windows", f"WITH RECURSIVE {_REQUESTS}, {_windows('v', 'req', 'ip', 2 * _DAY * 1000, 3)} SELECT id AS request_id, k AS limit_key, ok AS allowed, wait AS retry_after_s FROM v")
def rate_windows(spark, folder):
    """Windows that open with an address's first request; requests without an address pass."""
    return limits.limit_by_ip(_requests(spark, folder), 3, 2 * _DAY)


@query(
    "j2_both_limits",
    f"""WITH RECURSIVE {_REQUESTS}, {_windows('v', 'req', 'ip', 2 * _DAY * 1000, 3)}, passed AS (SELECT req.* FROM req JOIN v USING (id) WHERE ok AND tk IS NOT NULL),
{_windows('w', 'passed', 'tk', _DAY * 1000, 6)}
SELECT id AS request_id, v.ok AND coalesce(w.ok, true) AS allowed, CASE WHEN NOT v.ok THEN 'ip' WHEN NOT w.ok THEN 'key' END AS refused_by, CASE WHEN v.ok THEN coalesce(w.wait, 0.0) ELSE v.wait END AS retry_after_s
FROM v LEFT JOIN w USING (id)""",
)
def both_limits(spark, folder):
    return limits.limit_both(_requests(spark, folder), 3, 2 * _DAY, 6, _DAY)


# --- idempotency ----------------------------------------------------------------------------------------------

_HORIZON = 60


@query(
    "j3_answered_submissions",
    f"""WITH s AS (SELECT CAST(event_id AS VARCHAR) AS id, ts, (epoch_us(ts) // 1000) AS ms, CASE WHEN event_id % 7 <> 0 THEN user_id || ':' || event_type END AS k FROM events),
g AS (SELECT *, coalesce(ms >= lag(ms) OVER (PARTITION BY k ORDER BY ts, id) + {_HORIZON * 3_600_000}, true) AS is_new FROM s WHERE k IS NOT NULL),
j AS (SELECT k, id, last_value(CASE WHEN is_new THEN id END IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts, id) AS job_id, is_new FROM g)
SELECT k AS idempotency_key, id AS submission_id, job_id, is_new FROM j UNION ALL SELECT NULL, id, id, true FROM s WHERE k IS NULL""",
)
def answered_submissions(spark, folder):
    """A key is answered with its first job until it has been silent for the horizon; blank keys are new jobs."""
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    rows = events(spark, folder).select(F.col("event_id").alias("submission_id"), "ts", F.when(F.col("event_id") % 7 != 0, key).when(F.col("event_id") % 2 == 0, "").alias("idempotency_key"))
    return ingest.answered_submissions(rows, _HORIZON)


# --- one-shot reads and expiring entries ------------------------------------------------------------------------


@query(
    "j4_one_shot_reads",
    """WITH e AS (SELECT CASE WHEN event_id % 13 <> 0 THEN user_id END AS report_id, ts, event_type = 'signup' AS made, event_id, event_id % 2 AS who FROM events),
c AS (SELECT report_id, min(ts) AS t0, arg_min(who, (ts, event_id)) AS owner FROM e WHERE made AND report_id IS NOT NULL GROUP BY 1),
q AS (SELECT e.*, t0, row_number() OVER (PARTITION BY e.report_id, who, t0 IS NOT NULL AND e.ts >= t0 ORDER BY e.ts, event_id) AS nth FROM e LEFT JOIN c ON c.report_id = e.report_id AND owner = who WHERE NOT made)
SELECT report_id, event_id AS request_id, CASE WHEN t0 IS NULL OR ts < t0 THEN 'not_found' WHEN nth > 1 THEN 'gone' WHEN (epoch_us(ts) // 1000) < (epoch_us(t0) // 1000) + 6 * 86400000 THEN 'served' ELSE 'expired' END AS outcome FROM q""",
)
def one_shot_reads(spark, folder):
    rows = events(spark, folder).select(
        F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("report_id"), "ts", F.when(F.col("event_type") == "signup", "created").otherwise("request").alias("kind"),
        (F.col("event_id") % 2).alias("user_id"), F.col("event_id").alias("request_id"), F.lit(6 * 24).alias("ttl_hours"))
    return state.read_once(rows, forget_hours=_LIFE)


@query(
    "j6_expiring_entries",
    """WITH e AS (SELECT 'k' || user_id AS key, ts, (epoch_us(ts) // 1000) AS ms, event_id, CASE event_type WHEN 'view' THEN 'put' WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'get' END AS kind FROM events WHERE event_id % 17 <> 0),
l AS (SELECT *, last_value(CASE WHEN kind <> 'get' THEN {'kind': kind, 'ms': ms, 'v': event_id} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e)
SELECT key, event_id AS request_id, f AS found, CASE WHEN f AND kind = 'get' THEN 'v' || p.v END AS value
FROM (SELECT *, coalesce(p.kind = 'put' AND ms < p.ms + 20 * 3600000, false) AS f FROM l WHERE kind <> 'put')""",
)
def expiring_entries(spark, folder):
    """Entries of 20 hours; rows with a blank key are skipped."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "put").when(F.col("event_type") == "error", "delete").otherwise("get")
    rows = events(spark, folder).select(
        F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("k"), F.col("user_id").cast("string"))).otherwise(" ").alias("key"), "ts", kind.alias("kind"),
        F.col("event_id").alias("request_id"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"), F.lit(20).alias("ttl_hours"))
    return state.buffer(rows)


# --- published progress -----------------------------------------------------------------------------------------


@query(
    "j5_published_progress",
    """WITH RECURSIVE e AS (SELECT user_id AS job_id, ts, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 40 = 0 THEN 'running' ELSE 'pending' END END AS status,
    CASE WHEN event_id % 3 <> 0 THEN event_id % 101 END AS progress, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT job_id, 0 AS n, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS shown, false AS news FROM (SELECT DISTINCT job_id FROM e)
  UNION ALL SELECT job_id, n, ts, status, CASE WHEN news AND progress IS NOT NULL THEN progress ELSE shown END, news FROM (
    SELECT e.job_id, e.n, e.ts, coalesce(e.status, s.status) AS status, e.progress, s.shown,
      coalesce(e.status, s.status) IS DISTINCT FROM s.status OR (e.progress IS NOT NULL AND (s.shown IS NULL OR e.progress - s.shown >= 10 OR (e.progress >= 100 AND s.shown < 100))) AS news
    FROM s JOIN e ON e.job_id = s.job_id AND e.n = s.n + 1))
SELECT job_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, status, shown AS progress, false AS is_final FROM s WHERE news""",
)
def published_progress(spark, folder):
    status = F.when(F.col("event_id") % 40 == 0, "running").when(F.col("event_id") % 4 == 0, "pending")
    rows = events(spark, folder).select(F.col("user_id").alias("job_id"), "ts", "event_id", status.alias("status"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 101).alias("progress"))
    told = state.published_progress(rows, forget_hours=_LIFE)
    return told.select("job_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "status", "progress", "is_final")


@query(
    "j8_delivery_machine",
    """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS report_id, event_id AS attempt_id, ts, (epoch_us(ts) // 1000) AS ms, CASE WHEN event_id % 13 = 0 THEN 200 WHEN event_id % 29 = 0 THEN 404 ELSE 503 END AS code, event_type = 'error' AS broken FROM events),
f AS (SELECT report_id, min(ms) AS t0 FROM a GROUP BY 1), i AS (SELECT a.* FROM a JOIN f USING (report_id) WHERE ms < t0 + 72 * 3600000),
e AS (SELECT report_id, min((ts, attempt_id)) AS at, arg_min(code, (ts, attempt_id)) AS final FROM i WHERE NOT broken AND code <> 503 GROUP BY 1)
SELECT report_id, 'job ' || report_id AS job_id, CASE WHEN final = 200 THEN 'delivered' ELSE 'failed' END AS outcome, CASE WHEN final IS NULL THEN 'window exhausted' ELSE 'http ' || final END AS reason, count(*) AS attempts
FROM i LEFT JOIN e USING (report_id) WHERE e.at IS NULL OR (i.ts, i.attempt_id) <= e.at GROUP BY report_id, final""",
)
def delivery_machine(spark, folder):
    """The stream's machine over the table of attempts."""
    from riskframe.catalog.governance import attempts

    return state.delivery_outcomes_stream(attempts(events(spark, folder)), hours=72, forget_hours=_LIFE)
