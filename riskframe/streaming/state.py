"""One-shot reads, expiring entries, deliveries, jobs and metrics, on streams and on tables.

Each keyed machine is a pair of plain functions (see ``machines``), so a stream and a batch give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskframe.limits import BUFFER_TTL_HOURS, DELIVERY_WINDOW_HOURS, PROGRESS_STEP
from riskframe.operators.rollups import metric_rollup, percent
from riskframe.streaming import machines

HOUR_MS = 3_600_000


def _run(rows: DataFrame, delay: str, settle: bool, key: str, columns: list[str], order: list[str], state: str, out: str, step: machines.Step, expire: machines.Expire = machines.gone, close: bool = False) -> DataFrame:
    if rows.isStreaming:
        return machines.stream(rows, key, columns, order, state, out, step, expire, delay, settle)
    return machines.batch(rows, key, columns, order, out, step, expire, close=close)


def read_once_step(state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
    """Events ``created`` (user_id, ttl_hours) and ``request`` (user_id, request_id) of one report."""
    if row["kind"] == "created":
        return state or {"owner": row["user_id"], "until": row["ms"] + int(row["ttl_hours"] or BUFFER_TTL_HOURS) * HOUR_MS, "read": False}, []
    said = lambda outcome: [{"request_id": row["request_id"], "outcome": outcome}]
    if state is None or state["owner"] != row["user_id"]:
        return state, said("not_found")
    if state["read"]:
        return state, said("gone")
    return {**state, "read": True}, said("served" if row["ms"] < state["until"] else "expired")


def read_once(events: DataFrame, delay: str = "10 minutes", forget_hours: int = 24, settle: bool = True) -> DataFrame:
    """(report_id, request_id, outcome) for each request: served once, then gone; expired after its time; not_found for others.

    Events are (report_id, ts, kind, user_id, request_id, ttl_hours). A report's state is kept ``forget_hours`` beyond its
    expiry, so that late readers hear gone or expired. A request without a report's id finds none."""
    def step(state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
        inner, out = read_once_step(None if state is None else {**state, "until": state["expires"]}, row)
        return None if inner is None else {**inner, "expires": inner["until"], "until": inner["until"] + forget_hours * HOUR_MS}, out

    kinds = {c: events.schema[c].dataType.simpleString() for c in ("report_id", "request_id", "user_id")}
    out = f"report_id {kinds['report_id']}, request_id {kinds['request_id']}, outcome string"
    columns = ["kind", "user_id", "request_id", "ttl_hours"]
    told = _run(events, delay, settle, "report_id", columns, ["kind", "request_id"], f"owner {kinds['user_id']}, until long, read boolean, expires long", out, step)
    lost = events.where("report_id IS NULL AND kind = 'request'").select("report_id", "request_id", F.lit("not_found").alias("outcome"))
    return told.unionByName(lost)


def buffer_step(state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
    """Events ``put`` (value, ttl_hours), ``get`` and ``delete`` of one key."""
    alive = state is not None and row["ms"] < state["until"]
    if row["kind"] == "put":
        return {"value": row["value"], "until": row["ms"] + int(row["ttl_hours"] or BUFFER_TTL_HOURS) * HOUR_MS}, []
    if row["kind"] == "delete":
        return None, [{"request_id": row["request_id"], "found": alive, "value": None}]
    return state if alive else None, [{"request_id": row["request_id"], "found": alive, "value": state["value"] if alive else None}]


def buffer(events: DataFrame, delay: str = "10 minutes", settle: bool = True) -> DataFrame:
    """(key, request_id, found, value) for each get and delete of entries that expire by event time.

    Events are (key, ts, kind, request_id, value, ttl_hours); a blank or missing key is skipped."""
    kind = events.schema["request_id"].dataType.simpleString()
    named = events.where(F.trim(F.coalesce("key", F.lit(""))) != "")
    return _run(named, delay, settle, "key", ["kind", "request_id", "value", "ttl_hours"], ["request_id"], "value string, until long", f"key string, request_id {kind}, found boolean, value string", buffer_step)


class _Entries(StatefulProcessor):
    """Entries whose state has a time to live: the store itself lets go of them, by the clock."""

    def __init__(self, entry: T.StructType, ttl_ms: int) -> None:
        self.entry, self.ttl_ms = entry, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("entry", self.entry, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for row in sorted((r.asDict() for r in rows), key=lambda r: (r["ts"], r["request_id"] or 0)):
            if row["kind"] == "put":
                self.held.update((row["value"],))
                continue
            found = self.held.exists()
            value = self.held.get()[0] if found and row["kind"] == "get" else None
            if row["kind"] == "delete":
                self.held.clear()
            yield Row(key=key[0], request_id=row["request_id"], found=found, value=value)

    def close(self) -> None:
        pass


def clock_buffer(events: DataFrame, ttl_seconds: float = BUFFER_TTL_HOURS * 3600) -> DataFrame:
    """The buffer by the clock of the machines that run it: an entry goes ``ttl_seconds`` after it was put, by the state's own
    time to live, also when nothing more ever comes for its key. Answers come with the micro-batch of the request."""
    machines.use_rocksdb(events.sparkSession)
    named = events.where(F.trim(F.coalesce("key", F.lit(""))) != "").select("key", "ts", "kind", "request_id", "value")
    shape = T.StructType.fromDDL(f"key string, request_id {events.schema['request_id'].dataType.simpleString()}, found boolean, value string")
    return named.groupBy("key").transformWithState(_Entries(T.StructType.fromDDL("value string"), int(ttl_seconds * 1000)), shape, "Append", "ProcessingTime")


def deleted_count(answers: DataFrame, deletes: DataFrame) -> DataFrame:
    """How many entries a request of many deletes really took away: (request_id, deleted)."""
    hit = deletes.select("request_id").distinct().join(answers.where("found"), "request_id", "left")
    return hit.groupBy("request_id").agg(F.count("found").alias("deleted"))


def live_entries(entries: DataFrame, now) -> DataFrame:
    """The batch form: what can still be read of (key, value, expires_at)."""
    return entries.where(F.col("expires_at") > now)


def delivery_step(window_ms: int):
    def step(state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
        """Attempts (http_status, transport_error, job_id) of one report; after its outcome nothing counts."""
        state = state or {"until": row["ms"] + window_ms, "attempts": 0, "job_id": row["job_id"], "done": False}
        if state["done"]:
            return state, []
        state = {**state, "attempts": state["attempts"] + 1}
        status, broken = row["http_status"], isinstance(row["transport_error"], str)
        code = None if broken or status is None or status != status else int(status)
        outcome = None if code is None else "delivered" if 200 <= code < 300 else "failed" if 400 <= code < 500 else None
        if outcome is None:
            return state, []
        return {**state, "done": True}, [{"job_id": state["job_id"], "outcome": outcome, "reason": f"http {code}", "attempts": state["attempts"]}]

    return step


def delivery_outcomes_stream(attempts: DataFrame, hours: int = DELIVERY_WINDOW_HOURS, delay: str = "10 minutes", forget_hours: int = 24) -> DataFrame:
    """(report_id, job_id, outcome, reason, attempts), once for each report: at the first final answer, or when its window closes.

    Attempts of up to ``forget_hours`` after the window change nothing."""
    def expire(state: dict) -> tuple[dict | None, list[dict]]:
        if state["closed"]:
            return None, []
        rows = [] if state["done"] else [{"job_id": state["job_id"], "outcome": "failed", "reason": "window exhausted", "attempts": state["attempts"]}]
        return {**state, "done": True, "closed": True, "until": state["until"] + forget_hours * HOUR_MS}, rows

    inner = delivery_step(hours * HOUR_MS)

    def step(state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
        after, rows = inner(state, row)
        return {"closed": False, **after}, rows

    shape = "report_id string, job_id string, outcome string, reason string, attempts long"
    return _run(attempts, delay, True, "report_id", ["attempt_id", "job_id", "http_status", "transport_error"], ["attempt_id"], "until long, attempts long, job_id string, done boolean, closed boolean", shape, step, expire, close=True)


def progress_step(every: int, forget_ms: int) -> machines.Step:
    def step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
        """Events (status, progress) of one job: what is worth publishing of them."""
        last = state or {"status": None, "shown": None}
        status, progress = row["status"] or last["status"], row["progress"]
        known = last["shown"]
        ended = status in ("completed", "failed")
        news = status != last["status"] or (progress is not None and (known is None or progress - known >= every or (progress >= 100 > known)))
        shown = progress if news and progress is not None else known
        state = {"status": status, "shown": shown, "until": row["ms"] + forget_ms}
        return state, [{"us": row["us"], "status": status, "progress": shown, "is_final": ended}] if news else []

    return step


def published_progress(events: DataFrame, every: int = PROGRESS_STEP, delay: str = "1 minute", forget_hours: int = 24, settle: bool = True) -> DataFrame:
    """(job_id, ts, status, progress, is_final): of a job's events (job_id, ts, event_id, status, progress) those that are published,
    which are changes of its status, and progress that is ``every`` percent on from what was published last, or has reached 100.

    A job that is silent for ``forget_hours`` is forgotten. Events without a job are never published."""
    kind = events.schema["job_id"].dataType.simpleString()
    columns, out = ["event_id", "status", "progress"], f"job_id {kind}, us long, status string, progress long, is_final boolean"
    rows = events.withColumn("progress", F.col("progress").cast("long"))
    told = _run(rows, delay, settle, "job_id", columns, ["event_id"], "status string, shown long, until long", out, progress_step(every, forget_hours * HOUR_MS))
    return told.select("job_id", F.timestamp_micros("us").alias("ts"), "status", "progress", "is_final")


def delivery_outcomes(attempts: DataFrame, hours: int = DELIVERY_WINDOW_HOURS) -> DataFrame:
    """The batch form, for attempts whose windows have all closed: two partial aggregates, no state."""
    code = F.when(F.col("transport_error").isNull(), F.col("http_status"))
    final = F.coalesce(code.between(200, 299) | code.between(400, 499), F.lit(False))
    at = F.struct("ts", "attempt_id")
    first = attempts.groupBy("report_id").agg(F.min(F.struct("ts", "attempt_id", "job_id")).alias("f"))
    inside = attempts.join(first, "report_id").where(F.col("ts") < F.timestamp_add("HOUR", F.lit(hours), F.col("f.ts")))
    ends = inside.groupBy("report_id").agg(F.min(F.when(final, F.struct("ts", "attempt_id", code.alias("code")))).alias("e"))
    counted = inside.join(ends, "report_id").where(F.col("e").isNull() | (at <= F.struct("e.ts", "e.attempt_id")))
    per = counted.groupBy("report_id", "f.job_id", "e.code").agg(F.count("*").alias("attempts"))
    return per.select(
        "report_id", "job_id", F.when(F.col("code").between(200, 299), "delivered").otherwise("failed").alias("outcome"),
        F.when(F.col("code").isNull(), "window exhausted").otherwise(F.concat(F.lit("http "), F.col("code").cast("string"))).alias("reason"), "attempts")


def delivery_failed_events(outcomes: DataFrame) -> DataFrame:
    """job_id, report_id, reason, attempts: nothing else leaves; unknown attempts are 0."""
    return outcomes.where("outcome = 'failed'").select("job_id", "report_id", "reason", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def metric_windows(samples: DataFrame, width: str = "1 minute", delay: str = "1 minute", key: str = "container") -> DataFrame:
    """Peak and mean of the samples of each window and container; for a stream and for a batch."""
    cpu, mem = percent(F.col("cpu_pct")), percent(F.col("mem_pct"))
    rows = samples.withWatermark("ts", delay) if samples.isStreaming else samples
    per = rows.groupBy(F.window("ts", width).alias("w"), key).agg(
        F.max(cpu).alias("cpu_peak_pct"), F.avg(cpu).alias("cpu_avg_pct"), F.max(mem).alias("mem_peak_pct"), F.avg(mem).alias("mem_avg_pct"), F.count("*").alias("samples"))
    return per.select(F.col("w.start").alias("window_start"), key, "cpu_peak_pct", "cpu_avg_pct", "mem_peak_pct", "mem_avg_pct", "samples")


__all__ = ["metric_rollup", "read_once", "buffer", "clock_buffer", "deleted_count", "live_entries", "delivery_outcomes_stream", "delivery_outcomes", "delivery_failed_events", "published_progress", "metric_windows"]
