"""Streams: the keyed machines as plain functions, and streams against their batch forms."""

import datetime as dt
import time
import uuid

from pyspark.sql import functions as F

from riskframe.catalog.governance import attempts, events
from riskframe.catalog.inputs import measures, risk_classes
from riskframe.streaming import ingest, limits, published, state

HOUR = state.HOUR_MS


def drain(df, mode="append"):
    """Run a stream over all that is there and give back its rows."""
    name = "t" + uuid.uuid4().hex
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name).collect()


def stream(spark, tmp_path, rows, schema, after=()):
    """Rows as a stream of three files, in their order, and a file each for what comes after."""
    folder = str(tmp_path / uuid.uuid4().hex)
    size = -(-len(rows) // 3)
    for part in [*(rows[i * size : (i + 1) * size] for i in range(3)), *([row] for row in after)]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_rate_windows_open_with_the_first_request():
    out, held = limits.decide([0, 10, 20, 999, 1000, 1001], None, 2, 1000)
    assert [o[0] for o in out] == [True, True, False, False, True, True] and out[2][1] == 980 and held == (1000, 2)
    assert limits.decide([500], held, 2, 1000)[0] == [(True, 0)] and limits.decide([1002], held, 2, 1000)[0] == [(False, 998)]


def scattered(rows, late=3, every=4):
    """Rows in the order of their arrival: some come a few places late, some twice."""
    out = []
    for i, row in enumerate(rows):
        out.insert(max(0, len(out) - (late if i % every == 1 else 0)), row)
    half = len(out) // 2
    return out[:half] + [out[half - 2]] + out[half:]


def in_files(spark, tmp_path, rows, schema, files):
    folder = str(tmp_path / uuid.uuid4().hex)
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def same(spark, tmp_path, rows, schema, apply, drop=lambda r: False, files=5):
    """The stream of some micro-batches, and the table of the same rows, give the same rows."""
    folder, at = in_files(spark, tmp_path, rows, schema, files)
    streamed = sorted((tuple(r) for r in drain(apply(at)) if not drop(r)), key=repr)
    tabled = sorted((tuple(r) for r in apply(spark.read.parquet(folder)).collect() if not drop(r)), key=repr)
    assert streamed == tabled and streamed
    return streamed


T0 = 1_700_000_000


def test_rate_limit_stream_is_the_batch(spark, tmp_path):
    ips = ["a", "a", "b", None, "a", "c", None]
    rows = scattered([(i, T0 + i * 5, ips[i % 7]) for i in range(90)]) + [(10_000, T0 + 5000, "z"), (10_001, T0 + 9000, "z")]
    ts = lambda df: df.withColumn("ts", F.timestamp_seconds("s"))
    got = same(spark, tmp_path, rows, "request_id long, s long, client_ip string", lambda df: limits.limit_by_ip(ts(df), limit=3, window_s=60), lambda r: r.request_id >= 10_000)
    want = []
    for ip in "abc":
        mine = sorted((s, i) for i, s, x in rows if x == ip and i < 10_000)
        want += [(i, ip, ok, wait / 1000) for (s, i), (ok, wait) in zip(mine, limits.decide([s * 1000 for s, _ in mine], None, 3, 60_000)[0])]
    want += [(i, None, True, 0.0) for i, _, x in rows if x is None]
    assert got == sorted(want, key=repr) and any(not r[2] for r in got)


def test_rate_limit_at_once_follows_the_arrival(spark, tmp_path):
    rows = [(i, T0 + i * 5, "a" if i % 3 else "b") for i in range(60)]
    _, at = in_files(spark, tmp_path, rows, "request_id long, s long, client_ip string", 3)
    got = {r.request_id: r.allowed for r in drain(limits.limit_by_ip(at.withColumn("ts", F.timestamp_seconds("s")), limit=3, window_s=60, settle=False))}
    want = {}
    for ip in "ab":
        mine = [(i, s * 1000) for i, s, x in rows if x == ip]
        want |= dict(zip([i for i, _ in mine], [o[0] for o in limits.decide([t for _, t in mine], None, 3, 60_000)[0]]))
    assert got == want and not all(want.values())


def test_both_limits(spark):
    rows = [(i, i * 2, "a" if i % 2 else "b", f"t{i % 3}" if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "request_id long, s long, client_ip string, token string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.request_id: (r.allowed, r.refused_by) for r in limits.limit_both(df, 8, 60, 3, 90).collect()}
    by_ip, by_key, want = {}, {}, {}
    for i, s, ip, token in rows:
        (ok, _), by_ip[ip] = (lambda o: (o[0][0], o[1]))(limits.decide([s * 1000], by_ip.get(ip), 8, 60_000))
        want[i] = (True, None) if ok else (False, "ip")
        if ok and token:
            (ok, _), by_key[token] = (lambda o: (o[0][0], o[1]))(limits.decide([s * 1000], by_key.get(token), 3, 90_000))
            want[i] = (True, None) if ok else (False, "key")
    assert got == want and {v[1] for v in want.values()} == {None, "ip", "key"}


def run(step, rows, held=None):
    out = []
    for r in rows:
        held, more = step(held, r)
        out += more
    return held, out


def test_one_shot_reads():
    row = lambda kind, ms, user="u", rid=0: {"kind": kind, "ms": ms, "user_id": user, "request_id": rid, "ttl_hours": 6}
    _, out = run(state.read_once_step, [row("request", 0), row("created", 1), row("request", 2, "other"), row("request", 3, rid=1), row("request", 4, rid=2)])
    assert [o["outcome"] for o in out] == ["not_found", "not_found", "served", "gone"]
    _, out = run(state.read_once_step, [row("created", 0), row("request", 6 * HOUR), row("request", 6 * HOUR + 1)])
    assert [o["outcome"] for o in out] == ["expired", "gone"]


def test_buffer_expires():
    row = lambda kind, ms: {"kind": kind, "ms": ms, "value": "v", "request_id": ms, "ttl_hours": 1}
    _, out = run(state.buffer_step, [row("get", 0), row("put", 1), row("get", 2), row("get", HOUR + 1), row("put", HOUR + 2), row("delete", HOUR + 3), row("get", HOUR + 4)])
    assert [o["found"] for o in out] == [False, True, False, True, False]


def test_one_shot_reads_as_a_stream(spark, tmp_path):
    """Late and repeated requests, foreign readers, expiry after an hour, and requests without a report."""
    rows = []
    for i in range(24):
        rows += [(f"r{i}", T0 + i * 60, "created", "u" if i % 5 else "v", None, 1), (f"r{i}", T0 + i * 60 + (30 if i % 3 else 4000), "request", "u", i, None), (f"r{i}" if i % 4 else None, T0 + i * 60 + 45, "request", "u", 100 + i, None)]
    rows = scattered(sorted(rows, key=lambda r: r[1]), late=5) + [("later", T0 + 200_000, "created", "u", None, 1), ("later", T0 + 300_000, "request", "u", -1, None)]
    got = same(spark, tmp_path, rows, "report_id string, s long, kind string, user_id string, request_id long, ttl_hours int",
               lambda df: state.read_once(df.withColumn("ts", F.timestamp_seconds("s")), delay="30 minutes"), lambda r: r.report_id == "later")
    assert {r[2] for r in got} == {"served", "gone", "not_found", "expired"}
    assert all(r[2] == "not_found" for r in got if r[0] is None) and any(r[0] is None for r in got)


def test_expiring_entries_as_a_stream(spark, tmp_path):
    rows = []
    for i in range(40):
        k = f"k{i % 6}" if i % 7 else [None, " "][i % 2]
        rows.append((k, T0 + i * 600, ["put", "get", "get", "delete", "get"][i % 5], i, f"v{i}", 3))
    rows = scattered(rows) + [("z", T0 + 90_000, "put", 900, "v", 1), ("z", T0 + 200_000, "put", 901, "v", 1)]
    got = same(spark, tmp_path, rows, "key string, s long, kind string, request_id long, value string, ttl_hours int",
               lambda df: state.buffer(df.withColumn("ts", F.timestamp_seconds("s")), delay="1 hour"), lambda r: r.key == "z")
    assert {r[2] for r in got} == {True, False} and None not in {r[0] for r in got}
    answers = spark.createDataFrame(got, "key string, request_id long, found boolean, value string")
    deletes = spark.createDataFrame([(i,) for i in range(3, 40, 5)], "request_id long")
    assert {r.request_id: r.deleted for r in state.deleted_count(answers, deletes).collect()} == {i: sum(r[2] for r in got if r[1] == i) for i in range(3, 40, 5)}


def test_entries_go_by_the_clock_without_further_rows(spark, tmp_path):
    """An entry is there soon after its put, and gone after its time to live, though nothing came for its key in between."""
    folder, shape = str(tmp_path / "events"), "key string, ts timestamp, kind string, request_id long, value string"
    put = lambda *rows: spark.createDataFrame([(k, dt.datetime(2024, 1, 1), kind, i, v) for k, kind, i, v in rows], shape).coalesce(1).write.mode("append").parquet(folder)
    put(("a", "put", 0, "x"), ("b", "put", 1, "y"), (None, "put", 2, "n"))
    answers = state.clock_buffer(spark.readStream.schema(shape).parquet(folder), 15)
    query = answers.writeStream.outputMode("append").format("memory").queryName("clock").trigger(processingTime="1 second").start()

    def answered(n):  # a query that keeps time makes micro-batches for ever, so its rows are waited for
        until = time.monotonic() + 60
        while spark.table("clock").count() < n and query.isActive and time.monotonic() < until:
            time.sleep(0.3)
        return sorted(tuple(r) for r in spark.table("clock").collect())

    try:
        put(("a", "get", 3, None))
        assert answered(1) == [("a", 3, True, "x")]
        time.sleep(17)
        put(("a", "get", 4, None), ("b", "get", 5, None), ("b", "delete", 6, None))
        assert answered(4)[1:] == [("a", 4, False, None), ("b", 5, False, None), ("b", 6, False, None)]
    finally:
        query.stop()


def test_published_progress(spark, tmp_path):
    rows = [("j", T0 + i, i, "running" if i < 50 else None, i * 2) for i in range(50)] + [("j", T0 + 60, 60, "completed", 100), ("k", T0 + 5, 5, "pending", None), ("k", T0 + 6, 6, "pending", 3), (None, T0 + 6, 7, "pending", 3)]
    rows = scattered(sorted(rows, key=lambda r: r[1])) + [("z", T0 + 10_000, 100, "pending", 1), ("z", T0 + 20_000, 101, "pending", 1)]
    got = same(spark, tmp_path, rows, "job_id string, s long, event_id long, status string, progress int", lambda df: state.published_progress(df.withColumn("ts", F.timestamp_seconds("s")), delay="5 minutes"), lambda r: r.job_id == "z")
    assert [(r[2], r[3], r[4]) for r in sorted(got, key=lambda r: r[1]) if r[0] == "j"] == [("running", p, False) for p in range(0, 100, 10)] + [("completed", 100, True)]
    assert [(r[2], r[3]) for r in got if r[0] == "k"] == [("pending", None), ("pending", 3)]


def test_deliveries_stream_agrees_with_batch(spark, tmp_path):
    """Stream, machine over a table, and plain aggregates; the stream's windows close once a later event has moved the watermark on."""
    batch = attempts(events(spark, "/root/testdata/sf0.001")).where("report_id < 40").orderBy("ts", "attempt_id")
    rows = scattered([tuple(r) for r in batch.collect()])
    last = max(r[3] for r in rows)
    rows += [(f"late{i}", "job late", 10**9 + i, last.replace(year=2025 + i), 200, None) for i in range(2)]
    schema = "report_id string, job_id string, attempt_id long, ts timestamp, http_status int, transport_error string"
    got = same(spark, tmp_path, list(dict.fromkeys(rows)), schema, lambda df: state.delivery_outcomes_stream(df, hours=48, delay="30 days", forget_hours=10_000), lambda r: r.report_id.startswith("late"))
    want = {r.report_id: (r.job_id, r.outcome, r.reason, r.attempts) for r in state.delivery_outcomes(batch, hours=48).collect()}
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)
    failed = state.delivery_failed_events(state.delivery_outcomes(batch, hours=48))
    assert failed.columns == ["job_id", "report_id", "reason", "attempts"] and failed.count() == sum(v[1] == "failed" for v in want.values())


def test_idempotent_streams(spark, tmp_path):
    rows = scattered([(f"s{i:02}", T0 + i, f"k{i % 4}" if i % 5 else (None if i % 2 else "")) for i in range(30)])
    later = [("x1", T0 + 5000, "z"), ("x2", T0 + 9000, "z")]
    ts = lambda df: df.withColumn("ts", F.timestamp_seconds("s"))
    first = {}
    for s, _, k in sorted(rows):
        if k:
            first.setdefault(k, s)
    schema = "submission_id string, s long, idempotency_key string"
    got = same(spark, tmp_path, rows + later, schema, lambda df: ingest.answered_submissions(ts(df), 6), lambda r: r.submission_id[0] == "x")
    once = {s: k for s, _, k in rows}
    assert {(r[1], r[2]) for r in got} == {(s, first[k] if k else s) for s, k in once.items()} and len(got) == len(rows)
    assert all(r[0] is None and r[3] for r in got if not once[r[1]]) and sum(r[3] for r in got if r[0]) == len(first)
    _, at = in_files(spark, tmp_path, sorted(set(rows), key=lambda r: r[1]), schema, 3)
    kept = [r.submission_id for r in drain(ingest.first_submissions(ts(at), "1 hour"))]
    assert sorted(kept) == sorted(s for s, k in once.items() if not k or first[k] == s)


def test_ingest_writes_what_a_batch_gives(spark, tmp_path, data):
    lexicon = spark.createDataFrame([("fire", "ALGERIA", 4, 4), ("water", "BRAZIL", 2, 3)], "term string, risk_class string, likelihood int, impact int")
    rows = [(f"r{i}", "Title\nINT. ROOM\nfire and water, fire\nEXT. LAKE\nnothing" if i % 2 else "no scene at all") for i in range(9)]
    measure, applies = measures(spark, data)
    sides = (lexicon, risk_classes(spark, data), measure, applies)
    ingest.run_ingest(stream(spark, tmp_path, rows, "report_id string, full_text string"), str(tmp_path / "out"), *sides).awaitTermination()
    scenes, findings = ingest.findings_of(spark.createDataFrame(rows, "report_id string, full_text string"), *sides)
    read = lambda name: published.read(spark, str(tmp_path / "out"), name)
    key = lambda df: sorted((r.report_id, r.scene_ix, r.risk_class, r.risk_level, len(r.measures)) for r in df.collect())
    assert key(read("findings")) == key(findings) and len(key(findings)) == 8
    assert read("scenes").count() == scenes.count() and read("reports").where("total_findings = 0").count() == 5
    assert len(published.commits(spark, str(tmp_path / "out"))) == 3 and read("submissions") is None and published.sweep(spark, str(tmp_path / "out")) == []


def test_job_states_and_windows_in_update_mode(spark, tmp_path):
    rows = [("j1", 3, "completed"), ("j1", 1, "pending"), ("j2", 2, "running"), ("j1", 2, "running"), ("j2", 1, "pending"), ("j2", 5, "failed")]
    at = stream(spark, tmp_path, rows, "job_id string, s long, status string").select("job_id", "status", F.timestamp_seconds("s").alias("ts"), F.lit(None).cast("int").alias("progress"), F.lit(None).cast("string").alias("error"))
    last = {r.job_id: r.status for r in drain(ingest.job_states(at), "update")}
    assert last == {"j1": "completed", "j2": "failed"}
    samples = stream(spark, tmp_path, [("c", i, f"{i}%", "1%") for i in range(200)], "container string, s long, cpu_pct string, mem_pct string").withColumn("ts", F.timestamp_seconds("s"))
    done = drain(state.metric_windows(samples, "1 minute", "1 second"))
    assert sorted((r.cpu_peak_pct, r.samples) for r in done)[:2] == [(59.0, 60), (119.0, 60)]
