"""Calls in flight, screening by many rules, mergeable roll-ups, stored keys, and the pruned index."""

import io
import random
import threading
import time
import uuid
from contextlib import redirect_stdout
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions import variants
from riskframe.operators import calls, nearest, screening, sketches, validate
from riskframe.sources.hashed import KeyStore


def plan_of(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


# --- calls ------------------------------------------------------------------------------------------------------


def test_calls_keep_order_and_a_slow_row_holds_up_no_other():
    started, most, now, lock = [], [0], [0], threading.Lock()

    def ask(row):
        with lock:
            started.append(row["i"])
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(1.0 if row["i"] == 0 else 0.005)
        with lock:
            now[0] -= 1
        return row["i"] * 2

    begun = time.monotonic()
    got = list(calls.answers(({"i": i} for i in range(101)), ask, 4, 256, 0, 0, 0))
    assert [(r["i"], a) for r, a, _, _ in got] == [(i, 2 * i) for i in range(101)]
    assert time.monotonic() - begun < 1.6 and most[0] <= 4 and sorted(started) == list(range(101))


def test_only_failed_rows_are_asked_again():
    asked = {}

    def ask(row):
        asked[row["i"]] = asked.get(row["i"], 0) + 1
        if row["i"] % 5 == 0 and asked[row["i"]] < 3:
            raise ConnectionError("busy")
        if row["i"] == 7:
            raise ValueError("never")
        return "ok"

    got = list(calls.answers(({"i": i} for i in range(20)), ask, 3, 8, 2, 0.001, 0))
    assert [n for _, _, _, n in got] == [3 if i % 5 == 0 or i == 7 else 1 for i in range(20)] == [asked[i] for i in range(20)]
    assert [(r["i"], a, e) for r, a, e, _ in got if a != "ok"] == [(7, None, "ValueError")]


def test_calls_are_spaced():
    starts = []
    list(calls.answers(({"i": i} for i in range(8)), lambda row: starts.append(time.monotonic()), 8, 8, 0, 0, 0.05))
    assert min(np.diff(sorted(starts))) > 0.035


def test_calls_over_a_table(spark):
    rows = spark.createDataFrame([(i, f"text {i}" if i % 4 else None, [i]) for i in range(50)], "id long, text string, l array<int>")

    def ask(row):
        if row["text"] is None:
            raise ValueError
        return [float(len(row["text"])), float(row["id"])]

    got = calls.call_each(rows, ask, "embedding", "array<float>", ["id", "text"], tasks=3, in_flight=5, retries=0).collect()
    assert len(got) == 50 and all(r.l == [r.id] and r.calls == 1 for r in got)
    assert all(((r.embedding, r.error) == (None, "ValueError")) if r.id % 4 == 0 else r.embedding == [len(r.text), r.id] for r in got)
    assert calls.call_each(rows.limit(0), ask).count() == 0


# --- screening --------------------------------------------------------------------------------------------------


def rules_of(n, rng):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(9)) for _ in range(n)]
    return [screening.Rule(f"r{i}", rf"\b{w[:4]}{w[4:]}\s+(now|today)\b" if i % 3 else rf"{w}[0-9]*", bool(i % 2), w) for i, w in enumerate(words)]


def test_two_thousand_rules_are_not_much_dearer_than_twenty(spark):
    rng = random.Random(2)
    rules = rules_of(2000, rng)
    rules[5] = screening.Rule("any", r"zzz{2,}", True)  # has no literal
    text = {}
    for i in range(3000):
        words = [rng.choice(["over", "the", "old", "town", "now", "today", "ZZZZ", "zzzz"] if i % 50 == 0 else ["over", "the", "old", "town", "now"]) for _ in range(300)]
        if i % 7 == 0:
            words[rng.randrange(300)] = (rng.choice(rules).literal or "x") + rng.choice(["", "7"])
        if i % 11 == 0:
            words[rng.randrange(300)] = (rng.choice(rules).literal or "x").upper()
        text[i] = " ".join(words)
    df = spark.createDataFrame([*text.items(), (-1, None)], "id long, text string").repartition(4).cache()
    df.count()
    some = rules[:400]
    plain = validate.screen_text(df.where("id < 300"), [(r.rule, "g", r.pattern, r.fold) for r in some])
    assert {r.id: r.rule for r in plain.collect()} == {r.id: r.rule for r in screening.screen(df.where("id < 300"), some).collect()}

    def seconds(which):
        begun = time.perf_counter()
        found = screening.screen(df, which).where("rule IS NOT NULL").count()
        return time.perf_counter() - begun, found

    seconds(rules[:20])
    few, many = min(seconds(rules[:20]) for _ in range(2)), min(seconds(rules) for _ in range(2))
    print("seconds for 20 and for 2,000 rules:", few[0], many[0])
    assert many[1] > 100 and many[0] < 3 * few[0]
    assert {(r.rule, r.is_safe) for r in screening.screen(df, []).collect()} == {(None, True)}
    by_hand = screening.screen(spark.createDataFrame([("AB cd ab",)], "text string"), [screening.Rule("x", "ab cd", True, "Ab"), screening.Rule("y", "AB", False, "AB"), screening.Rule("z", "ab$", False, "ab")]).first()
    assert (by_hand.rule, by_hand.rules) == ("x", ["x", "y", "z"])


# --- roll-ups ---------------------------------------------------------------------------------------------------


def test_merged_days_are_the_whole_within_their_errors(spark):
    rng = np.random.default_rng(3)
    n = 60_000
    rows = spark.createDataFrame(list(zip(rng.integers(0, 30, n).tolist(), rng.integers(0, 2, n).tolist(), rng.integers(0, 9000, n).tolist(), rng.lognormal(3, 1, n).tolist())), "day int, endpoint int, user_id long, duration_ms double")
    days = sketches.daily(rows, ["endpoint"])
    assert days.count() == 60
    halves = sketches.merged(days.where("day < 10"), ["endpoint"]).unionByName(sketches.merged(days.where("day >= 10"), ["endpoint"]))  # merges of merges
    exact = {r.endpoint: r for r in rows.groupBy("endpoint").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"), F.max("duration_ms").alias("m"), F.collect_list("duration_ms").alias("v")).collect()}
    for r in sketches.told(sketches.merged(halves, ["endpoint"]), ["endpoint"], (0.5, 0.95, 0.99)).collect():
        e = exact[r.endpoint]
        values = np.sort(e.v)
        assert (r.requests, r.max_ms) == (e.n, e.m) and abs(r.users - e.u) <= 0.03 * e.u
        for rank, q in ((0.5, r.p50_ms), (0.95, r.p95_ms), (0.99, r.p99_ms)):
            assert abs(np.searchsorted(values, q) / len(values) - rank) <= 0.01


# --- stored keys ------------------------------------------------------------------------------------------------


def test_a_batch_moves_and_the_store_does_not(spark):
    store = KeyStore(spark, f"keys_{uuid.uuid4().hex[:8]}", "tenant_id string, content_hash string, doc_id long", ["tenant_id", "content_hash"], buckets=4)
    try:
        make = lambda rows: spark.createDataFrame(rows, "tenant_id string, content_hash string, doc_id long, title string")
        first = make([("a", f"h{i % 50}", i, "t") for i in range(200)])
        marked = store.add(first, ["doc_id"])
        assert {r.doc_id for r in marked.where("is_new").collect()} == set(range(50)) and marked.count() == 200
        second = make([("a", f"h{i}", 1000 + i, "t") for i in range(40, 60)] + [("b", "h0", 2000, "t"), ("b", "h0", 1999, "t"), (None, "h0", 5, "t"), ("a", None, 6, "t")])
        assert {r.doc_id for r in store.unseen(second).collect()} == {*range(1050, 1060), 1999, 2000, 5, 6}
        again = store.add(second, ["doc_id"])
        assert {r.doc_id for r in again.where("is_new").collect()} == {*range(1050, 1060), 1999} and store.read().count() == 61
        assert store.add(second, ["doc_id"]).where("is_new").count() == 0
        plan = [line for line in plan_of(store.known(second)).splitlines() if line.strip()]
        scan = next(i for i, line in enumerate(plan) if "Bucketed: true" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        above, at = [], depth(plan[scan])
        for line in reversed(plan[:scan]):  # the operators between the store's files and the join
            if depth(line) < at:
                at = depth(line)
                above.append(line)
        join = next(i for i, line in enumerate(above) if "Join" in line)
        assert not any("Exchange" in line for line in above[:join]) and "SortMergeJoin" in above[join]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {store.name}")


# --- the index --------------------------------------------------------------------------------------------------


def test_a_search_reads_the_partitions_that_it_probes(spark, tmp_path):
    rng = np.random.default_rng(12)
    points = rng.normal(size=(1500, 12)) + 4 * rng.normal(size=(40, 12))[np.arange(1500) % 40]
    chunks = spark.createDataFrame([(i, f"t{i % 3}", p.tolist(), datetime(2024, 1, 1 + i % 28)) for i, p in enumerate(points)], "chunk_id long, tenant_id string, embedding array<double>, until timestamp")
    index = nearest.build_index(chunks, str(tmp_path / "index"), 12)
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    whole = files(index.vectors(spark))
    one = chunks.where("chunk_id = 7").select(F.col("chunk_id").alias("query_id"), "tenant_id", "embedding")
    routed = nearest._route(one, index, index.read(spark, "cells"), 5, nearest.BLOCK, 1)
    some = index.vectors(spark, routed.where("home"))
    assert 0 < len(files(some)) <= len(whole) / 3
    filters = plan_of(some).split("PartitionFilters: [")[1].split("]")[0]
    assert "part#" in filters  # so the other folders aren't opened
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    queries = chunks.where("chunk_id % 15 = 0").select(F.col("chunk_id").alias("query_id"), "tenant_id", "embedding")
    now, got, near = datetime(2024, 1, 14, 12), {}, {}
    for r in nearest.knn(queries, index, 5, now=F.lit(now)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for r in nearest.knn(queries, index, 5, now=F.lit(now), probes=8).orderBy("query_id", "rank").collect():
        near.setdefault(r.query_id, []).append(r.chunk_id)
    hits = 0
    for q in range(0, 1500, 15):
        live = np.array([i for i in range(q % 3, 1500, 3) if datetime(2024, 1, 1 + i % 28) > now])
        d = np.round(1 - unit[live] @ unit[q], 12)
        assert got[q] == live[np.lexsort((live, d))][:5].tolist()
        hits += len(set(near.get(q, [])) & set(got[q]))
    assert hits >= 0.9 * 500


# --- semi-structured values ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("text,want", [
    ('{"k": 69}', []), ("[1]", ["metadata: not an object"]), ("{x", ["metadata: not JSON"]), (None, []), ("{}", []), ('{"a":null,"b":true,"c":1.5}', []),
    ('{"a b":1,"c":[1],"d":{"x":1},"e":"%s"}' % ("y" * 1001), ["metadata: bad key", "metadata: value too long", "metadata: value is not a scalar"]),
    ("{%s}" % ",".join(f'"k{i}":1' for i in range(51)), ["metadata: too many keys"]), ('{"a":"%s"}' % ("[" + "é" * 999), []),
])
def test_metadata(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(variants.metadata_errors(F.col("t")).alias("e")).first().e == want


def test_findings_with_paths_of_faults(spark):
    good = '{"risk_class":"R","category":"PHYSICAL","likelihood":3,"impact":4,"description":"d","recommendation":"r","evidence":"e"}'
    text = '{"findings":[%s,{"risk_class":1,"category":"x","likelihood":9,"impact":"4","description":null,"recommendation":"r","confidence":2},5]}' % good
    r = spark.createDataFrame([(text,)], "t string").select(variants.model_findings(F.col("t")).alias("f")).first().f
    assert [f.risk_class for f in r.findings] == ["R"]
    assert r.errors == ["findings[1].risk_class: not string", "findings[1].category: not allowed", "findings[1].likelihood: out of range", "findings[1].impact: not int", "findings[1].description: missing", "findings[1].confidence: out of range", "findings[1].evidence: missing", "findings[2]: not object"]


# --- strict chunks ------------------------------------------------------------------------------------------------


def test_the_fold_over_lengths_gives_what_the_fold_over_texts_gives(spark):
    """Small limits, so that every way of going on occurs: packing, shipping, flushing, topping up, gaps within an overlap, white tails."""
    from riskframe.operators import chunking

    rng = random.Random(4)
    limits_ = dict(target=40, maximum=56, minimum=28, overlap=9)

    def paragraph():
        n = rng.choice([0, 1, 3, 8, 9, 10, 14, 20, 27, 28, 35, 41, 44, 45, 46, 60, 90])
        return "".join(rng.choice(["a", "b", "é", "漢", " ", " "] if rng.random() < 0.9 else [" "]) for _ in range(n))

    texts = [rng.choice(["", " \n"]) + "".join(paragraph() + rng.choice(["\n\n", "\n \n", "\n \n\n", "\n"]) for _ in range(rng.randrange(0, 14))) for _ in range(700)]
    texts += ["x" * n + "\n\n" + "y" * m for n in (20, 27, 28, 29) for m in range(25, 70)] + ["p" + " " * 44 + "q\n\n" + "z" * 30, None, "", " " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    both = df.select("id", chunking.chunks(F.col("text"), **limits_).alias("slow"), chunking.strict_chunks(F.col("text"), **limits_).alias("fast")).collect()
    for r in both:
        assert r.slow == r.fast, (texts[r.id], r.slow, r.fast)
    assert sum(len(r.fast or []) for r in both) > 2000


def test_strict_chunks_take_time_in_proportion(spark):
    from riskframe.operators import chunking

    taken = []
    for megabytes in (1, 4, 16):
        para = "words of a paragraph, é, and more of them " * 3
        df = spark.range(1).select(F.repeat(F.lit(para + "\n\n"), int(megabytes * 1_000_000 / (len(para) + 2))).alias("text"))
        best = []
        for _ in range(2):
            begun = time.perf_counter()
            n = df.select(F.size(chunking.strict_chunks(F.col("text"))).alias("n")).first().n
            best.append(time.perf_counter() - begun)
        taken.append(min(best))
        assert n > 190 * megabytes
    print("seconds at 1, 4 and 16 MB:", taken)
    assert taken[2] < 8 * taken[1] + 1
