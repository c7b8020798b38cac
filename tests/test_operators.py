"""Cases of their own: what must not be dropped, cut, or depend on size."""

import base64
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe import limits as L
from riskframe.functions.hashing import decrypt_column, encrypt_column
from riskframe.functions.network import error_class
from riskframe.operators import chunking, classify, enrich, knowledge, nearest, report, segment, structured, validate
from riskframe.sources import readers, sinks
from riskframe.sources.pages import assemble_pages


def test_all_of_many_keys_are_used(spark):
    keys = spark.range(1500).select(F.col("id").cast("string").alias("key_id"), F.lpad(F.col("id").cast("string"), 16, "k").cast("binary").alias("key"))
    docs = keys.select("key_id", F.concat(F.lit("text "), "key_id").alias("text")).union(spark.createDataFrame([("none", "left alone")], "key_id string, text string"))
    sealed = encrypt_column(docs, "text", keys)
    assert sealed.where("text IS NOT NULL").count() == 1500
    lost = sealed.where("text_error IS NOT NULL").collect()
    assert [(r.key_id, r.text_pending) for r in lost] == [("none", "left alone")]
    back = decrypt_column(sealed.drop("text_pending", "text_error"), "text", keys)
    assert back.where("readable AND text = concat('text ', key_id)").count() == 1500
    wrong = decrypt_column(sealed.where("key_id = '3'").select("key_id", "text"), "text", keys.withColumn("key", F.lit(b"x" * 16)))
    assert [(r.readable, r.text, r.text_encrypted is not None) for r in wrong.collect()] == [(False, None, True)]


@pytest.mark.parametrize("codes", [5, 500])
def test_a_repeated_measure_code_gives_one_measure(spark, codes):
    rows = [(f"M{i}", f"first {i}", "who", "day", i) for i in range(codes)] + [("m1", "again", "who", "day", codes + 7)]
    measure = spark.createDataFrame(rows, "code string, title string, responsible string, due string, ord int")
    findings = spark.createDataFrame([(1, ["m1", "none", "M0", "m1"]), (1, None), (2, [])], "report_id int, measure_codes array<string>")
    got = sorted((r.report_id, [m.title for m in r.measures]) for r in enrich.resolve_measures(findings, measure).collect())
    assert got == [(1, []), (1, ["first 1", "first 0", "first 1"]), (2, [])]


@pytest.mark.parametrize("count", [5, 6000])
def test_reports_have_the_same_shape_at_any_size(spark, count):
    rows = spark.range(count).select(
        F.lit("r").alias("report_id"), (F.col("id") % 300).cast("int").alias("scene_ix"), F.col("id").alias("finding_ix"), (F.col("id") % 300).cast("string").alias("scene_number"),
        F.lit("high").alias("risk_level"), F.lit("FIRE").alias("risk_class"), F.lit("").alias("rule_id"), F.lit("d").alias("description"), F.lit(None).cast("string").alias("recommendation"),
        F.array().cast("array<struct<code:string,title:string,responsible:string,due:string>>").alias("measures"))
    reports = spark.createDataFrame([("r", "p", None), ("empty", "p", 3)], "report_id string, project_id string, script_id int")
    parts = report.push_payload(reports, rows).orderBy(*report.PART_KEYS).collect()
    mine = [p for p in parts if p.report_id == "r"]
    assert len(mine) == 1 + min(count, 300) and sum(p.assessment.count("[HIGH]") for p in mine) == count and {p.script_id for p in mine} == {-1}
    assert [p.assessment.splitlines()[-1] for p in parts if p.report_id == "empty"] == ["Nothing was found in this script."]


def test_all_pages_are_kept(spark):
    pages = spark.range(501).select(F.lit(1).alias("script_id"), (F.col("id") + 1).cast("int").alias("page_no"), F.format_string("page text number %d", "id").alias("text"))
    whole = assemble_pages(pages).first()
    assert len(whole.pages) == 501 and whole.warnings == []
    cut = assemble_pages(pages, max_pages=500).first()
    assert len(cut.pages) == 500 and cut.warnings == ["501 pages given, the first 500 were used"]


def test_bodies_are_checked_whole(spark):
    bodies = [b"a" * 999 + "é".encode() + b"b" * 10, b"a" * 2000 + b"\xff", b"a" * 2000 + b"\x00", b"plain"]
    rows = spark.createDataFrame([(i, base64.b64encode(b).decode()) for i, b in enumerate(bodies)], "id int, content string")
    got = {r.id: r.e for r in rows.select("id", F.array_compact(validate.body_errors(F.col("content"), F.lit("fdx"))).alias("e")).collect()}
    assert got == {0: [], 1: ["content: not UTF-8 text"], 2: ["content: null bytes"], 3: []}


def test_strict_chunks(spark):
    texts = ["x" * 9000, "a b. " * 960, "p\n\n" * 50, "q" * 4790 + "\n\n" + "r" * 20, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    chunks = chunking.chunk_documents(rows).collect()
    assert all(c.length <= L.CHUNK_MAX for c in chunks)
    for i, text in enumerate(texts):
        mine = [c.chunk_text for c in sorted(chunks, key=lambda c: c.chunk_no) if c.doc_id == i]
        assert not any(b in a[-L.CHUNK_OVERLAP :] for a, b in zip(mine, mine[1:]))
        assert sum(len(m.replace("\n", "")) for m in mine) >= len(text.replace("\n", "").strip())


def test_listing_is_newest_first_with_total(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("t").alias("tenant_id"), F.lit("x").alias("title"), F.lit("s").alias("source"), F.array(F.lit("a")).alias("tags"), F.lit("u").alias("uploaded_by"),
                                      F.timestamp_seconds(F.col("id") % 7).alias("created_at"), F.timestamp_seconds(F.lit(10**9)).alias("expires_at"))
        chunks = docs.select("doc_id")
        want = [r.doc_id for r in docs.orderBy(F.desc("created_at"), "doc_id").collect()]
        page = knowledge.list_documents(docs, chunks, "t", limit=20).collect()
        assert [r.doc_id for r in page] == want[:20] and {r.total for r in page} == {60}
        after = knowledge.list_documents(docs, chunks, "t", limit=20, after=(page[-1].created_at, page[-1].doc_id)).collect()
        assert [r.doc_id for r in after] == want[20:40]
        with pytest.raises(ValueError):
            knowledge.list_documents(docs, chunks, "t", limit=501)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_search_takes_the_nearest_live_chunks(spark, tmp_path):
    """The chunks next to every query have expired, and a whole cluster has."""
    rng = np.random.default_rng(9)
    points = rng.normal(size=(400, 8)) + 3 * rng.normal(size=(6, 8))[np.arange(400) % 6]
    expired = (np.arange(400) % 6 == 0) | (rng.random(400) < 0.5)
    chunks = spark.createDataFrame([(i, i % 2, i, f"text {i}", p.tolist()) for i, p in enumerate(points)], "chunk_id long, tenant_id long, doc_id long, chunk_text string, embedding array<double>")
    until = [datetime(2024, 1, 1) if e else datetime(2026, 1, 1) for e in expired]
    docs = spark.createDataFrame([(i, f"title {i}", ["x"], t) for i, t in enumerate(until) if i != 5], "doc_id long, title string, tags array<string>, expires_at timestamp")
    index = nearest.build_index(chunks, str(tmp_path / "index"), 8)
    queries = chunks.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "tenant_id", "embedding")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    want = {}
    for q in range(0, 400, 10):
        same = np.array([i for i in range(q % 2, 400, 2) if not expired[i] and i != 5])
        d = np.round(1 - unit[same] @ unit[q], 12)
        want[q] = same[np.lexsort((same, d))][:7].tolist()
    got = {}
    for r in nearest.search(queries, docs, chunks, index, F.lit(datetime(2025, 1, 1)), 7).orderBy("query_id", "rank").collect():
        assert r.title == f"title {r.chunk_id}" and r.chunk_text == f"text {r.chunk_id}"
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == want


def test_nearest_exact_and_probed(spark, tmp_path):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(900, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 900)]
    rows = [(i, i % 2, p.tolist()) for i, p in enumerate(points)] + [(5000, 0, [1.0]), (5001, 0, None), (5002, 1, [0.0] * 16), (5003, 1, [float("nan")] * 16)]
    chunks = spark.createDataFrame(rows, "chunk_id long, tenant_id long, embedding array<double>")
    index = nearest.build_index(chunks, str(tmp_path / "index"), 16)
    assert {r.chunk_id: r.reason for r in index.read(spark, "rejected").collect()} == {5000: "wrong length", 5001: "missing", 5002: "zero", 5003: "not a number"}
    queries = chunks.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    want = {}
    for q in range(0, 900, 20):
        same = np.arange(q % 2, 900, 2)
        d = np.round(1 - unit[same] @ unit[q], 12)
        want[q] = same[np.lexsort((same, d))][:7].tolist()
    def found(probes, block=nearest.BLOCK):
        out = {}
        for r in nearest.knn(queries, index, 7, probes=probes, block=block).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.chunk_id)
        return out
    assert found(None) == want and found(None, block=10) == want
    recall = np.mean([len(set(v) & set(found_v)) / 7 for v, found_v in ((want[q], f) for q, f in found(6).items())])
    assert recall >= 0.9
    assert nearest.rejected_queries(queries.union(chunks.where("chunk_id = 5001").withColumnRenamed("chunk_id", "query_id")), 16).count() == 2


def test_a_bad_answer_costs_only_its_row(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "scene_ix int").coalesce(1)

    def short(pdf: pd.DataFrame) -> list:
        return ["{}"] * (len(pdf) - 1) if len(pdf) > 1 else ([] if pdf["scene_ix"].iloc[0] == 3 else ["{}"])

    got = {r.scene_ix: (r.model_json, r.error) for r in classify.call_model(rows, short).collect()}
    assert got[3] == (None, "ValueError") and all(v == ("{}", None) for k, v in got.items() if k != 3)
    vectors = classify.embed(rows.select(F.col("scene_ix").cast("string").alias("text")), lambda s: [[1.0, float(t)] if t != "4" else None for t in s]).collect()
    assert {r.text: r.error for r in vectors}["4"] == "not implemented" and sum(r.embedding is not None for r in vectors) == 5


def test_nothing_is_cut_unless_asked(spark):
    long = "word " * 5000
    row = spark.createDataFrame([(long,)], "t string")
    got = row.select(classify.embedding_input(F.col("t")).alias("whole"), classify.embedding_input(F.col("t"), 100).alias("cut")).first()
    assert got.whole.text == long.strip() and not got.whole.truncated and len(got.cut.text) == 100 and got.cut.truncated
    slices = classify.embedding_slices(row, "t", 1000).orderBy("slice_no").collect()
    assert "".join(r.slice for r in slices) == long.strip()


def test_structured_scenes_and_titles(spark):
    outputs = spark.createDataFrame([
        (1, 0, '```json\n{"title": " The Title "}\n```'), (1, 1, '{"location": " ", "location_type": "int", "time_of_day": "noon", "characters": [" A ", "", null], "dialogue": [{"character": "A", "text": "hi"}, {"character": "", "text": "x"}, {"character": "B", "text": null}]}'),
        (2, 0, "not json"), (3, 0, None)], "script_id int, block_index int, model_json string")
    got = {(r.script_id, r.block_index): r for r in structured.normalise_scenes(outputs).collect()}
    one = got[1, 1]
    assert (one.location, one.location_type, one.time_of_day, one.characters, one.action_text) == ("UNKNOWN", "INT", "UNKNOWN", ["A"], "") and [d.text for d in one.dialogue] == ["hi"]
    assert got[2, 0].parse_error == "not JSON" and got[3, 0].parse_error == "not JSON" and one.parse_error is None
    blocks = spark.createDataFrame([(1, 0, True), (1, 1, False), (2, 0, True)], "script_id int, block_index int, is_preamble boolean")
    assert {r.script_id: r.title for r in structured.script_titles(blocks, outputs).collect()} == {1: "The Title", 2: None}


def test_files_in_and_out(spark, tmp_path):
    folder = tmp_path / "kb"
    folder.mkdir()
    for name, body in (("b_second-one.md", b"---\ntitle: Named\ntags: [x]\n---\nBody"), ("a.txt", b"Body"), ("c.txt", b" \n"), ("d.bin", b"x"), ("e.txt", b"\xff\xfe")):
        (folder / name).write_bytes(body)
    files = readers.read_kb_files(spark, str(folder))
    assert [r.path.rsplit("/", 1)[1] for r in files.collect()] == ["a.txt", "b_second-one.md", "c.txt", "d.bin", "e.txt"]
    stored = spark.createDataFrame([], "tenant_id string, content_hash string")
    fresh, outcome = readers.seed_kb(files, stored, "t", F.current_timestamp())
    assert {r.path.rsplit("/", 1)[1]: r.outcome for r in outcome.collect()} == {"a.txt": "created", "b_second-one.md": "skipped", "c.txt": "failed", "d.bin": "failed", "e.txt": "failed"}
    assert [(r.title, r.tags) for r in fresh.collect()] == [("a", ["placeholder"])]
    good, bad = readers.read_scripts(spark, str(folder))
    assert good.count() == 0 and bad.count() == 5 and readers.read_scripts(spark, str(folder), "FDX")[0].count() == 5
    with pytest.raises(ValueError):
        sinks.write_metadata(spark.createDataFrame([("a", "b")], "job_id string, text string"), str(tmp_path / "m"))
    sinks.write_metadata(spark.createDataFrame([("a", 1)], "job_id string, n int"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1


def test_markers_and_error_classes(spark):
    text = "Title\nINT. / EXT. ROOM\na\nINNEN HAUS\nb\nINNENHOF is no marker\n 12 EXT. STREET\nc"
    blocks = segment.split_scenes(spark.createDataFrame([(1, text)], "script_id int, full_text string")).orderBy("block_index").collect()
    assert [b.heading_line for b in blocks] == ["", "INT. / EXT. ROOM", "INNEN HAUS", "12 EXT. STREET"]
    names = spark.createDataFrame([("db.pool.Timeout",), ("db.Error",), ("other",)], "n string")
    assert [r[0] for r in names.select(error_class(F.col("n"), [("db.", "store"), ("db.pool.", "pool")])).collect()] == ["pool", "store", None]


def test_warnings_of_pages_and_split_are_joined(spark):
    pages = spark.createDataFrame([(1, 1, "a page of plain text"), (1, 2, "x"), (1, 3, "another page of text"), (2, 1, "INT. ROOM and a text that is long enough to pass without a word"), (3, 1, "")], "script_id int, page_no int, text string")
    scripts = assemble_pages(pages)
    summary = segment.split_summary(segment.split_scenes(scripts.select("script_id", "full_text", "pages"), pages="pages"))
    got = {r.script_id: r.warnings for r in segment.with_split_warnings(scripts, summary).collect()}
    assert got == {1: ["very little text, results may be incomplete", "pages without text: 2", segment.FALLBACK_WARNING], 2: [], 3: ["pages without text: 1"]}
