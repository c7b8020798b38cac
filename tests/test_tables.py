"""Tables that change, and several tables that appear together."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskframe.sources.files import Store
from riskframe.sources.tables import KeyedTable, KnowledgeStore, LatestTable
from riskframe.streaming import published


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(table):
    return {f"{p}/{f}": t for p in table.store.names("") if p.startswith("part=") for f, t in table.store.times(p).items() if f.endswith(".parquet")}


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


EVENTS = [
    ("j1", 3, "completed", 100, None), ("j1", 1, "pending", None, None), ("j2", 2, "running", 40, None), ("j1", 2, "running", 90, None), ("j2", 1, "pending", 0, None),
    ("j2", 5, "failed", None, "broken"), ("j3", 1, "pending", None, None), (None, 1, "pending", None, None), ("j2", 4, "running", 60, None), ("j1", 0, "queued", None, "early"),
]
WANT = [("j1", "completed", 100, "early"), ("j2", "failed", 60, "broken"), ("j3", "pending", None, None)]
FIELDS = {"status": "string", "progress": "int", "error": "string"}


def frame(spark, rows):
    return spark.createDataFrame([(k, at(s), *rest) for k, s, *rest in rows], "job_id string, ts timestamp, status string, progress int, error string")


def test_latest_state_in_batches_of_any_order(spark, tmp_path):
    for n, order in enumerate((EVENTS, EVENTS[::-1])):
        table = LatestTable(spark, str(tmp_path / f"jobs{n}"), "job_id", FIELDS, buckets=4)
        for i in range(0, len(order), 3):
            table.apply(frame(spark, order[i : i + 3]))
        assert rows_of(table.read().select("job_id", "status", "progress", "error")) == WANT
        table.apply(frame(spark, order[:4]))  # once more
        assert rows_of(table.read().select("job_id", "status", "progress", "error")) == WANT


def test_only_the_parts_of_the_keys_are_rewritten(spark, tmp_path):
    table = LatestTable(spark, str(tmp_path / "jobs"), "job_id", {"status": "string"}, buckets=8)
    table.apply(spark.createDataFrame([(f"j{i}", at(0), "new") for i in range(200)], "job_id string, ts timestamp, status string"))
    before = files(table.table)
    assert len(before) == 8
    assert table.apply(spark.createDataFrame([("j7", at(1), "done")], "job_id string, ts timestamp, status string")) == 1
    after = files(table.table)
    assert len(after) == 8 and len(set(before.items()) & set(after.items())) == 7
    assert rows_of(table.read().groupBy("status").count()) == [("done", 1), ("new", 199)]
    assert table.apply(spark.createDataFrame([], "job_id string, ts timestamp, status string")) == 0 and files(table.table) == after


def test_a_stream_of_status_leaves_one_row_a_job(spark, tmp_path):
    folder = str(tmp_path / "events")
    for i in range(0, len(EVENTS), 2):
        frame(spark, EVENTS[i : i + 2]).coalesce(1).write.mode("append").parquet(folder)
    table = LatestTable(spark, str(tmp_path / "jobs"), "job_id", FIELDS, buckets=3)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    table.run(stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert rows_of(table.read().select("job_id", "status", "progress", "error")) == WANT
    assert len(files(table.table)) <= 3


def test_compaction(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, v int", "k", buckets=2)
    for i in range(3):  # files that others appended
        spark.createDataFrame([(f"k{i}{j}", j) for j in range(9)], "k string, v int").withColumn("part", table.part()).coalesce(1).write.mode("append").partitionBy("part").parquet(table.folder)
    want = rows_of(table.read())
    assert len(want) == 27 and len(files(table)) == 6
    assert table.compact() and len(files(table)) == 2 and rows_of(table.read()) == want and table.compact() == []


DOC = "doc_id string, tenant_id string, tags array<string>, expires_at timestamp"
CHUNK = "doc_id string, tenant_id string, chunk_id string, chunk_text string"


def filled(spark, tmp_path, n=120):
    store = KnowledgeStore(spark, str(tmp_path / "kb"), DOC, CHUNK, buckets=2)
    docs = [(f"d{i}", f"t/{i % 4}", ["old"] if i % 3 else ["old", "held"], at(i * 10)) for i in range(n)]
    chunks = [(d, t, f"{d}-{k}", f"text {k}") for d, t, _, _ in docs for k in range(3)]
    store.add(spark.createDataFrame(docs, DOC), spark.createDataFrame(chunks, CHUNK))
    return store, docs, chunks


def test_deletes_are_physical_and_in_step(spark, tmp_path):
    store, docs, chunks = filled(spark, tmp_path)
    assert rows_of(store.documents.read()) == sorted(docs, key=repr) and rows_of(store.chunks.read()) == sorted(chunks, key=repr)
    before = files(store.documents), files(store.chunks)
    doomed = [d[0] for d in docs if d[1] == "t/1" and "held" in d[2]]
    assert store.remove_by_tag("t/1", "held") == {"documents": len(doomed), "chunks": 3 * len(doomed)}
    assert rows_of(store.documents.read()) == sorted([d for d in docs if d[0] not in doomed], key=repr)
    assert rows_of(store.chunks.read()) == sorted([c for c in chunks if c[0] not in doomed], key=repr)
    for old, table in zip(before, (store.documents, store.chunks)):
        now = files(table)
        assert {f: t for f, t in old.items() if "1~" not in f} == {f: t for f, t in now.items() if "1~" not in f}
        assert not any(f in now for f in old if "1~" in f)
    assert store.remove_by_tag("t/1", "held") == {"documents": 0, "chunks": 0}
    with pytest.raises(ValueError):
        store.remove_by_tag("t/1", " ")
    foreign = spark.createDataFrame([("d0", "t/2"), ("nothing", "t/0")], "doc_id string, tenant_id string")
    assert store.remove(foreign) == {"documents": 0, "chunks": 0}


def test_purge_empties_parts_and_repeats(spark, tmp_path):
    store, docs, _ = filled(spark, tmp_path)
    now = F.lit(at(595)).cast("timestamp")
    assert store.purge_expired(now) == {"documents": 60, "chunks": 180} and store.purge_expired(now) == {"documents": 0, "chunks": 0}
    assert store.purge_expired(F.lit(at(10**6)).cast("timestamp")) == {"documents": 60, "chunks": 180}
    assert store.documents.read().count() == 0 and files(store.documents) == {} and files(store.chunks) == {}


def test_a_delete_that_failed_between_the_tables_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    store, docs, _ = filled(spark, tmp_path)
    monkeypatch.setattr(store.documents, "delete", lambda keys: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.remove_by_tag("t/0", "held")
    monkeypatch.undo()
    assert store.documents.of_group("t/0").count() == 30 and store.chunks.of_group("t/0").count() < 90
    assert store.remove_by_tag("t/0", "held") == {"documents": 10, "chunks": 0} and store.chunks.of_group("t/0").count() == 60


def test_reseeding_replaces_documents_of_the_same_id(spark, tmp_path):
    store, docs, _ = filled(spark, tmp_path, 12)
    fresh = spark.createDataFrame([("d0", "t/0", ["held"], at(1)), ("new", "t/0", ["held"], at(1))], DOC)
    pieces = spark.createDataFrame([("d0", "t/0", "d0-x", "x")], CHUNK)
    assert store.reseed(fresh, pieces, "t/0", "held") == {"documents": 1, "chunks": 3}
    assert rows_of(store.documents.of_group("t/0").select("doc_id")) == [("d0",), ("d4",), ("d8",), ("new",)]
    assert rows_of(store.chunks.of_group("t/0").where("doc_id = 'd0'").select("chunk_id")) == [("d0-x",)]


def test_a_batch_is_published_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "out")
    good = spark.range(3).toDF("x")

    def fails(attempt):
        attempt.write("a", good)
        raise OSError("lost between two tables")

    def works(attempt):
        attempt.write("a", good)
        attempt.write("b", good.where("x > 0"))
        attempt.write("c", good, keep=False)

    assert published.read(spark, folder, "a") is None
    with pytest.raises(OSError):
        published.publish(spark, folder, 0, fails)
    assert published.read(spark, folder, "a") is None
    assert published.publish(spark, folder, 0, works) and not published.publish(spark, folder, 0, works)
    assert rows_of(published.read(spark, folder, "a")) == [(0, 0), (1, 0), (2, 0)] and published.read(spark, folder, "b").count() == 2 and published.read(spark, folder, "c") is None
    assert published.publish(spark, folder, 12, works)
    assert rows_of(published.read(spark, folder, "b")) == [(1, 0), (1, 12), (2, 0), (2, 12)] and [m["batch"] for m in published.commits(spark, folder)] == [0, 12]
    assert len(published.sweep(spark, folder)) == 1 and published.sweep(spark, folder) == [] and published.read(spark, folder, "a").count() == 6


def test_of_two_attempts_the_first_counts(spark, tmp_path):
    folder = str(tmp_path / "out")

    def slow(attempt):
        attempt.write("a", spark.range(1).toDF("x"))
        published.publish(spark, folder, 5, lambda other: other.write("a", spark.range(7, 8).toDF("x")))

    assert not published.publish(spark, folder, 5, slow)
    assert rows_of(published.read(spark, folder, "a")) == [(7, 5)] and published.sweep(spark, folder) == []


def test_files_are_made_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.put_new("d/x", "one") and not store.put_new("d/x", "two") and (tmp_path / "s/d/x").read_text() == "one" and store.names("d") == ["x"]
