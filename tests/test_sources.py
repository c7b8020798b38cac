"""Readers and writers as round trips."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from riskframe.operators import report
from riskframe.sources import readers, sinks

LINES = [
    {"submission_id": "a", "ts": "2024-01-01T10:00:00Z", "script_content": base64.b64encode("é text".encode()).decode(), "script_format": "fdx", "project_id": "p", "script_id": 7, "metadata": {"k": "1"}, "priority": 3},
    {"submission_id": "b", "ts": "2024-01-01T11:00:00Z", "script_content": "*no*", "script_format": "pdf", "unknown": [1]},
    {"submission_id": "c"},
]


def test_submissions_are_read_by_their_schema(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.json").write_text("\n".join(map(json.dumps, LINES[:2])))
    (folder / "two.json").write_text(json.dumps(LINES[2]))
    got = {r.submission_id: r for r in readers.read_submissions(spark, str(folder)).collect()}
    assert bytes(got["a"].body).decode() == "é text" and got["a"].metadata == {"k": "1"} and (got["a"].script_id, got["a"].priority) == (7, 3)
    assert got["b"].body is None and got["b"].script_content == "*no*" and got["c"].body is None and set(got) == {"a", "b", "c"}
    rows = readers.stream_submissions(spark, str(folder))
    query = rows.writeStream.format("memory").queryName("submissions").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.table("submissions").collect())) == sorted(map(str, got.values()))


def test_reports_are_written_by_project(spark, tmp_path):
    headers = spark.createDataFrame([("r1", "p 1", 2), ("r2", "p 1", 0), ("r3", "p/2", 130)], "report_id string, project_id string, total_findings long")
    findings = spark.createDataFrame([("r1", i, 0, f"d{i}") for i in (1, 0)] + [("r3", i, 0, "x") for i in range(130)], "report_id string, scene_ix int, finding_ix long, description string")
    parts = report.report_parts(findings.withColumn("scene", F.col("scene_ix")))
    sinks.write_reports(headers, parts, str(tmp_path / "out"))
    rows = spark.read.json(str(tmp_path / "out"), schema="project_id string, report_id string, part_no long, json string")
    found = [(r.project_id, r.report_id, r.part_no, json.loads(r.json)) for r in rows.collect()]
    assert {(p, r, n) for p, r, n, _ in found} == {("p 1", "r1", -1), ("p 1", "r1", 0), ("p 1", "r2", -1), ("p/2", "r3", -1), ("p/2", "r3", 0), ("p/2", "r3", 1), ("p/2", "r3", 2)}
    one = next(j for _, r, n, j in found if (r, n) == ("r1", 0))
    assert [f["description"] for f in one["findings"]] == ["d0", "d1"]
    assert next(j for _, r, n, j in found if (r, n) == ("r3", -1))["total_findings"] == 130
    assert sum(len(j["findings"]) for _, r, n, j in found if r == "r3" and n >= 0) == 130


def test_metadata_takes_no_content(spark, tmp_path):
    rows = spark.createDataFrame([("j", "d")], "job_id string, day string")
    sinks.write_metadata(rows, str(tmp_path / "jobs"), "day")
    sinks.write_metadata(rows, str(tmp_path / "jobs"), "day")
    assert spark.read.parquet(str(tmp_path / "jobs")).count() == 2
    for column in ("text", "script_content", "chunk_text", "description"):
        with pytest.raises(ValueError):
            sinks.write_metadata(rows.withColumn(column, F.lit("x")), str(tmp_path / "jobs"))
