"""The measures of a class are given to its findings last: what is shuffled before does not grow with the catalogue."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as e
from riskframe.operators import enrich, report

CLASSES = [("FIRE", "PHYSICAL", "R-1"), ("WATER", "PHYSICAL", "R-2"), ("EMPTY", "PHYSICAL", "R-3")]
MEASURES = [(f"M{i}", f"title {i}", "who", "day", i) for i in range(40)] + [("m1", "again", "who", "day", 50), ("Z", None, "who", "day", 60)]
APPLIES = [(f"M{i}", "fire" if i % 3 else "water", i) for i in range(40)] + [("M1", "water", 1), ("Z", "WATER", 60)]
FINDINGS = [
    ("r1", 0, 1, "1", "fire", ["m2", "none", "M3", "m2"]), ("r1", 0, 2, "1", "FIRE", None), ("r1", 70, 3, "1", "Water", ["none"]), ("r1", 70, 3, "1", "fire", []),
    ("r2", 1, 1, "", "other", None), ("r2", 2, 1, None, "empty", None), ("r2", 3, 1, "A", None, ["Z"]), ("r3", 1, None, "1", "water", None), ("r3", 1, None, "1", "water", None),
    (None, 1, 1, "1", "fire", None), ("gone", 1, 1, "1", "fire", None),
]


def given(spark):
    findings = spark.createDataFrame(FINDINGS, "report_id string, scene_ix int, finding_ix long, scene_number string, risk_class string, measure_codes array<string>").select(
        "*", F.lit(4).alias("likelihood"), F.lit(4).alias("impact"), F.lit(0.5).alias("confidence"), F.lit("").alias("rule_id"), F.lit("").alias("category"),
        F.lit("d").alias("description"), F.lit(None).cast("string").alias("recommendation"))
    classes = spark.createDataFrame(CLASSES, "risk_class string, category string, rule_id string")
    measure = spark.createDataFrame(MEASURES, "code string, title string, responsible string, due string, ord int")
    applies = spark.createDataFrame(APPLIES, "code string, risk_class string, ord int")
    reports = spark.createDataFrame([("r1", "p", 1), ("r2", "p", None), ("r3", "p", 3), ("none", "p", 4)], "report_id string, project_id string, script_id int")
    whole = enrich.validate_findings(findings, classes, measure, applies)
    return reports, whole, enrich.resolved_findings(findings, classes, measure), enrich.measures_by_class(measure, applies)


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_the_same_with_the_lists_given_last(spark):
    reports, whole, bare, by_class = given(spark)
    now = rows(report.push_payload(reports, bare, by_class=by_class))
    assert now == rows(report.push_payload(reports, whole)) and sum(r.count("  + M") for r in now) > 60
    assert rows(report.assessment_lines(reports, bare, by_class=by_class)) == rows(report.assessment_lines(reports, whole))


def test_payload_parts_are_counted_without_the_lists(spark, data):
    """the lists went through every shuffle, and each line of theirs was a row."""
    shown = plan(e.queries()["a11_push_payload"](spark, data))
    assert "suggested" not in shown and not re.search(r"Generate posexplode", shown)
