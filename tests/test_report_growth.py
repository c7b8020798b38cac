"""Reports at size: what a query does not show is neither shuffled nor put together, and nothing is lost by that."""

from collections import defaultdict

from pyspark.sql import functions as F

import __spark_entry__ as e
from riskframe.operators import enrich, report
from test_class_measures import given, plan


def test_parts_in_order_are_the_lines_in_order(spark):
    reports, whole, bare, by_class = given(spark)
    lines, parts = defaultdict(list), defaultdict(list)
    order = ["section", "scene_rank", "first_ix", "first_fx", "scene_label", "scene_ix", "finding_ix", "line_no"]
    placed = report.assessment_lines(reports, whole).withColumn("scene_ix", F.when(F.col("scene_ix") < 0, F.col("first_ix")).otherwise(F.col("scene_ix")))
    for r in placed.orderBy(*[F.asc_nulls_first(c) for c in order], "line").collect():
        lines[r.report_id].append(r.line)
    for r in report.assessment_parts(reports, bare, by_class=by_class).orderBy(*[F.asc_nulls_first(c) for c in report.PART_KEYS]).collect():
        parts[r.report_id].append(r.text)
    assert set(lines) == {"r1", "r2", "r3", "none"} and len(parts["r1"]) == 3
    for k in ("r1", "r2", "none"):  # in r3 two findings are the same
        assert "\n".join(parts[k]) == "\n".join(x for x in lines[k] if x is not None)
    assert sorted("\n".join(parts["r3"]).split("\n")) == sorted(x for x in lines["r3"] if x is not None)


def test_counting_parts_does_not_place_scenes(spark, data):
    """where each scene stands was worked out, and joined to every finding, for a count."""
    assert "first_seen" not in plan(e.queries()["a11_push_payload"](spark, data))


def test_nested_parts_hold_a_class_list_once(spark):
    """each finding of a part carried the list of its class through the shuffle that nests them."""
    _, whole, bare, by_class = given(spark)
    want = {(r.report_id, r.part_no): r.findings for r in report.report_parts(whole).collect()}
    found = report.report_parts(bare, by_class=by_class)
    assert "class_measures" in found.columns and "suggested" not in plan(found.drop("class_measures"))
    got = found.collect()
    assert len(got) == len(want)
    for r in got:
        full = [f.measures or (r.class_measures.get(f.risk_class, []) if f.is_known_class else []) for f in r.findings]
        assert full == [f.measures for f in want[r.report_id, r.part_no]]
        assert sum(map(len, full)) == 0 or r.class_measures or any(f.measures for f in r.findings)


def test_parts_query_moves_no_class_list(spark, data):
    assert "suggested" not in plan(e.queries()["e3_report_parts"](spark, data))


def test_codes_of_classes_are_joined_as_text(spark):
    """the codes of a class were put together for each finding, from a list of whole measures that was joined to it."""
    _, whole, bare, by_class = given(spark)
    codes = F.array_join(F.transform("measures", lambda m: m["code"]), ",")
    show = lambda df: sorted(map(repr, df.select("report_id", "scene_ix", "finding_ix", "risk_class", "codes").collect()))
    got = enrich.measure_codes(bare, by_class, "report_id")
    assert show(got) == show(whole.withColumn("codes", codes)) and "_codes" in plan(got)


def test_a_task_writes_the_text_of_one_class(spark):
    """texts of several classes and those of findings' own codes came in one task, whose Parquet writer held them by the ten thousand."""
    _, _, bare, by_class = given(spark)
    whole = {r.c for r in by_class.select(F.array_join(F.transform("suggested", lambda m: m["code"]), ",").alias("c")).collect()}
    written = defaultdict(set)
    for r in enrich.measure_codes(bare, by_class, "report_id").select("codes", F.spark_partition_id().alias("task")).collect():
        written[r.task].add(r.codes if r.codes in whole else "own")
    assert all(len(texts) == 1 for texts in written.values()) and set().union(*written.values()) == whole | {"own"}


def test_checklist_of_shared_measures(spark):
    """what a report lists is each code once, also where its classes share codes, or it names one that they suggest."""
    findings = spark.createDataFrame(
        [("a", "X", True, ["m1", "no"]), ("a", "X", True, None), ("a", "Y", True, ["no"]), ("a", "W", True, []), ("b", "Y", True, ["Z9", "m5", ""]), ("b", "V", False, None),
         ("c", "X", True, [""]), (None, "X", True, None), (None, "Y", True, ["M1"]), ("d", "", False, None), ("e", "Y", True, None), ("e", "Z", True, None)],
        "report_id string, risk_class string, is_known_class boolean, measure_codes array<string>")
    measure = spark.createDataFrame([("M1", "one", "w", "d", 3), ("m1", "other", "w", "d", 2), ("M2", "two", "w", None, 1), ("M5", None, "w", "d", 1), ("", "none", "w", "d", 1), (None, "null", "w", "d", 1)],
                                    "code string, title string, responsible string, due string, ord int")
    applies = spark.createDataFrame([("M1", "x"), ("m1", "X"), ("M2", "X"), ("M2", "Y"), ("M1", "Y"), ("M5", "Y"), ("gone", "X"), ("", "X"), (None, "X"), ("M5", None), ("M2", "Z")], "code string, risk_class string")
    got = report.suggested_checklist(findings, measure, applies)
    whole = sorted((r.report_id or "", r.code, r.title, r.responsible, r.due) for r in got.collect())
    one, two, five = ("M1", "other", "w", "d"), ("M2", "two", "w", None), ("M5", None, "w", "d")
    assert whole == sorted([("a", *one), ("a", *two), ("a", *five), ("b", *five), ("", *one), ("", *two), ("e", *one), ("e", *two), ("e", *five)], key=lambda r: r[:2])
    assert [*report.suggested_checklist(findings.limit(0), measure, applies).columns] == ["report_id", "code", "title", "responsible", "due"]


def test_checklist_rows_are_not_compared_by_a_shuffle(spark, data):
    """the measures of all classes of all reports were dealt out once more to drop repeats, and again for their titles."""
    shown = plan(e.queries()["e10_measure_checklist"](spark, data))
    assert shown.startswith("Union") and "Generate inline" in shown


def test_checklist_reads_findings_twice(spark, data):
    """F1: findings were read and scored five times, and Spark chose so few tasks for what classes suggest that one wrote a fifth of it."""
    found = e.queries()["e10_measure_checklist"](spark, data)
    assert "RepartitionByExpression [name" in plan(found)
    found.collect()
    ran = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert 0 < ran.count("FileScan parquet [l_") <= 2


def test_lines_of_classes_are_counted_before_they_are_written(spark, data):
    """every line of what a class suggests was dealt out once for each finding that falls back on it, to be counted."""
    shown = plan(e.queries()["i10_assessment_lines"](spark, data))
    assert shown.startswith("Union") and "applies" in shown


def test_lines_of_classes_are_written_in_many_tasks(spark, data):
    """Spark chose the tasks by what they read, and one of twelve wrote for longer than all others together; scenes and lines were counted apart."""
    shown = plan(e.queries()["i10_assessment_lines"](spark, data))
    assert "RepartitionByExpression [risk_class" in shown and "first_seen" not in shown and "Generate explode(array(Scene" not in shown
    assert shown.count("explode(array_compact") == 0


def test_counts_of_shared_and_repeated_lines(spark):
    """a line of several classes, one that findings name or say themselves, and one that a class has twice, each counted once with all."""
    findings = spark.createDataFrame(
        [("a", 0, 1, "1", "x", ["m1", "no", "m1"], None), ("a", 0, 2, "1", "X", None, "d"), ("a", 1, 3, None, "x", ["no"], "d"), ("a", 1, 3, "2", "y", [], "+ M3: three [w, d]"), ("a", 1, 3, "2", "w", None, ""),
         ("b", 1, 1, "", "y", None, "+ M9: nine [w, d]"), ("b", 1, 1, "", "y", None, "+ M9: nine [w, d]"), ("b", 2, 1, "1", "x", [None, "m2"], None), ("c", 1, 1, "1", "x", ["M3", "M4"], None), ("c", 1, 1, "1", "none", None, "+ M1: one [w, d]"),
         (None, 1, 1, "1", "x", None, "d")],
        "report_id string, scene_ix int, finding_ix long, scene_number string, risk_class string, measure_codes array<string>, description string").select(
        "*", F.lit(4).alias("likelihood"), F.lit(4).alias("impact"), F.lit(0.5).alias("confidence"), F.lit("").alias("rule_id"), F.lit("").alias("category"), F.lit("soon").alias("recommendation"))
    classes = spark.createDataFrame([("X", "c", "R-1"), ("Y", "c", "R-2"), ("W", "c", "R-3")], "risk_class string, category string, rule_id string")
    measure = spark.createDataFrame([("M1", "one", "w", "d", 1), ("M2", "two", "w", "d", 2), ("M2", "two", "w", "d", 2), ("M3", "three", "w", "d", 3), ("M4", None, "w", "d", 4)],
                                    "code string, title string, responsible string, due string, ord int")
    applies = spark.createDataFrame([("M1", "x"), ("M1", "Y"), ("M2", "X"), ("M3", "Y"), ("M2", "y"), ("M4", "x"), ("gone", "x"), ("M1", None)], "code string, risk_class string")
    reports = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", None), ("empty", "p"), (None, "p")], "report_id string, project_id string")
    whole = enrich.validate_findings(findings, classes, measure, applies)
    lines = report.assessment_lines(reports, whole).where("line IS NOT NULL")
    want = {(r.report_id, r.section, r.line): r["count"] for r in lines.groupBy("report_id", "section", "line").count().collect()}
    known = enrich.enrich_findings(enrich.apply_defaults(findings), classes)
    got = report.assessment_line_counts(reports, known, measure, enrich.measures_by_class(measure, applies)).collect()
    assert len(got) == len(want) and {(r.report_id, r.section, r.line): r.n for r in got} == want
    assert want["a", 1, "  + M1: one [w, d]"] == 5 and want["b", 1, "  + M2: two [w, d]"] == 5 and want["b", 1, "  + M9: nine [w, d]"] == 2 and want["a", 1, "  + M3: three [w, d]"] == 2
