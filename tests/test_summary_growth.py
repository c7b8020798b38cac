"""A summary of scripts makes their scenes once."""

import __spark_entry__ as e
from riskframe.operators import screenplay
from test_class_measures import plan


def test_names_and_scenes_are_counted_in_one_pass(spark):
    scenes = spark.createDataFrame(
        [(1, 1, ["A", "B", "A"], 1.0), (1, 2, ["B", None], 0.5), (1, 3, [], 0.3), (1, 4, None, None), (2, 1, [], 0.5), (3, 1, [None], 1.0), (4, 1, ["A"], 1.0)],
        "script_id int, scene_ix int, characters array<string>, parse_confidence double")
    scripts = spark.createDataFrame([(1,), (2,), (3,), (5,), (5,), (None,)], "script_id int")
    got = sorted((r.script_id or 0, r.total_scenes, r.total_characters, r.overall_confidence) for r in screenplay.script_summary(scripts, scenes).collect())
    assert got == [(0, 0, 0, 0.0), (1, 4, 3, 0.45), (2, 1, 0, 0.5), (3, 1, 1, 1.0), (5, 0, 0, 0.0), (5, 0, 0, 0.0)]


def test_scripts_are_parsed_once(spark, data):
    """once for the scenes, and once more for the names in them."""
    assert plan(e.queries()["e5_script_summary"](spark, data)).count("Relation [doc_id") == 2
