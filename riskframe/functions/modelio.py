"""Cleaning and checking the JSON a model returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.text import strip_ws
from riskframe.limits import CATEGORIES

FINDINGS_SCHEMA = (
    "findings ARRAY<STRUCT<risk_class STRING, rule_id STRING, category STRING, likelihood INT, impact INT, "
    "description STRING, recommendation STRING, measure_codes ARRAY<STRING>, confidence DOUBLE, "
    "evidence STRING, vulnerability STRING, complexity STRING, exposure_duration STRING>>"
)
SCENE_SCHEMA = (
    "location STRING, location_type STRING, time_of_day STRING, characters ARRAY<STRING>, action_text STRING, "
    "dialogue ARRAY<STRUCT<character STRING, parenthetical STRING, text STRING>>"
)
REQUIRED_FINDING_FIELDS = (
    "risk_class",
    "category",
    "likelihood",
    "impact",
    "description",
    "recommendation",
    "evidence",
)


def clean_model_json(c: Column) -> Column:
    """Without reasoning tags and without one code fence around the JSON."""
    text = strip_ws(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    text = F.regexp_replace(text, r"\A```(?:json)?", "")
    return strip_ws(F.regexp_replace(text, r"```\z", ""))


def finding_errors(
    finding: Column,
    categories: Sequence[str] = CATEGORIES,
    required: Sequence[str] = REQUIRED_FINDING_FIELDS,
) -> Column:
    """All schema violations of one parsed finding, in field order."""
    checks = [F.when(finding[name].isNull(), F.lit(f"{name}: missing")) for name in required]
    checks.append(F.when(~finding["category"].isin(*categories), F.lit("category: not allowed")))
    checks += [
        F.when(~finding[name].between(1, 5), F.lit(f"{name}: out of range")) for name in ("likelihood", "impact")
    ]
    return F.array_compact(F.array(*checks))
