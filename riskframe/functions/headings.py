"""Scene heading into location type, location and time of day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.text import WS, let, strip_chars, strip_ws
from riskframe.vocabulary import LOCATION_PREFIXES, TIME_WORDS

DASH = rf"[{WS}]*[-–—][{WS}]*"


def strip_scene_number(heading: Column) -> Column:
    return F.regexp_replace(heading, rf"\A[{WS}]*\p{{Nd}}+[A-Za-z]?[{WS}]+", "")


def parse_heading(
    heading: Column,
    prefixes: Sequence[tuple[str, str]] = LOCATION_PREFIXES,
    times: Mapping[str, str] = TIME_WORDS,
) -> Column:
    """STRUCT<location_type, location, time_of_day>; what is not recognised is UNKNOWN."""
    lookup = F.create_map(*(F.lit(x) for pair in times.items() for x in pair))

    def by_prefix(text: Column) -> Column:
        upper = F.upper(text)
        found = F.struct(F.lit("UNKNOWN").alias("kind"), text.alias("rest"))
        for prefix, value in reversed(prefixes):
            rest = strip_ws(F.substring(text, len(prefix) + 1, 2**31 - 1))
            found = F.when(
                upper.startswith(prefix), F.struct(F.lit(value).alias("kind"), rest.alias("rest"))
            ).otherwise(found)
        return let(F.struct(text.alias("text"), found.alias("found")), by_dash)

    def by_dash(head: Column) -> Column:
        return let(
            F.struct(head.alias("head"), F.split(head["found"]["rest"], DASH, -1).alias("parts")), components
        )

    def components(x: Column) -> Column:
        text, found, parts = x["head"]["text"], x["head"]["found"], x["parts"]
        dashed = F.size(parts) > 1
        place = F.when(dashed, F.array_join(F.slice(parts, 1, F.size(parts) - 1), " - ")).otherwise(found["rest"])
        word = F.when(dashed, F.upper(strip_ws(F.element_at(parts, -1)))).otherwise(F.lit(""))
        return F.struct(
            found["kind"].alias("location_type"),
            F.coalesce(F.nullif(strip_chars(strip_ws(place), ". "), F.lit("")), text).alias("location"),
            F.coalesce(F.try_element_at(lookup, word), F.lit("UNKNOWN")).alias("time_of_day"),
        )

    return let(strip_ws(heading), by_prefix)
