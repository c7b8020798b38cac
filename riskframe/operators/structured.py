"""Structured scenes from model output: typed fields with defaults, and the title of a script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.modelio import SCENE_SCHEMA
from riskframe.functions.text import in_list, is_blank, strip_ws
from riskframe.limits import LOCATION_TYPES, TIMES_OF_DAY
from riskframe.sources.readers import read_model_output


def normalise_scenes(outputs: DataFrame, column: str = "model_json") -> DataFrame:
    """Adds location, location_type, time_of_day, characters, action_text, dialogue and parse_error.

    Null and blank fields get their defaults; a line of dialogue without speaker or text is dropped."""
    rows = read_model_output(outputs, SCENE_SCHEMA, column)
    p = F.col("parsed")
    text = lambda c, default: F.when(is_blank(c), F.lit(default)).otherwise(strip_ws(c))
    none = F.array().cast("array<string>")
    names = F.filter(F.transform(F.coalesce(p["characters"], none), strip_ws), lambda n: n.isNotNull() & (n != ""))
    spoken = F.filter(p["dialogue"], lambda d: ~is_blank(d["character"]) & ~is_blank(d["text"]))
    return rows.select(
        *outputs.columns, "parse_error", text(p["location"], "UNKNOWN").alias("location"), in_list(p["location_type"], LOCATION_TYPES).alias("location_type"),
        in_list(p["time_of_day"], TIMES_OF_DAY).alias("time_of_day"), names.alias("characters"), F.coalesce(p["action_text"], F.lit("")).alias("action_text"),
        F.coalesce(spoken, F.array().cast("array<struct<character:string,parenthetical:string,text:string>>")).alias("dialogue"),
    )


def script_titles(blocks: DataFrame, outputs: DataFrame, key: str = "script_id") -> DataFrame:
    """The title that the model read in a script's preamble; of several preambles the last counts, none gives NULL."""
    titled = read_model_output(outputs, "title STRING")
    title = F.when(~is_blank(F.col("parsed.title")), strip_ws(F.col("parsed.title")))
    found = blocks.where("is_preamble").select(key, "block_index").join(titled.select(key, "block_index", title.alias("title")), [key, "block_index"])
    named = found.groupBy(key).agg(F.max_by("title", "block_index").alias("title"))
    return blocks.select(key).distinct().join(named, key, "left")
