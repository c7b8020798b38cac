"""XML screenplays: safety gate, paragraphs, scenes, dialogue, character index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskframe import schemas
from riskframe.functions.hashing import stable_id
from riskframe.functions.headings import parse_heading
from riskframe.functions.text import strip_chars, strip_ws
from riskframe.limits import MAX_BODY_BYTES

# Paragraph types of the format.
HEADING = "Scene Heading"
CHARACTER, PARENTHETICAL, DIALOGUE = "Character", "Parenthetical", "Dialogue"
ACTION_LIKE = ("Action", "General", "Transition", "Shot")

_DOCTYPE = r"(?is)<!DOCTYPE[^\[>]*(?:\[[^\]]*\][^>]*)?>"
_COMMENT = r"(?s)<!--.*?-->"


def _markup(xml: Column) -> Column:
    """The document without comments and character data, where markup-like text may stand."""
    return F.regexp_replace(xml, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")


def _root_name(xml: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(_markup(xml), _DOCTYPE, ""), r"(?s)<\?.*?\?>", "")
    return F.regexp_extract(bare, r"\A[^<]*<([A-Za-z_][^\s/>]*)", 1)


def _parsed(xml: Column) -> Column:
    # A DOCTYPE without entities is harmless but not readable for the parser: cut it out.
    return F.from_xml(
        F.regexp_replace(xml, _DOCTYPE, ""),
        schemas.FDX + ", _bad STRING",
        {"ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_bad"},
    )


def xml_gate(scripts: DataFrame, xml: str = "xml", max_bytes: int = MAX_BODY_BYTES, forbid_dtd: bool = False) -> DataFrame:
    """Adds ``doc`` (parsed, NULL if refused) and ``reason`` (NULL if accepted).

    Size and entity tests come before the parser. Internal entities are never expanded.
    """
    c = F.col(xml)
    markup = _markup(c)
    early = (
        F.when(F.octet_length(c) > max_bytes, "too_large")
        .when(markup.rlike(r"(?i)<!ENTITY"), "entities_forbidden")
        .when(F.lit(forbid_dtd) & markup.rlike(r"(?i)<!DOCTYPE"), "dtd_forbidden")
    )
    return (
        scripts.withColumn("_early", early)
        .withColumn("doc", F.when(F.col("_early").isNull(), _parsed(c)))
        .withColumn(
            "reason",
            F.coalesce(
                F.col("_early"),
                F.when(c.isNull() | F.col("doc").isNull() | F.col("doc._bad").isNotNull(), "malformed")
                .when(_root_name(c) != "FinalDraft", "wrong_root")
                .when(F.col("doc.Content").isNull() & ~markup.rlike(r"<Content[\s/>]"), "no_content"),
            ),
        )
        .withColumn("doc", F.when(F.col("reason").isNull(), F.col("doc")))
        .drop("_early")
    )


def paragraph_text(runs: Column) -> Column:
    """Non-empty runs joined by one blank, stripped."""
    return strip_ws(F.array_join(F.filter(F.coalesce(runs, F.array()), lambda x: x != ""), " "))


def title(doc: Column) -> Column:
    """First non-empty paragraph of the title page, NULL if there is none."""
    page = doc["TitlePage"]
    texts = F.transform(
        F.concat(
            F.coalesce(page["Paragraph"], F.array()),
            F.coalesce(page["Content"]["Paragraph"], F.array()),
        ),
        lambda p: paragraph_text(p["Text"]),
    )
    return F.get(F.filter(texts, lambda t: t != ""), F.lit(0))


def paragraphs(gated: DataFrame, key: str = "script_id") -> DataFrame:
    """script_id, pos, type, number, text of the accepted documents, in document order."""
    return (
        gated.where("reason IS NULL")
        .select(key, F.posexplode(F.col("doc.Content.Paragraph")).alias("pos", "p"))
        .select(
            key,
            "pos",
            strip_ws(F.coalesce(F.col("p._Type"), F.lit(""))).alias("type"),
            F.col("p._Number").alias("number"),
            paragraph_text(F.col("p.Text")).alias("text"),
        )
    )


def paragraph_count(doc: Column) -> Column:
    return F.coalesce(F.size(doc["Content"]["Paragraph"]), F.lit(0))


def attribute_dialogue(paras: DataFrame, key: str = "script_id") -> DataFrame:
    """Every paragraph with its scene (1..n) and, for emitted dialogue, speaker and
    parenthetical. Paragraphs in front of the first heading are left out.

    One script comes out of one document of at most 10 MB, so a window over a script is
    bounded; all windows share the partitioning by script and the data moves once.
    """
    by_script = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    in_scene = W.partitionBy(key, "scene_ix").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    before = in_scene.rowsBetween(W.unboundedPreceding, -1)
    kind, text = F.col("type"), F.col("text")
    is_heading = kind == HEADING
    filled = ~is_heading & (text != "")
    speaker = F.when(filled & (kind == CHARACTER), text).when(filled & kind.isin(*ACTION_LIKE), F.lit(""))
    paren = F.when(
        filled & (kind == PARENTHETICAL), F.struct("pos", strip_chars(text, "() ").alias("text"))
    )
    return (
        paras.withColumn("scene_ix", F.sum(is_heading.cast("int")).over(by_script).cast("int"))
        .where("scene_ix > 0")
        .withColumn("speaker", F.nullif(F.last(speaker, ignorenulls=True).over(in_scene), F.lit("")))
        .withColumn("emitted", filled & (kind == DIALOGUE) & F.col("speaker").isNotNull())
        .withColumn("_paren", F.last(paren, ignorenulls=True).over(in_scene))
        .withColumn(
            "_reset", F.max(F.when(F.col("emitted") | (filled & (kind == CHARACTER)), F.col("pos"))).over(before)
        )
        .withColumn(
            "parenthetical",
            F.when(
                F.col("emitted") & (F.col("_paren.pos") > F.coalesce(F.col("_reset"), F.lit(-1))), F.col("_paren.text")
            ),
        )
        .withColumn("speaker", F.when(F.col("emitted"), F.col("speaker")))
        .drop("_paren", "_reset")
    )


def scenes(attributed: DataFrame, key: str = "script_id") -> DataFrame:
    """One row per scene: heading parts, characters in first-seen order, dialogue, texts."""
    kind, text = F.col("type"), F.col("text")
    filled = (kind != HEADING) & (text != "")

    def ordered(cond: Column, value: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("pos"), value.alias("v")))))
        return F.transform(rows, lambda r: r["v"])

    line = F.struct(F.col("speaker").alias("character"), F.col("parenthetical"), text.alias("text"))
    grouped = attributed.groupBy(key, "scene_ix").agg(
        F.max(F.when(kind == HEADING, text)).alias("heading"),
        F.max(F.when(kind == HEADING, F.col("number"))).alias("number"),
        F.array_distinct(ordered(filled & (kind == CHARACTER), text)).alias("characters"),
        F.array_join(ordered(filled & kind.isin(*ACTION_LIKE), text), "\n").alias("action_text"),
        ordered(F.col("emitted"), line).alias("dialogue"),
        # The heading line is part of the text even when it is empty.
        F.array_join(ordered(filled | (kind == HEADING), text), "\n").alias("text"),
    )
    parts = parse_heading(F.col("heading"))
    return (
        grouped.withColumn("scene_id", stable_id(F.col(key), F.col("scene_ix")))
        .withColumn("_h", parts)
        .select("*", "_h.*")
        .drop("_h")
        .withColumn("parse_confidence", F.lit(1.0))
        .withColumn("parse_method", F.lit("fdx"))
    )


def character_index(scenes_df: DataFrame, key: str = "script_id") -> DataFrame:
    """name, its scenes in order and the order of first appearance, per script."""
    seen = scenes_df.select(key, "scene_ix", "scene_id", F.posexplode("characters").alias("cpos", "name"))
    grouped = seen.groupBy(key, "name").agg(
        F.array_sort(F.collect_set(F.struct("scene_ix", "scene_id"))).alias("_s"),
        F.min(F.struct("scene_ix", "cpos")).alias("first_seen"),
    )
    return grouped.select(
        key,
        "name",
        F.transform("_s", lambda s: s["scene_id"]).alias("scene_ids"),
        F.transform("_s", lambda s: s["scene_ix"]).alias("scene_ixs"),
        "first_seen",
    )


def script_summary(scripts: DataFrame, scenes_df: DataFrame, key: str = "script_id") -> DataFrame:
    """Scenes, distinct characters and mean confidence (3 places, 0.0 without scenes)."""
    # One pass, as scenes are dear to make: a row for each name, or one for a scene without any.
    cpos, name = F.col("cpos"), F.col("name")
    once = cpos.isNull() | (cpos == 0)
    by_script = (
        scenes_df.select(key, "parse_confidence", F.posexplode_outer("characters").alias("cpos", "name"))
        .groupBy(key)
        .agg(
            F.count(F.when(once, 1)).alias("total_scenes"),
            # Confidences are tenths: summed as integers the mean does not depend on row order.
            F.sum(F.when(once, F.round(F.col("parse_confidence") * 10).cast("bigint"))).alias("_tenths"),
            (F.count_distinct("name") + F.max((cpos.isNotNull() & name.isNull()).cast("int"))).alias("total_characters"),
        )
    )
    return (
        scripts.join(by_script, key, "left")
        .withColumn("overall_confidence", F.coalesce(F.round(F.col("_tenths") / F.lit(10.0) / F.col("total_scenes"), 3), F.lit(0.0)))
        .withColumn("total_scenes", F.coalesce("total_scenes", F.lit(0)))
        .withColumn("total_characters", F.coalesce("total_characters", F.lit(0)))
        .drop("_tenths")
    )
