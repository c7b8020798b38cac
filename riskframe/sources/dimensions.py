"""Taxonomy and measure catalogue as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import schemas
from riskframe.vocabulary import KEYWORDS, MEASURES, RISK_CLASSES

TAXONOMY_JSON = (
    "categories MAP<STRING, STRUCT<description: STRING, classes: MAP<STRING, STRUCT<rule_id: STRING, description: STRING>>>>"
)
MEASURES_JSON = "measures MAP<STRING, STRUCT<title: STRING, responsible: STRING, due: STRING, applies_to: ARRAY<STRING>>>"


def flatten_taxonomy(doc: DataFrame) -> DataFrame:
    """``categories`` (category -> classes) to one row per class in document order."""
    cats = doc.select(F.posexplode(F.map_entries("categories")).alias("cat_ord", "c"))
    return cats.select(
        "cat_ord", F.col("c.key").alias("category"), F.posexplode(F.map_entries("c.value.classes")).alias("cls_ord", "k")
    ).select(
        F.col("k.key").alias("risk_class"),
        "category",
        F.col("k.value.rule_id").alias("rule_id"),
        F.coalesce("k.value.description", F.lit("")).alias("description"),
        (F.shiftleft(F.col("cat_ord").cast("long"), 32) + F.col("cls_ord")).alias("ord"),
    )


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return flatten_taxonomy(spark.read.schema(TAXONOMY_JSON).option("multiLine", "true").json(path))


def rule_index(risk_class: DataFrame) -> DataFrame:
    """rule_id -> class; of classes that share a rule the last one counts."""
    return risk_class.groupBy("rule_id").agg(F.max_by("risk_class", "ord").alias("risk_class"))


def flatten_measures(doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(measure, measure_applies) in catalogue order."""
    rows = doc.select(F.posexplode(F.map_entries("measures")).alias("ord", "m")).select(
        F.col("m.key").alias("code"), "m.value.*", "ord"
    )
    return (
        rows.select("code", "title", "responsible", "due", "ord"),
        rows.select("code", F.explode("applies_to").alias("risk_class"), "ord").withColumn(
            "risk_class", F.upper("risk_class")
        ),
    )


def load_measures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return flatten_measures(spark.read.schema(MEASURES_JSON).option("multiLine", "true").json(path))


def default_risk_classes(spark: SparkSession) -> DataFrame:
    rows = [(c, cat, rule, text, i) for i, (cat, c, rule, text) in enumerate(RISK_CLASSES)]
    return spark.createDataFrame(rows, schemas.RISK_CLASS)


def default_measures(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [(code, title, who, due, i) for i, (code, title, who, due, _) in enumerate(MEASURES)]
    applies = [(m[0], c, i) for i, m in enumerate(MEASURES) for c in m[4]]
    return spark.createDataFrame(rows, schemas.MEASURE), spark.createDataFrame(applies, schemas.MEASURE_APPLIES)


def default_keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KEYWORDS), "term STRING, risk_class STRING, likelihood INT, impact INT")


def taxonomy_text(risk_class: DataFrame, measure: DataFrame, measure_applies: DataFrame) -> DataFrame:
    """One row ``taxonomy_context``: classes by category, scoring rule, measures.

    Dimension tables only; the text is the same for every scene.
    """
    line = F.format_string("- %s [%s] %s", "risk_class", "rule_id", "description")
    grouped = risk_class.groupBy("category").agg(
        F.min("ord").alias("a"), F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines")
    )
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    categories = grouped.select(
        F.lit(0).alias("part"), "a", F.concat(F.lit("category "), "category", F.lit("\n"), body).alias("text")
    )
    applies = measure_applies.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("risk_class")), ", ").alias("classes"))
    measures = measure.join(applies, "code", "left").select(
        F.lit(1).alias("part"),
        F.col("ord").alias("a"),
        F.format_string("* %s: %s (%s)", "code", "title", F.coalesce("classes", F.lit(""))).alias("text"),
    )
    return (
        categories.unionByName(measures)
        .groupBy()
        .agg(F.array_sort(F.collect_list(F.struct("part", "a", "text"))).alias("parts"))
        .select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("taxonomy_context"))
    )

