"""The library's inputs, derived from the given tables by the same rule in Spark and SQL.

Each Spark function has an SQL twin (upper case) to be used as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.text import WS, WS_CHARS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def strip_sql(expr: str) -> str:
    return f"trim({expr}, '{WS_CHARS}')"


def ltrim_sql(expr: str) -> str:
    return f"ltrim({expr}, '{WS_CHARS}')"


WS_SQL = WS

# --- scripts with scene markers ------------------------------------------------------------

_KINDS = ("INT.", "EXT.", "INT./EXT.", "INNEN", "AUSSEN.", "int. / ext.", "I/E.", "14 EXT.", "  7b Int.")
_TIMES = (" - DAY", " - NIGHT", " – TAG", " - Abend", "", " - CO-OP - LATER", " -- MORGEN", " - somewhen")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "lang", "source")


def scripts_text(spark: SparkSession, folder: str) -> DataFrame:
    """script_id, full_text: a generated heading in front of every fifth line."""
    kinds = F.array(*map(F.lit, _KINDS))
    times = F.array(*map(F.lit, _TIMES))

    def line(text, i):
        n = F.col("doc_id") + i
        heading = F.concat(
            F.get(kinds, (n % len(_KINDS)).cast("int")),
            F.lit(" "),
            F.upper("source"),
            F.get(times, (n % len(_TIMES)).cast("int")),
        )
        return F.when(i % 5 == 2, F.concat(heading, F.lit("\n"), text)).otherwise(text)

    return documents(spark, folder).select(
        F.col("doc_id").alias("script_id"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("full_text")
    )


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SCRIPTS_TEXT = f"""scripts_text AS (
  SELECT doc_id AS script_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
    CASE WHEN (i - 1) % 5 = 2 THEN
      {_sql_list(_KINDS)}[1 + CAST((doc_id + i - 1) % {len(_KINDS)} AS INTEGER)] || ' ' || upper(source)
      || {_sql_list(_TIMES)}[1 + CAST((doc_id + i - 1) % {len(_TIMES)} AS INTEGER)] || chr(10) || l
    ELSE l END), chr(10)) AS full_text
  FROM documents)"""

# --- pages ----------------------------------------------------------------------------------

PAGE_CHARS = 1500


def pages_text(spark: SparkSession, folder: str) -> DataFrame:
    """script_id, page_no, text: fixed slices of the whole document."""
    size = F.greatest(F.lit(0), F.floor((F.char_length("text") - 1) / PAGE_CHARS)).cast("int")
    return (
        documents(spark, folder)
        .select(F.col("doc_id").alias("script_id"), "text", F.explode(F.sequence(F.lit(0), size)).alias("p"))
        .select(
            "script_id",
            (F.col("p") + 1).alias("page_no"),
            F.substring("text", F.col("p") * PAGE_CHARS + 1, F.lit(PAGE_CHARS)).alias("text"),
        )
    )


PAGES_TEXT = f"""pages_text AS (
  SELECT doc_id AS script_id, CAST(p + 1 AS INTEGER) AS page_no, substr(text, p * {PAGE_CHARS} + 1, {PAGE_CHARS}) AS text
  FROM (SELECT doc_id, text, unnest(range(0, greatest(0, (length(text) - 1) // {PAGE_CHARS}) + 1)) AS p FROM documents))"""

# --- screenplay paragraphs --------------------------------------------------------------------

_TYPES = (
    "Scene Heading",
    "Action",
    "Character",
    "Parenthetical",
    "Dialogue",
    "Dialogue",
    "Shot",
    "Character",
    "Dialogue",
    "Note",
    "Parenthetical",
    "Transition",
    "Dialogue",
)


def _type_of(n):
    return F.get(F.array(*map(F.lit, _TYPES)), (n % len(_TYPES)).cast("int"))


def xml_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """script_id, xml: each line of a document as a paragraph, its type by rule."""

    def escape(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def para(text, i):
        kind = _type_of(F.col("doc_id") + i)
        shown = (
            F.when(kind == "Scene Heading", F.concat(F.lit("INT. "), F.upper("source"), F.lit(" - NIGHT")))
            .when(kind == "Character", F.concat(F.lit("WHO "), (i % 4).cast("string")))
            .when(kind == "Parenthetical", F.concat(F.lit("(p"), i.cast("string"), F.lit(")")))
            .otherwise(escape(text))
        )
        number = F.when((kind == "Scene Heading") & (i % 2 == 0), F.concat(F.lit(' Number="'), i.cast("string"), F.lit('"')))
        return F.concat(
            F.lit('<Paragraph Type="'), kind, F.lit('"'), F.coalesce(number, F.lit("")), F.lit("><Text>"), shown, F.lit("</Text></Paragraph>")
        )

    # Characters that XML does not allow are not part of the input.
    clean = F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f]", "")
    return documents(spark, folder).select(
        F.col("doc_id").alias("script_id"),
        F.concat(
            F.lit('<?xml version="1.0"?><FinalDraft><Content>'),
            F.array_join(F.transform(F.split(clean, "\n"), para), ""),
            F.lit("</Content><TitlePage><Content><Paragraph><Text/></Paragraph><Paragraph><Text>Title "),
            F.col("doc_id").cast("string"),
            F.lit("</Text></Paragraph></Content></TitlePage></FinalDraft>"),
        ).alias("xml"),
    )


PARAGRAPHS = f"""paragraphs AS (
  SELECT script_id, pos, type,
    CASE WHEN type = 'Scene Heading' AND pos % 2 = 0 THEN CAST(pos AS VARCHAR) END AS number,
    {strip_sql('''CASE WHEN type = 'Scene Heading' THEN 'INT. ' || upper(source) || ' - NIGHT'
      WHEN type = 'Character' THEN 'WHO ' || CAST(pos % 4 AS VARCHAR)
      WHEN type = 'Parenthetical' THEN '(p' || CAST(pos AS VARCHAR) || ')' ELSE line END''')} AS text
  FROM (
    SELECT doc_id AS script_id, source, line, CAST(i - 1 AS INTEGER) AS pos,
      {_sql_list(_TYPES)}[1 + CAST((doc_id + i - 1) % {len(_TYPES)} AS INTEGER)] AS type
    FROM (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS i
          FROM (SELECT doc_id, source, string_split(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f]', '', 'g'), chr(10)) AS l
                FROM documents))))"""

# --- dimensions and raw findings ----------------------------------------------------------------


def risk_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as classes, regions as their categories."""
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.upper("n_name").alias("risk_class"),
        F.upper("r_name").alias("category"),
        F.concat(F.lit("R-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("rule_id"),
        F.lower("n_name").alias("description"),
        F.col("n_nationkey").alias("ord"),
    )


RISK_CLASSES = """risk_class AS (
  SELECT upper(n_name) AS risk_class, upper(r_name) AS category, 'R-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS rule_id,
    lower(n_name) AS description, n_nationkey AS ord
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def measures(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as measures, applying to the class of their nation."""
    s, n = table(spark, folder, "supplier"), table(spark, folder, "nation")
    measure = s.select(
        F.upper("s_name").alias("code"),
        F.concat(F.lit("Measure "), F.col("s_suppkey").cast("string")).alias("title"),
        F.concat(F.lit("team "), (F.col("s_suppkey") % 5).cast("string")).alias("responsible"),
        F.concat(F.lit("day-"), (F.col("s_suppkey") % 7).cast("string")).alias("due"),
        F.col("s_suppkey").alias("ord"),
    )
    applies = s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.upper("s_name").alias("code"), F.upper("n_name").alias("risk_class"), F.col("s_suppkey").alias("ord")
    )
    return measure, applies


MEASURES = """measure AS (
  SELECT upper(s_name) AS code, 'Measure ' || CAST(s_suppkey AS VARCHAR) AS title,
    'team ' || CAST(s_suppkey % 5 AS VARCHAR) AS responsible, 'day-' || CAST(s_suppkey % 7 AS VARCHAR) AS due, s_suppkey AS ord
  FROM supplier),
measure_applies AS (
  SELECT upper(s_name) AS code, upper(n_name) AS risk_class, s_suppkey AS ord
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def raw_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as findings of the report of their order; scores also out of range,
    some classes and codes unknown, some fields blank."""
    li = table(spark, folder, "lineitem")
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    c = F.col
    class_no = (c("l_partkey") % 28).cast("int")
    supplier = F.concat(F.lit("Supplier#"), F.lpad(c("l_suppkey").cast("string"), 9, "0"))
    other = F.concat(F.lit("supplier#"), F.lpad((c("l_suppkey") % 7 + 1).cast("string"), 9, "0"))
    return (
        li.withColumn("_class", class_no)
        .join(n, c("_class") == c("n_nationkey"), "left")
        .select(
            c("l_orderkey").cast("string").alias("report_id"),
            c("l_linenumber").alias("scene_ix"),
            (c("l_partkey") * 10_000 + c("l_suppkey")).alias("finding_ix"),
            F.when(c("l_partkey") % 11 == 0, F.lit("A")).when(c("l_partkey") % 13 == 0, None)
            .otherwise(c("l_linenumber").cast("string")).alias("scene_number"),
            F.coalesce(F.when(c("l_partkey") % 2 == 0, F.lower("n_name")).otherwise(c("n_name")),
                       F.concat(F.lit("other_"), c("_class").cast("string"))).alias("risk_class"),
            F.when(c("l_suppkey") % 3 == 0, F.lit("")).when(c("l_suppkey") % 5 == 0, F.lit("X-1")).alias("rule_id"),
            F.when(c("l_suppkey") % 4 == 0, F.lit("unknown")).when(c("l_suppkey") % 4 == 1, F.lit("")).when(c("l_suppkey") % 4 == 2, F.lit("REGION_1")).alias("category"),
            F.when(c("l_linenumber") % 5 != 4, c("l_linenumber") % 7).alias("likelihood"),
            (c("l_quantity").cast("int") % 7).alias("impact"),
            c("l_discount").alias("confidence"),
            F.concat(F.lit("part "), c("l_partkey").cast("string")).alias("description"),
            F.when(c("l_returnflag") != "N", F.concat(F.lit("check "), c("l_returnflag"))).alias("recommendation"),
            F.when(c("l_partkey") % 4 == 0, F.array(supplier, other, supplier))
            .when(c("l_partkey") % 4 == 1, F.array(F.lit("nothing")))
            .when(c("l_partkey") % 4 == 2, F.array(other)).alias("measure_codes"),
            F.when(c("l_linestatus") == "O", F.lit("open")).alias("evidence"),
        )
    )


RAW_FINDINGS = """raw_findings AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS report_id, l_linenumber AS scene_ix, l_partkey * 10000 + l_suppkey AS finding_ix,
    CASE WHEN l_partkey % 11 = 0 THEN 'A' WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END AS scene_number,
    coalesce(CASE WHEN l_partkey % 2 = 0 THEN lower(n_name) ELSE n_name END, 'other_' || CAST(l_partkey % 28 AS VARCHAR)) AS risk_class,
    CASE WHEN l_suppkey % 3 = 0 THEN '' WHEN l_suppkey % 5 = 0 THEN 'X-1' END AS rule_id,
    CASE l_suppkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN '' WHEN 2 THEN 'REGION_1' END AS category,
    CASE WHEN l_linenumber % 5 <> 4 THEN l_linenumber % 7 END AS likelihood,
    CAST(trunc(l_quantity) AS INTEGER) % 7 AS impact, l_discount AS confidence,
    'part ' || CAST(l_partkey AS VARCHAR) AS description,
    CASE WHEN l_returnflag <> 'N' THEN 'check ' || l_returnflag END AS recommendation,
    CASE l_partkey % 4
      WHEN 0 THEN ['Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0'), 'supplier#' || lpad(CAST(l_suppkey % 7 + 1 AS VARCHAR), 9, '0'),
                   'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')]
      WHEN 1 THEN ['nothing'] WHEN 2 THEN ['supplier#' || lpad(CAST(l_suppkey % 7 + 1 AS VARCHAR), 9, '0')] END AS measure_codes,
    CASE WHEN l_linestatus = 'O' THEN 'open' END AS evidence
  FROM lineitem LEFT JOIN nation ON n_nationkey = l_partkey % 28)"""
