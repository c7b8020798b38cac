"""Sources: script files, submissions, knowledge files, model output, vectors.

Readers never infer a schema, and what cannot be used comes back with a reason beside what can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import limits as L
from riskframe import schemas
from riskframe.functions.modelio import clean_model_json
from riskframe.functions.text import file_extension, title_from_stem
from riskframe.operators.chunking import parse_front_matter
from riskframe.operators.knowledge import ingest_errors, mark_new_documents, prepare_documents, seed_tags, seed_title, with_expiry


def read_scripts(spark: SparkSession, path: str, script_format: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) files with path, content and script_format; a given format overrides the extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.substring(file_extension(F.col("path")), 2, 10)
    fmt = F.lit(script_format.lower()) if script_format else ext
    rows = files.select("path", "content", "length", fmt.alias("script_format"))
    known = F.col("script_format").isin(*L.SCRIPT_FORMATS)
    return rows.where(known), rows.where(~known).withColumn("reason", F.concat(F.lit("unsupported format: "), "script_format"))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """JSON submissions with their body decoded; what isn't base64 has a null body (see the checks)."""
    rows = spark.read.schema(schemas.SUBMISSION).json(path)
    return rows.withColumn("body", F.try_to_binary("script_content", F.lit("base64")))


def stream_submissions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.readStream.schema(schemas.SUBMISSION).json(path)
    return rows.withColumn("body", F.try_to_binary("script_content", F.lit("base64")))


def read_kb_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, text and ``errors`` of the files of a folder, in the order of their names.

    Files of no bytes never come up: Spark's reader passes over them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.col("length").alias("size"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return rows.withColumn("errors", ingest_errors(F.col("path"), F.col("size"), F.col("text"))).orderBy("path")


def _front(text: Column, key: str) -> Column:
    found = F.filter(F.coalesce(parse_front_matter(text), F.array()), lambda f: f["key"] == key)
    return F.get(found, F.lit(0))


def seed_kb(files: DataFrame, kb: DataFrame, tenant: str, now: Column, ttl_hours: int = L.MAX_TTL_HOURS) -> tuple[DataFrame, DataFrame]:
    """(new documents, outcome of every file: created, skipped or failed).

    The title is the front matter's or else the file's name; tags get the marker."""
    rows = files.withColumn("doc_id", F.sha2(F.concat_ws(":", F.lit(tenant), "path"), 256)).withColumn("tenant_id", F.lit(tenant))
    rows = rows.withColumn("title", seed_title(_front(F.col("text"), "title")["value"], title_from_stem(F.col("path"))))
    rows = rows.withColumn("tags", seed_tags(_front(F.col("text"), "tags")["items"])).withColumn("ttl_hours", F.lit(ttl_hours))
    good = prepare_documents(rows.where(F.size("errors") == 0))
    marked = mark_new_documents(good, kb, order=["path"])
    fresh = with_expiry(marked.where("is_new").drop("is_new", "errors", "size"), now)
    done = marked.select("path", F.when(F.col("is_new"), "created").otherwise("skipped").alias("outcome"))
    failed = rows.where(F.size("errors") > 0).select("path", F.lit("failed").alias("outcome"))
    return fresh, done.unionByName(failed)


def read_model_output(df: DataFrame, schema: str, column: str = "model_json", required: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``parsed`` and ``parse_error``: not JSON, or required fields that are missing.

    The text is freed of tags and fences first; what cannot be read is kept beside its error."""
    text = clean_model_json(F.col(column))
    out = df.withColumn("_text", text).withColumn("parsed", F.from_json("_text", schema + ", _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}))
    missing = F.array_compact(F.array(*[F.when(F.col("parsed")[n].isNull(), F.lit(n)) for n in required])) if required else F.array().cast("array<string>")
    broken = F.col("parsed").isNull() | F.col("parsed._corrupt").isNotNull() | ~F.coalesce(F.col("_text").startswith("{"), F.lit(False))
    error = F.when(broken, F.lit("not JSON")).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return out.withColumn("parse_error", error).withColumn("parsed", F.when(~broken, F.col("parsed").dropFields("_corrupt"))).drop("_text")


def read_vectors(spark: SparkSession, path: str, dim: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows of ``dim`` numbers, others with a reason); the length is recorded in each row."""
    from riskframe.operators.nearest import reject_reason

    rows = spark.read.parquet(path).withColumn("dim", F.size(column)).withColumn("reason", reject_reason(F.col(column), dim))
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")
