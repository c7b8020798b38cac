"""Nearest neighbours over the given vectors: queries are the rows whose id is divisible by 20."""

from pyspark.sql import functions as F

from riskframe.catalog.inputs import table
from riskframe.catalog.registry import query
from riskframe.functions.vectors import cosine_distance
from riskframe.operators import nearest
from riskframe.session import run_dir

_K, _DIM = 5, 64
_PAIRS = """pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) AS d
  FROM embeddings q JOIN embeddings c ON q.label % 2 = c.label % 2 WHERE q.vec_id % 20 = 0)"""


def _sides(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", (F.col("label") % 2).alias("tenant_id"), "embedding")
    return rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "chunk_id")


@query(
    "d6_nearest_chunks",
    f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS k FROM pairs)
SELECT query_id, chunk_id, round(d, 6) AS distance, CAST(k AS INTEGER) AS rank FROM r WHERE k <= {_K}""",
)
def nearest_chunks(spark, folder):
    queries, chunks = _sides(spark, folder)
    index = nearest.build_index(chunks, run_dir(spark, "nearest"), _DIM)
    return nearest.knn(queries, index, _K).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


_NOW = "2024-01-20 00:00:00"
_LIVE = f"""kb AS (SELECT vec_id AS chunk_id, label % 2 AS tenant_id, embedding, 'Title ' || vec_id % 90 AS title, vec_id % 90 AS doc_id, repeat('text ' || vec_id || ' ', 1 + CAST(vec_id % 3 AS INTEGER)) AS chunk_text,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(vec_id % 90 % 40 AS INTEGER) AS until FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, c.*, round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) AS d
  FROM embeddings q JOIN kb c ON q.label % 2 = c.tenant_id WHERE q.vec_id % 20 = 0 AND until > TIMESTAMP '{_NOW}'),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS k FROM pairs) WHERE k <= {_K})"""


def _store(spark, folder):
    """(queries, documents, chunks with vectors): ninety documents, which expire on forty days."""
    rows = table(spark, folder, "embeddings")
    doc = F.col("vec_id") % 90
    until = F.timestamp_add("DAY", (doc % 40).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    chunks = rows.select(
        F.col("vec_id").alias("chunk_id"), (F.col("label") % 2).alias("tenant_id"), "embedding", doc.alias("doc_id"), until.alias("until"),
        F.repeat(F.concat(F.lit("text "), F.col("vec_id").cast("string"), F.lit(" ")), (1 + F.col("vec_id") % 3).cast("int")).alias("chunk_text"))
    docs = chunks.groupBy("doc_id").agg(F.min("until").alias("expires_at")).select("doc_id", F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), F.array().cast("array<string>").alias("tags"), "expires_at")
    return _sides(spark, folder)[0], docs, chunks


def _found_live(spark, folder):
    queries, docs, chunks = _store(spark, folder)
    index = nearest.build_index(chunks, run_dir(spark, "nearest"), _DIM)
    return queries, nearest.search_live(queries, docs, chunks, index, F.lit(_NOW).cast("timestamp"), _K)


@query("d6_nearest_live_chunks", f"WITH {_LIVE} SELECT query_id, chunk_id, title, round(d, 6) AS distance, CAST(k AS INTEGER) AS rank FROM hits")
def nearest_live_chunks(spark, folder):
    return _found_live(spark, folder)[1].select("query_id", "chunk_id", "title", F.round("distance", 6).alias("distance"), "rank")


@query(
    "i7_context_texts",
    f"""WITH {_LIVE}, b AS (SELECT query_id, k, '[' || title || '] ' || CASE WHEN length(trim(chunk_text)) > 18 THEN rtrim(substr(trim(chunk_text), 1, 18)) || '...' ELSE trim(chunk_text) END AS block FROM hits)
SELECT q.vec_id AS query_id, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY k), '(none)') AS kb_context FROM embeddings q LEFT JOIN b ON b.query_id = q.vec_id WHERE q.vec_id % 10 = 0 GROUP BY q.vec_id""",
)
def context_texts(spark, folder):
    """Scenes that ask for context (every second one asks nothing) with what was found for them."""
    from riskframe.operators.knowledge import context_text

    _, hits = _found_live(spark, folder)
    scenes = table(spark, folder, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"))
    return context_text(scenes, hits.select("query_id", "rank", "title", "chunk_text"), ["query_id"], 18)


@query(
    "g1_nearest_to_one",
    f"""SELECT c.vec_id AS chunk_id, round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS distance
FROM embeddings c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), c.vec_id LIMIT {_K}""",
)
def nearest_to_one(spark, folder):
    """A top-k report: the limit is the feature."""
    _, chunks = _sides(spark, folder)
    vector = chunks.where("chunk_id = 0").first()["embedding"]
    return nearest.nearest_to_one(chunks, vector, _K).withColumn("distance", F.round("distance", 6))


@query(
    "i13_cosine_distance",
    """SELECT a.vec_id, round(list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_distances(spark, folder):
    rows = table(spark, folder, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(after, "vec_id").select("vec_id", F.round(cosine_distance(F.col("embedding"), F.col("next")), 6).alias("distance"))


@query("a9_vector_check", "SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def vector_check(spark, folder):
    from riskframe.sources.readers import read_vectors

    good, _ = read_vectors(spark, f"{folder}/embeddings.parquet", _DIM)
    return good.groupBy("dim").agg(F.count("*").alias("n"))
