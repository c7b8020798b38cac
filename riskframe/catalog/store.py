"""The knowledge store: documents of the given table with tenants, tags and times by rule."""

from pyspark.sql import functions as F

from riskframe.catalog.inputs import documents
from riskframe.catalog.registry import query
from riskframe.functions.hashing import content_hash
from riskframe.operators import knowledge

_NOW = "TIMESTAMP '2024-01-20 00:00:00'"
STORE = """kb AS (
  SELECT doc_id, lang AS tenant_id, 'Title ' || doc_id AS title, source, [source, CASE WHEN doc_id % 6 = 0 THEN 'placeholder' ELSE 'real' END] AS tags,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(doc_id % 97 AS INTEGER) AS created_at,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(doc_id % 97 + (doc_id % 30) * 24 AS INTEGER) AS expires_at, sha256(text) AS content_hash FROM documents),
chunk AS (SELECT doc_id, i AS chunk_no, substr(text, i * 900 + 1, 900) AS chunk_text FROM (SELECT doc_id, text, unnest(range(0, greatest(0, (length(text) - 1) // 900) + 1)) AS i FROM documents))"""


def store(spark, folder):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hours = (F.col("doc_id") % 97).cast("int")
    docs = documents(spark, folder).select(
        "doc_id", F.col("lang").alias("tenant_id"), F.concat(F.lit("Title "), "doc_id").alias("title"), "source",
        F.array("source", F.when(F.col("doc_id") % 6 == 0, "placeholder").otherwise("real")).alias("tags"), F.lit("loader").alias("uploaded_by"),
        F.timestamp_add("HOUR", hours, start).alias("created_at"), F.timestamp_add("HOUR", hours + (F.col("doc_id") % 30).cast("int") * 24, start).alias("expires_at"),
        content_hash(F.col("text")).alias("content_hash"),
    )
    last = F.floor(F.greatest(F.lit(0), F.char_length("text") - 1) / 900).cast("int")
    chunks = documents(spark, folder).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return docs, chunks.select("doc_id", F.col("i").cast("bigint").alias("chunk_no"), F.substring("text", F.col("i") * 900 + 1, F.lit(900)).alias("chunk_text"))


def _now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


@query("d4_chunks_of_documents", f"WITH {STORE} SELECT doc_id, tenant_id, title, chunk_no, chunk_text FROM chunk JOIN kb USING (doc_id)")
def chunks_of_documents(spark, folder):
    return knowledge.doc_chunks(*store(spark, folder)).select("doc_id", "tenant_id", "title", "chunk_no", "chunk_text")


@query("d5_document_summaries", f"WITH {STORE} SELECT doc_id, tenant_id, title, source, count(*) AS chunk_count FROM kb JOIN chunk USING (doc_id) GROUP BY ALL")
def document_summaries(spark, folder):
    return knowledge.doc_summaries(*store(spark, folder)).select("doc_id", "tenant_id", "title", "source", "chunk_count")


@query("b13_live_documents", f"WITH {STORE} SELECT doc_id, title FROM kb WHERE tenant_id = 'en' AND expires_at > {_NOW}")
def live_documents(spark, folder):
    return knowledge.live_docs(store(spark, folder)[0], "en", _now()).select("doc_id", "title")


@query("b14_tagged_documents", f"WITH {STORE} SELECT doc_id, title FROM kb WHERE list_contains(tags, 'src3')")
def tagged_documents(spark, folder):
    return knowledge.with_tag(store(spark, folder)[0], "src3").select("doc_id", "title")


@query(
    "b15_point_lookup",
    f"""WITH {STORE}, asked AS (SELECT doc_id AS request_id, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS tenant_id FROM documents)
SELECT request_id, a.doc_id, CASE WHEN k.doc_id IS NULL THEN 'not_found' ELSE 'found' END AS outcome, k.title, n AS chunk_count
FROM asked a LEFT JOIN kb k USING (doc_id, tenant_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunk GROUP BY 1) c ON c.doc_id = k.doc_id""",
)
def point_lookup(spark, folder):
    asked = documents(spark, folder).select(F.col("doc_id").alias("request_id"), "doc_id", F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang")).alias("tenant_id"))
    return knowledge.get_documents(asked, *store(spark, folder)).select("request_id", "doc_id", "outcome", "title", "chunk_count")


@query("d7_new_documents", f"WITH {STORE} SELECT doc_id, min(doc_id) OVER (PARTITION BY tenant_id, content_hash) = doc_id AND source <> 'src1' AND NOT bool_or(source = 'src1') OVER (PARTITION BY tenant_id, content_hash) AS is_new FROM kb WHERE source <> 'src1' OR true")
def new_documents(spark, folder):
    """The documents of one source are stored already; the first of equal ones among all others is new."""
    docs, _ = store(spark, folder)
    return knowledge.mark_new_documents(docs, docs.where("source = 'src1'")).select("doc_id", "is_new")


@query("d9_purge_expired", f"WITH {STORE} SELECT doc_id, count(*) AS chunks FROM kb JOIN chunk USING (doc_id) WHERE expires_at > {_NOW} GROUP BY 1")
def purge_expired(spark, folder):
    docs, chunks, _ = knowledge.purge_expired(*store(spark, folder), _now())
    return chunks.join(docs.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("d10_delete_by_tag", f"WITH {STORE} SELECT count(*) AS deleted FROM kb WHERE tenant_id = 'en' AND list_contains(tags, 'src3')")
def delete_by_tag(spark, folder):
    return knowledge.delete_by_tag(*store(spark, folder), "en", "src3")[2]


@query("h1_reseed", f"WITH {STORE} SELECT doc_id FROM kb WHERE NOT (tenant_id = 'en' AND list_contains(tags, 'placeholder')) UNION ALL SELECT doc_id + 1000000 FROM kb WHERE tenant_id = 'de'")
def reseed(spark, folder):
    docs, chunks = store(spark, folder)
    fresh = docs.where("tenant_id = 'de'").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    return knowledge.reseed(docs, chunks, fresh, chunks.limit(0), "en", "placeholder")[0].select("doc_id")


@query("h3_placeholders", f"WITH {STORE} SELECT doc_id, 'placeholder' AS part FROM kb WHERE list_contains(tags, 'placeholder') UNION ALL SELECT doc_id, 'real' FROM kb WHERE NOT list_contains(tags, 'placeholder')")
def placeholders(spark, folder):
    held, real = knowledge.kb_parts(store(spark, folder)[0])
    return held.select("doc_id", F.lit("placeholder").alias("part")).unionByName(real.select("doc_id", F.lit("real").alias("part")))


@query(
    "e11_store_status",
    f"""WITH {STORE} SELECT tenant_id, count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) FILTER (list_contains(tags, 'placeholder')) AS placeholders, count(*) AS chunks,
  count(DISTINCT doc_id) FILTER (NOT list_contains(tags, 'placeholder')) AS real_documents FROM kb JOIN chunk USING (doc_id) GROUP BY 1""",
)
def store_status(spark, folder):
    return knowledge.kb_status(*store(spark, folder)).select("tenant_id", "documents", "placeholders", "chunks", "real_documents")


@query(
    "g2_newest_documents",
    f"""WITH {STORE} SELECT doc_id, title, n AS chunk_count, (SELECT count(*) FROM kb WHERE tenant_id = 'en') AS total FROM kb JOIN (SELECT doc_id, count(*) AS n FROM chunk GROUP BY 1) USING (doc_id)
WHERE tenant_id = 'en' ORDER BY created_at DESC, doc_id LIMIT 50 OFFSET 20""",
)
def newest_documents(spark, folder):
    """A page of a listing: the limit is the feature."""
    return knowledge.list_documents(*store(spark, folder), "en", limit=50, offset=20).select("doc_id", "title", "chunk_count", "total")


@query("e12_ingest_outcomes", f"""WITH {STORE}, m AS (SELECT doc_id, doc_id % 11 = 0 AS failed, min(doc_id) OVER (PARTITION BY tenant_id, content_hash) = doc_id AS is_new FROM kb)
SELECT CASE WHEN failed THEN 'failed' WHEN is_new THEN 'created' ELSE 'skipped' END AS outcome, count(*) AS n FROM m GROUP BY 1""")
def ingest_outcomes(spark, folder):
    docs, _ = store(spark, folder)
    errors = F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("file: empty"))).otherwise(F.array().cast("array<string>"))
    return knowledge.seed_outcomes(knowledge.mark_new_documents(docs, docs.limit(0)).withColumn("errors", errors))


@query("i11_hashes", "SELECT doc_id, sha256(text) AS content_hash, substr(sha256(source), 1, 16) AS key_prefix, sha256(lang || ':' || CAST(doc_id AS VARCHAR)) AS stable_id FROM documents")
def hashes(spark, folder):
    from riskframe.functions.hashing import key_prefix, stable_id

    return documents(spark, folder).select("doc_id", content_hash(F.col("text")).alias("content_hash"), key_prefix(F.col("source")).alias("key_prefix"), stable_id(F.col("lang"), F.col("doc_id")).alias("stable_id"))


@query("i12_encrypted_round_trip", "SELECT doc_id, CASE WHEN source = 'src5' THEN text END AS pending, CASE WHEN source <> 'src5' THEN text END AS text, source <> 'src5' AS readable FROM documents")
def encrypted_round_trip(spark, folder):
    """A key for each source but one, whose documents stay until they have one."""
    from riskframe.functions.hashing import decrypt_column, encrypt_column

    docs = documents(spark, folder).select("doc_id", "text", F.col("source").alias("key_id"))
    keys = docs.select("key_id").distinct().where("key_id <> 'src5'").withColumn("key", F.substring(F.sha2("key_id", 256), 1, 16).cast("binary"))
    sealed = encrypt_column(docs, "text", keys)
    return decrypt_column(sealed, "text", keys).select("doc_id", F.col("text_pending").alias("pending"), "text", "readable")
