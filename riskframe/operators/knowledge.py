"""The knowledge store: ingest, deduplication, listing, deletion, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import limits as L
from riskframe.functions.hashing import content_hash, stable_id
from riskframe.functions.text import file_extension, is_blank, strip_ws
from riskframe.operators.chunking import chunk_documents, strip_front_matter

SUMMARY = ("doc_id", "tenant_id", "title", "source", "tags", "uploaded_by", "created_at", "expires_at")


def ingest_errors(name: Column, size: Column, text: Column) -> Column:
    ext = file_extension(name)
    return F.array_compact(
        F.array(
            F.when(size == 0, "file: empty"),
            F.when(size > L.MAX_BODY_BYTES, "file: too large"),
            F.when(~ext.isin(*L.KB_EXTENSIONS), "file: unsupported type"),
            F.when((size > 0) & text.isNull(), "file: not UTF-8 text"),
            F.when(text.isNotNull() & is_blank(text), "file: no text"),
        )
    )


def prepare_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Body without front matter and its content hash."""
    return docs.withColumn(text, strip_front_matter(F.col(text))).withColumn("content_hash", content_hash(F.col(text)))


def first_per_key(df: DataFrame, key: list[str], order: list[str], row_id: str) -> DataFrame:
    """(key, first row id): a partial aggregate of ids, so a key that holds a third of all
    rows costs one row per map task and no text is moved."""
    return df.groupBy(*key).agg(F.min(F.struct(*order, row_id))[row_id].alias(row_id))


def new_documents(
    batch: DataFrame, kb: DataFrame, order: list[str] | None = None, key: tuple[str, str] = ("tenant_id", "content_hash")
) -> tuple[DataFrame, DataFrame]:
    """(new, conflicts): a document is new if its content is not stored for the tenant and
    it is the first of its kind in the batch."""
    marked = mark_new_documents(batch, kb, order, key)
    return marked.where("is_new").drop("is_new"), marked.where("NOT is_new").drop("is_new")


def mark_new_documents(
    batch: DataFrame, kb: DataFrame, order: list[str] | None = None, key: tuple[str, str] = ("tenant_id", "content_hash")
) -> DataFrame:
    keys = list(key)
    order = order or ["doc_id"]
    firsts = first_per_key(batch, keys, [c for c in order if c != "doc_id"], "doc_id")
    # Which keys are stored is asked once per distinct key; the verdict goes back by id.
    winners = firsts.join(kb.select(*keys).distinct(), keys, "left_anti").select("doc_id", F.lit(True).alias("is_new"))
    return batch.join(winners, "doc_id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def seed_outcomes(marked: DataFrame) -> DataFrame:
    """created / skipped / failed counts; ``errors`` non-empty means failed."""
    outcome = F.when(F.size("errors") > 0, "failed").when(F.col("is_new"), "created").otherwise("skipped")
    return marked.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def with_expiry(docs: DataFrame, now: Column) -> DataFrame:
    return docs.withColumn("created_at", now).withColumn(
        "expires_at", F.timestamp_add("HOUR", F.col("ttl_hours"), F.col("created_at"))
    )


def is_live(now: Column) -> Column:
    return F.col("expires_at") > now


def live_docs(docs: DataFrame, tenant: str, now: Column) -> DataFrame:
    return docs.where((F.col("tenant_id") == tenant) & is_live(now))


def with_tag(docs: DataFrame, tag: str) -> DataFrame:
    return docs.where(F.array_contains("tags", tag))


def doc_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with the fields of their document. Only the needed document columns move."""
    return docs.select("doc_id", "tenant_id", "title", "tags", "expires_at").join(chunks, "doc_id")


def doc_summaries(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Metadata and chunk count (0 if none); the original text is never read."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return (
        docs.select(*SUMMARY)
        .join(counts, "doc_id", "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    )


def list_documents(
    docs: DataFrame,
    chunks: DataFrame,
    tenant: str,
    tag: str | None = None,
    limit: int = 100,
    offset: int = 0,
    after: tuple | None = None,
) -> DataFrame:
    """Newest first, one page, each row with the ``total`` of the listing. The page is cut before
    chunks are counted, so only the chunks of at most ``limit`` documents are counted, and it is
    sorted after the joins. ``after`` = (created_at, doc_id) of the last row seen goes on from there
    without skipping over what came before, however deep the page is."""
    if not 1 <= limit <= L.MAX_LIST_LIMIT:
        raise ValueError(f"limit must be 1..{L.MAX_LIST_LIMIT}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    rows = docs.where(F.col("tenant_id") == tenant)
    if tag:
        rows = with_tag(rows, tag)
    newest = [F.col("created_at").desc(), F.col("doc_id")]
    total = rows.agg(F.count("*").alias("total"))
    seen = rows.select(*SUMMARY)
    if after is not None:
        at, last = after
        seen = seen.where((F.col("created_at") < F.lit(at)) | ((F.col("created_at") == F.lit(at)) & (F.col("doc_id") > F.lit(last))))
    page = seen.orderBy(*newest).offset(offset).limit(limit)
    ids = F.broadcast(page.select("doc_id"))  # at most MAX_LIST_LIMIT rows
    listed = doc_summaries(page, chunks.join(ids, "doc_id", "left_semi"))
    return listed.join(F.broadcast(total), how="left").orderBy(*newest)  # one row


def get_documents(requests: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Requests (request_id, doc_id, tenant_id) with the summary or ``not_found``; foreign
    documents look the same as absent ones."""
    asked = requests.select("doc_id").distinct()
    mine = docs.join(asked, "doc_id", "left_semi")  # neither the store's documents nor its chunks are gone through as a whole
    found = doc_summaries(mine, chunks.join(asked, "doc_id", "left_semi")).withColumn("_hit", F.lit(True))
    return (
        requests.join(found, ["doc_id", "tenant_id"], "left")
        .withColumn("outcome", F.when(F.col("_hit"), "found").otherwise("not_found"))
        .drop("_hit")
    )


def delete_docs(docs: DataFrame, chunks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks that remain; ``doomed`` carries doc_id (unique)."""
    ids = doomed.select("doc_id")
    return docs.join(ids, "doc_id", "left_anti"), chunks.join(ids, "doc_id", "left_anti")


def delete_by_tag(docs: DataFrame, chunks: DataFrame, tenant: str, tag: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining documents, remaining chunks, one-row count of deleted documents)."""
    if not tag or not tag.strip():
        raise ValueError("tag must not be blank")
    doomed = with_tag(docs.where(F.col("tenant_id") == tenant), tag)
    kept_docs, kept_chunks = delete_docs(docs, chunks, doomed)
    return kept_docs, kept_chunks, doomed.agg(F.count("*").alias("deleted"))


def purge_expired(docs: DataFrame, chunks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    doomed = docs.where(~is_live(now))
    kept_docs, kept_chunks = delete_docs(docs, chunks, doomed)
    return kept_docs, kept_chunks, doomed.agg(F.count("*").alias("deleted"))


def reseed(docs: DataFrame, chunks: DataFrame, fresh_docs: DataFrame, fresh_chunks: DataFrame, tenant: str, tag: str):
    """Without the tagged documents, plus the fresh ones."""
    kept_docs, kept_chunks, _ = delete_by_tag(docs, chunks, tenant, tag)
    return kept_docs.unionByName(fresh_docs), kept_chunks.unionByName(fresh_chunks)


def kb_status(docs: DataFrame, chunks: DataFrame, tag: str = L.PLACEHOLDER_TAG) -> DataFrame:
    """Documents, placeholders, real documents and chunks per tenant."""
    by_tenant = docs.groupBy("tenant_id").agg(
        F.count("*").alias("documents"), F.count_if(F.array_contains("tags", tag)).alias("placeholders")
    )
    chunk_counts = (
        chunks.groupBy("doc_id").agg(F.count("*").alias("n")).join(docs.select("doc_id", "tenant_id"), "doc_id")
        .groupBy("tenant_id").agg(F.sum("n").alias("chunks"))
    )
    return (
        by_tenant.join(chunk_counts, "tenant_id", "left")
        .withColumn("real_documents", F.col("documents") - F.col("placeholders"))
        .withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    )


def kb_parts(docs: DataFrame, tag: str = L.PLACEHOLDER_TAG) -> tuple[DataFrame, DataFrame]:
    """(placeholder documents, real documents)."""
    held = F.coalesce(F.array_contains("tags", tag), F.lit(False))
    return docs.where(held), docs.where(~held)


def ingest(
    batch: DataFrame, kb: DataFrame, now: Column, text: str = "text", order: list[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(document rows, chunk rows without vectors, conflicts).

    The duplicate test comes before chunking and embedding, the expensive steps.
    """
    prepared = prepare_documents(batch, text)
    fresh, conflicts = new_documents(prepared, kb, order)
    return with_expiry(fresh, now), chunk_documents(fresh, text), conflicts


def context_text(
    scenes: DataFrame, hits: DataFrame, key: list[str], max_chars: int | None = None, enabled: bool = True
) -> DataFrame:
    """``[title] snippet`` blocks in rank order per scene; the none-marker without a hit.

    ``hits`` carries key, rank, title, chunk_text and at most k rows per scene, so the list
    of a scene is bounded by k.
    """
    from riskframe.functions.text import snippet

    if not enabled:
        return scenes.withColumn("kb_context", F.lit(L.NO_CONTEXT))
    block = F.concat(F.lit("["), "title", F.lit("] "), snippet(F.coalesce("chunk_text", F.lit("")), max_chars))
    grouped = hits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("_h"))
    joined = F.array_join(F.transform("_h", lambda x: x["b"]), "\n\n")
    return (
        scenes.join(grouped.select(*key, joined.alias("kb_context")), key, "left")
        .withColumn("kb_context", F.coalesce("kb_context", F.lit(L.NO_CONTEXT)))
    )


def document_id(tenant: Column, hash_: Column) -> Column:
    return stable_id(tenant, hash_)


def seed_tags(tags: Column, marker: str = L.PLACEHOLDER_TAG) -> Column:
    """Tags with the marker appended once."""
    given = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(F.array_contains(given, marker), given).otherwise(F.array_append(given, F.lit(marker)))


def seed_title(meta_title: Column, stem: Column) -> Column:
    return F.coalesce(F.nullif(strip_ws(meta_title), F.lit("")), stem)
