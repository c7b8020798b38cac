"""k nearest chunks per query by cosine distance: an index in the shared folder, and searches in it.

``build_index`` assigns every unit vector to the nearest of about sqrt(n) pivots, once, and writes the
cells. Pivots have pivots of their own: a coarse cell is the cells of the pivots around one of them. The
placed vectors are partitioned by tenant and coarse cell and sorted by cell within, so a search opens the
files of the coarse cells that it probes, and of these the row groups of its cells.

``search`` is exact: a query first looks into the cells around it, which bounds its k-th distance, and
then only into the cells that the triangle inequality cannot rule out. With ``probes`` it stops after so
many nearest cells, like an inverted file; that is faster and approximate, and its recall is measured in
the tests. Where a query has to look is found once and written down. Cells and the queries that probe them
are dealt in blocks of a bounded size, so a cell or tenant that holds a third of all rows is many tasks; a
task compares two blocks as one matrix product and gives back at most k rows for each query.

Vectors may carry ``until``, the time at which they expire: a search at a time filters them while it reads,
and counts its cells by the live ones alone, from three narrow columns.

Vectors that are missing, zero, or of another length than the index's are set aside with a reason.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskframe.functions.vectors import cosine_distance, norm

PLACES = 12
#: Most pivots, and rows of a block on either side.
MAX_PIVOTS, BLOCK = 4096, 2048
#: Rows whose distances from all pivots a task holds at a time.
ROUTED = 256
#: Partitions (tenant, coarse cell) that are named in the filter of a search; more of them are joined.
FILTER_PARTS = 2000
_SLACK = 1e-7


@dataclass(frozen=True)
class Index:
    """Paths of the placed vectors, the cells and the rejected rows, and the pivots as unit vectors."""

    folder: str
    dim: int
    pivots: np.ndarray
    coarse: np.ndarray  # the coarse cell of each pivot

    def read(self, spark, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")

    def vectors(self, spark, parts: DataFrame | None = None) -> DataFrame:
        """The placed vectors; with ``parts(part)`` only those of these partitions."""
        placed = self.read(spark, "placed")
        if parts is None:
            return placed
        names = [r["part"] for r in parts.select("part").distinct().limit(FILTER_PARTS + 1).collect()]
        return placed.where(F.col("part").isin(names)) if len(names) <= FILTER_PARTS else placed.join(parts.select("part").distinct(), "part", "left_semi")


def _part(coarse: Column) -> Column:
    """The partition of a tenant's coarse cell, as a name."""
    return F.concat(F.coalesce(F.col("tenant_id").cast("string"), F.lit("")), F.lit("~"), coarse.cast("string"))


def pivots_of(unit: np.ndarray, n: int) -> np.ndarray:
    """The number of the nearest of the first n vectors, for each vector."""
    return _nearest(unit, unit[:n])[0]


def reject_reason(embedding: Column, dim: int) -> Column:
    """Why a vector has no place in an index of ``dim`` dimensions, NULL if it has."""
    return (
        F.when(embedding.isNull(), "missing")
        .when(F.size(embedding) != dim, "wrong length")
        .when(F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double"))), "not a number")
        .when(norm(embedding) == 0, "zero")
    )


def _unit(column: pd.Series) -> np.ndarray:
    m = np.vstack(column.to_numpy()).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _chords(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit @ pivots.T)))


def _nearest(unit: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every row and its distance, with ROUTED rows of distances at a time."""
    cell, r = np.zeros(len(unit), np.int32), np.zeros(len(unit))
    for at in range(0, len(unit), ROUTED):
        d = _chords(unit[at : at + ROUTED], pivots)
        cell[at : at + ROUTED] = near = d.argmin(axis=1)
        r[at : at + ROUTED] = d[np.arange(len(d)), near]
    return cell, r


def _fields(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def build_index(chunks: DataFrame, folder: str, dim: int, pivots: int | None = None) -> Index:
    """Write the index of ``chunks(chunk_id, tenant_id, embedding[, until])`` to a new folder."""
    spark = chunks.sparkSession
    until = F.col("until").cast("timestamp") if "until" in chunks.columns else F.lit(None).cast("timestamp")
    rows = chunks.select("chunk_id", "tenant_id", "embedding", until.alias("until")).withColumn("reason", reject_reason(F.col("embedding"), dim))
    rows.where("reason IS NOT NULL").select("chunk_id", "tenant_id", "reason").write.parquet(f"{folder}/rejected")
    good = rows.where("reason IS NULL").drop("reason")
    wanted = pivots or min(MAX_PIVOTS, max(1, math.ceil(math.sqrt(good.count()))))
    picked = good.orderBy(F.xxhash64(F.col("chunk_id").cast("string")), "chunk_id").limit(wanted)
    found = picked.select("embedding").toPandas()["embedding"]  # MAX_PIVOTS vectors at most
    centres = _unit(found) if len(found) else np.zeros((1, dim))
    coarse = pivots_of(centres, max(1, math.ceil(math.sqrt(len(centres)))))
    shared = spark.sparkContext.broadcast((centres, coarse))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, r = _nearest(_unit(pdf["embedding"]), shared.value[0])
                yield pdf.assign(cell=cell, r=r, coarse=shared.value[1][cell])

    placed = good.mapInPandas(assign, f"{_fields(good, 'chunk_id', 'tenant_id', 'embedding', 'until')}, cell int, r double, coarse int")
    placed = placed.withColumn("part", _part(F.col("coarse")))
    files = max(1, min(32, math.ceil(good.count() / 2_000_000)))  # of a partition, so that a large one is more than one task
    salted = placed.repartition(F.col("part"), F.pmod(F.xxhash64("cell"), F.lit(files)))
    salted.sortWithinPartitions("part", "cell").write.partitionBy("part").parquet(f"{folder}/placed")
    _cells(spark.read.parquet(f"{folder}/placed")).write.parquet(f"{folder}/cells")
    return Index(folder, dim, centres, coarse)


def _route(queries: DataFrame, index: Index, cells: DataFrame, k: int, block: int, probes: int | None) -> DataFrame:
    """Each query with the cells that it has to look into: at home first, others with a lower bound.

    Queries are dealt in blocks of about ROUTED, and the cells of their tenant go to each block once, as plain columns."""
    cells = cells.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    shared = queries.sparkSession.sparkContext.broadcast(index.pivots)
    load = queries.groupBy("tenant_id").agg(F.ceil(F.count("*") / ROUTED).cast("int").alias("slots"))
    mine = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.col("slots")).cast("int")
    left = queries.join(load, "tenant_id").select("tenant_id", mine.alias("slot"), "query_id", "embedding")
    every = F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")
    right = cells.join(load, "tenant_id").select("tenant_id", every, "cell", "n", "radius", "blocks")
    names = ("tenant_id", "query_id", "cell", "blocks", "home", "lower")

    def one(d: np.ndarray, n: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of the cells to look into, which of them are at home, and their lower bounds."""
        near = np.argsort(d, kind="stable")
        home = np.zeros(len(d), bool)
        home[near[: max(int(np.searchsorted(np.cumsum(n[near]), k)) + 1, probes or 1)]] = True
        order = np.argsort(d + radius, kind="stable")
        place = int(np.searchsorted(np.cumsum(n[order]), k))
        reach = (d + radius)[order[place]] if place < len(order) else np.inf
        lower = np.maximum(0.0, d - radius)
        kept = np.flatnonzero(home if probes else home | (lower <= reach + _SLACK))
        return kept, home[kept], lower[kept]

    def route(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({x: [] for x in names})
        c = c.sort_values("cell")
        cell, n, radius, blocks = (c[x].to_numpy() for x in ("cell", "n", "radius", "blocks"))
        found = []
        for at in range(0, len(q), ROUTED):  # the block of a query that is asked many times is longer
            dist = _chords(_unit(q["embedding"].iloc[at : at + ROUTED]), shared.value[cell])
            found += [one(d, n, radius) for d in dist]
        kept, home, lower = (np.concatenate(x) for x in zip(*found, strict=True))
        who = np.repeat(np.arange(len(q)), [len(x[0]) for x in found])
        return q[["tenant_id", "query_id"]].iloc[who].reset_index(drop=True).assign(cell=cell[kept], blocks=blocks[kept], home=home, lower=lower)

    group = ["tenant_id", "slot"]
    shape = f"{_fields(queries, 'tenant_id', 'query_id')}, cell int, blocks int, home boolean, lower double"
    routed = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(route, shape)
    at = F.get(F.array(*[F.lit(int(c)) for c in index.coarse]), F.col("cell"))
    return routed.withColumn("part", _part(at))


def _top_k(query_ids, dist: np.ndarray, chunk_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k smallest of every row of ``dist``, ties by chunk id."""
    dist = np.round(dist, PLACES)
    if dist.shape[1] > k:
        rows, cols = np.nonzero(dist <= np.partition(dist, k - 1, axis=1)[:, k - 1 : k])
    else:
        rows, cols = np.indices(dist.shape).reshape(2, -1)
    out = pd.DataFrame({"q": rows, "chunk_id": chunk_ids[cols], "distance": dist[rows, cols]})
    out = out.sort_values(["q", "distance", "chunk_id"]).groupby("q", sort=False).head(k)
    return pd.DataFrame({"query_id": np.asarray(query_ids)[out["q"]], "chunk_id": out["chunk_id"], "distance": out["distance"]})


def _compare(probing: DataFrame, placed: DataFrame, k: int, block: int, ids: str) -> DataFrame:
    """Blocks of queries against blocks of their cells."""
    load = probing.groupBy("tenant_id", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("q_blocks"), F.max("blocks").alias("c_blocks"))

    def slot(name: str, blocks: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("string")), F.col(blocks)).cast("int")

    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = probing.select("tenant_id", "cell", "query_id", "embedding").join(load, ["tenant_id", "cell"])
    left = left.select("tenant_id", "cell", every("c_blocks").alias("c_block"), slot("query_id", "q_blocks").alias("q_block"), "query_id", "embedding")
    right = placed.join(load, ["tenant_id", "cell"])
    right = right.select("tenant_id", "cell", slot("chunk_id", "c_blocks").alias("c_block"), every("q_blocks").alias("q_block"), "chunk_id", "embedding")

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []})
        return _top_k(q["query_id"], 1.0 - _unit(q["embedding"]) @ _unit(c["embedding"]).T, c["chunk_id"].to_numpy(), k)

    group = ["tenant_id", "cell", "c_block", "q_block"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(compare, ids)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("distance", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cells(placed: DataFrame) -> DataFrame:
    return placed.groupBy("tenant_id", "cell").agg(F.count("*").alias("n"), F.max("r").alias("radius"))


def knn(queries: DataFrame, index: Index, k: int, probes: int | None = None, block: int = BLOCK, among: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """``queries(query_id, tenant_id, embedding)`` against the index, each within its tenant:
    query_id, chunk_id, distance, rank (1..k).

    With ``now`` the index is taken to hold the vectors that live then, with ``among(chunk_id)`` these only. Where the
    queries look, and what they find at home, is written to the shared folder at once, as each step is told by the one
    before what it has to read; the rest waits until the result is asked for."""
    from riskframe.session import run_dir

    spark = queries.sparkSession
    live = lambda rows: rows if now is None else rows.where(F.col("until").isNull() | (F.col("until") > now))
    mine = lambda rows: rows if among is None else rows.join(among.select("chunk_id"), "chunk_id", "left_semi")
    placed = index.read(spark, "placed")
    cells = index.read(spark, "cells") if among is None and now is None else _cells(mine(live(placed)))
    ids = f"{_fields(queries, 'query_id')}, {_fields(placed, 'chunk_id')}, distance double"
    if k <= 0:
        return spark.createDataFrame([], ids + ", rank int")
    usable = queries.select("query_id", "tenant_id", "embedding").where(reject_reason(F.col("embedding"), index.dim).isNull())
    folder = run_dir(spark, "nearest-routes")
    _route(usable, index, cells, k, block, probes).write.parquet(f"{folder}/routes")
    routed = spark.read.parquet(f"{folder}/routes")
    asked = usable.select("query_id", "tenant_id", "embedding")

    def compare(probing: DataFrame) -> DataFrame:
        vectors = mine(live(index.vectors(spark, probing))).select("tenant_id", "cell", "chunk_id", "embedding")
        return _compare(probing.drop("part").join(asked, ["query_id", "tenant_id"]), vectors, k, block, ids)

    near = _ranked(compare(routed.where("home")), k)
    if probes:
        return near
    near.write.parquet(f"{folder}/near")  # k rows a query
    near = spark.read.parquet(f"{folder}/near")
    best = near.groupBy("query_id").agg(F.max("distance").alias("kth"), F.count("*").alias("n"))
    # a cosine distance x of unit vectors is a chord of sqrt(2x)
    bound = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("kth"))) + _SLACK)
    far = routed.where("NOT home").join(best.select("query_id", bound.alias("bound")), "query_id", "left")
    far = far.where(F.col("bound").isNull() | (F.col("lower") <= F.col("bound"))).drop("bound")
    return _ranked(near.drop("rank").unionByName(compare(far)), k)


def rejected_queries(queries: DataFrame, dim: int) -> DataFrame:
    """Queries that cannot be asked, with the reason."""
    return queries.withColumn("reason", reject_reason(F.col("embedding"), dim)).where("reason IS NOT NULL")


def nearest_to_one(chunks: DataFrame, query: list[float], k: int) -> DataFrame:
    """One query: a scan with the distance as an expression and a top-k, no shuffle."""
    if k <= 0:
        return chunks.select("chunk_id", F.lit(0.0).alias("distance")).limit(0)
    vector = F.array(*(F.lit(float(x)) for x in query))
    ranked = chunks.select("chunk_id", F.round(cosine_distance(F.col("embedding"), vector), PLACES).alias("distance"))
    return ranked.where("distance IS NOT NULL").orderBy("distance", "chunk_id").limit(k)


def search(queries: DataFrame, docs: DataFrame, chunks: DataFrame, index: Index, now, k: int, **options) -> DataFrame:
    """The k nearest of the tenant's live chunks, with title, tags and text of the hit.

    The index holds all chunks; those whose document has expired or is gone are left out before the k are taken."""
    from riskframe.operators.knowledge import is_live

    live = docs.where(is_live(now)).select("doc_id", "title", "tags")
    found = chunks.select("chunk_id", "doc_id", "chunk_text").join(live, "doc_id")
    return knn(queries, index, k, among=found, **options).join(found, "chunk_id")


def search_live(queries: DataFrame, docs: DataFrame, chunks: DataFrame, index: Index, now: Column, k: int, **options) -> DataFrame:
    """The same for an index whose vectors carry ``until`` and whose documents are all there: nothing but the hits is joined."""
    hits = knn(queries, index, k, now=now, **options)
    text = chunks.select("chunk_id", "doc_id", "chunk_text").join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return hits.join(text, "chunk_id").join(docs.select("doc_id", "title", "tags"), "doc_id")
