"""Centroid clustering of integer vectors, by scalar lookup tables.

1. Vectors are packed once into blocks of some thousand rows and written as a table: for each
   dimension the integers that occur in the block, in rising order, and for each vector and
   dimension the place of its integer among them.
2. In each round every block tabulates, for each dimension, occurring integer and centroid, the
   squared difference; a vector's distances are then 64 gathers from these tables and their sums.
   Sums and counts are added up within the task, then by Spark, and 8 x 64 sums reach the driver.
3. A last assignment gives the rows; each is written once with its distance.

All arithmetic is on whole numbers, so the result depends neither on the order nor on the split of
the rows. The blocks and the last assignment lie in the shared folder: a lost executor costs its
tasks, no more.

Defined results for odd input:
- a null vector, one of another length, or with a null, infinite or not-a-number component is left out;
- so is one with an integer beyond 2**27 (a component beyond 131,072), whose squared distances
  would not fit in 64 bits;
- a null id is hashed as the empty text; repeated rows are kept, and rows with equal hashes are
  taken in the order of their integers, so that equal rows may both be starting centroids;
- fewer rows than centroids: as many centroids as rows; an empty table gives no rows;
- an inertia that doesn't fit in 64 bits is null; extra columns are never looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.frames import pick, shared_folder, table, through_table

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Largest integer that a vector may hold, and rows of a block.
MOST, BLOCK_ROWS = 1 << 27, 4096
_PACKED = "ids array<long>, present array<boolean>, sizes binary, values binary, places binary, wide boolean"


def integers(embedding: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """The vector as integers floor(scale * x); null if it isn't to be kept."""
    doubles = embedding.cast("array<double>")
    whole = F.size(doubles) == dimensions
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.floor(F.abs(x) * scale) <= MOST) & (F.abs(x) < 1e18))
    return F.when(whole & fine, F.transform(doubles, lambda x: F.floor(x * scale).cast("int")))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dimensions)


def _pack(dimensions: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            vectors, keys = np.concatenate(held), pa.concat_arrays(ids)
            values, places, sizes = [], np.empty((dimensions, len(vectors)), dtype=np.uint32), np.empty(dimensions, dtype=np.int32)
            for d in range(dimensions):
                found, places[d] = np.unique(vectors[:, d], return_inverse=True)
                values.append(found)
                sizes[d] = len(found)
            wide = bool(sizes.max() > 1 << 16)
            one = lambda x: pa.array([x], type=pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([keys.fill_null(0).to_numpy()], type=pa.list_(pa.int64())), pa.array([keys.is_valid().to_numpy(zero_copy_only=False)], type=pa.list_(pa.bool_())),
                 one(sizes.tobytes()), one(np.concatenate(values).tobytes()), one(places.astype(np.uint32 if wide else np.uint16).tobytes()), pa.array([wide])],
                names=["ids", "present", "sizes", "values", "places", "wide"])

        n = 0
        for batch in batches:
            for lo in range(0, len(batch), rows):
                part = batch.slice(lo, rows)
                ids.append(part.column(0)), held.append(_matrix(part.column(1), dimensions))
                n += len(part)
                if n >= rows:
                    yield block()
                    ids.clear(), held.clear()
                    n = 0
        if n:
            yield block()

    return run


class Block:
    """A packed block: occurring integers of each dimension, and each vector's places among them."""

    def __init__(self, row: dict, dimensions: int) -> None:
        sizes = np.frombuffer(row["sizes"], dtype=np.int32)
        self.values = np.split(np.frombuffer(row["values"], dtype=np.int32).astype(np.int64), np.cumsum(sizes)[:-1])
        self.places = np.frombuffer(row["places"], dtype=np.uint32 if row["wide"] else np.uint16).reshape(dimensions, -1)

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distances, centroid by vector: gathers from one table for each dimension."""
        out = np.zeros((len(centroids), self.places.shape[1]), dtype=np.int64)
        for values, places, at in zip(self.values, self.places, centroids.T):
            squares = values[None, :] - at[:, None]
            squares *= squares
            out += squares[:, places]
        return out

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Sum of the vectors of each cluster, cluster by dimension: occurrences of each integer times the integer."""
        out = np.empty((k, len(self.values)), dtype=np.int64)
        for d, (values, places) in enumerate(zip(self.values, self.places)):
            times = np.bincount(cluster * len(values) + places, minlength=k * len(values)).reshape(k, -1)
            out[:, d] = times @ values
        return out


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            row |= {name: row[name].as_py() for name in ("sizes", "values", "places", "wide")}
            yield row, Block(row, dimensions)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dimensions = centroids.shape
        counts, totals = np.zeros(k, dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for _, block in _blocks(batches, dimensions):
            cluster = block.distances(centroids).argmin(axis=0)
            counts += np.bincount(cluster, minlength=k)
            totals += block.sums(cluster, k)
        if counts.any():
            at = np.indices((k, dimensions))
            yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel()), pa.array(at[1].ravel()), pa.array(np.repeat(counts, dimensions)), pa.array(totals.ravel())], names=["cluster", "d", "n", "total"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks(batches, centroids.shape[1]):
            distances = block.distances(centroids)
            cluster = distances.argmin(axis=0)
            ids, missing = row["ids"].values.to_numpy(), ~row["present"].values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=missing), pa.array(cluster.astype(np.int32)), pa.array(distances[cluster, np.arange(len(cluster))])], names=["vec_id", "cluster", "distance"])

    return run


def kept(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the vectors that take part, as integers."""
    rows = pick(vectors, vec_id=vec_id, embedding=embedding).select(F.col("vec_id").cast("long"), integers(F.col("embedding"), dimensions, scale).alias("x"))
    return rows.where(F.col("x").isNotNull())


def starting(rows: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, k rows at the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.array([r["x"] for r in first], dtype=np.int64)


def move(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Each centroid with vectors goes to the floor of their mean; the others stay."""
    out = centroids.copy()
    for r in sums:
        if r["n"]:
            out[r["cluster"], r["d"]] = int(r["total"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) for each vector that takes part, the final centroids)."""
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/centroids-{uuid.uuid4().hex}"
    rows = kept(vectors, vec_id, embedding, dimensions, scale)
    centroids = starting(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.empty((0, dimensions), dtype=np.int64)
    packed = through_table(rows.mapInArrow(_pack(dimensions, BLOCK_ROWS), _PACKED), f"{folder}/blocks")
    for _ in range(rounds):
        each = packed.mapInArrow(_sums(centroids), "cluster long, d long, n long, total long")
        sums = each.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k x dimensions rows
        moved = move(centroids, sums)
        if (moved == centroids).all():
            break
        centroids = moved
    return through_table(packed.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"), f"{folder}/assigned"), centroids


def digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with the inertia of its cluster and of all, and the digest of its final centroid."""
    totals = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # a row for each centroid
    by_cluster = {r["cluster"]: int(r["total"]) for r in totals}
    fits = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    inertia, digest = F.lit(None).cast("long"), F.lit(None).cast("string")
    for number, text in enumerate(digests(centroids)):
        mine = F.col("cluster") == number
        inertia = F.when(mine, fits(by_cluster.get(number, 0))).otherwise(inertia)
        digest = F.when(mine, F.lit(text)).otherwise(digest)
    return assigned.select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), fits(sum(by_cluster.values())).alias("inertia"), digest.alias("centroid_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return report(*cluster(table(spark, sf_dir, "embeddings")))


def _oracle() -> str:
    """All rounds written out, over unnested components."""
    n = "(coalesce(sum(v) // count(*), 0))"  # of multiples only, so that the sign makes no difference
    floor = n.replace("sum(v)", "(sum(v) - ((sum(v) % count(*)) + count(*)) % count(*))")
    parts = [
        f"k AS (SELECT row_number() OVER () AS r, vec_id, e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) WHERE len(e) = {DIMENSIONS} AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, vec_id, d, CAST(floor({SCALE} * e[d]) AS BIGINT) AS v FROM k, range(1, {DIMENSIONS + 1}) AS t(d))",
        f"s AS (SELECT r, CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS c FROM k ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) LIMIT {CENTROIDS})",
        "c0 AS MATERIALIZED (SELECT c, d, v FROM s JOIN x USING (r))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"m{i} AS (SELECT x.r, c{i}.c, CAST(sum((x.v - c{i}.v) * (x.v - c{i}.v)) AS BIGINT) AS q FROM x JOIN c{i} USING (d) GROUP BY x.r, c{i}.c)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, c, q FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY q, c) AS best FROM m{i}) WHERE best = 1)")
        if i < ROUNDS:
            parts.append(f"n{i} AS (SELECT c, d, CAST({floor} AS BIGINT) AS v FROM a{i} JOIN x USING (r) GROUP BY c, d)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, c{i}.d, coalesce(n{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN n{i} USING (c, d))")
    last = f"a{ROUNDS}"
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    return f"WITH {', '.join(parts)} SELECT vec_id, c AS cluster, q AS distance, CAST(sum(q) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(q) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM {last} JOIN k USING (r) JOIN h USING (c)"


ORACLE = _oracle()
