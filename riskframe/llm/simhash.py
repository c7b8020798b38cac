"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most two of 64 bits share at least six of their eight positional
bytes. Postings are kept for four positional bytes at a time (two of four neighbouring pairs, six
postings a fingerprint), because a single byte has only 256 values: lists for it would grow as
the square of the input. Any two fingerprints within two bits meet in at least one posting list;
there the shared positional bytes of each pair are tallied, pairs with fewer than six are dropped,
and what is left is verified bit by bit. A list that is too long for that (near copies crowd into
few lists) is dealt out again by midpoints: each member is filed under its four remaining bytes and
under all that differ from them in one bit. Two members within two bits share such a file, and
all members of a file are within two bits of each other, so a star of links is enough.

Only different fingerprints are compared; copies ride along with theirs. Components come from
alternating large-star and small-star steps, with lineage cut after each.

Defined results for odd input:
- a null or empty text has no words: its fingerprint is zero and is linked like any other;
- a text of fewer than ``shingle`` words is one shingle, its whole sequence;
- repeated documents give a row each; a null id is never the smallest, but belongs to its component;
- an empty table gives no rows; extra columns never clash, as only the id and the text are looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import resemblance
from riskframe.llm.frames import column_index, cut, numbered, pick, shared_folder, small_batches, table, through_table
from riskframe.llm.words import LOWER, read_words, slices

SHINGLE, SEED, MAX_BITS, LEAST_BYTES = 3, 42, 2, 6
#: A posting list of at most so many different fingerprints is compared pair by pair, a longer one by midpoints.
PAIRED_LIST = 32
_BITS_AT_ONCE = 1 << 17


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprints of the texts of a slice."""
    words = read_words(data, offsets)
    lengths, counts = words.end - words.start, words.counts
    starts = np.cumsum(lengths + 1) - lengths - 1  # of the words, once they are joined by single spaces
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    inside = np.cumsum(inside[:-1]) > 0
    joined = np.full(int(lengths.sum()) + len(lengths), 0x20, dtype=np.uint8)
    joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = np.frombuffer(LOWER, dtype=np.uint8)[data[inside]]
    joined, ends = joined.tobytes(), starts + lengths
    n_shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = np.concatenate(([0], np.cumsum(n_shingles)))
    owner = np.repeat(np.arange(words.texts), n_shingles)
    head = np.repeat(words.first[:-1], n_shingles) + np.arange(first[-1]) - first[owner]
    tail = np.minimum(head + shingle, words.first[owner + 1]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[head].tolist(), ends[tail].tolist())], dtype=np.uint64)
    ones = np.zeros((words.texts, 64), dtype=np.int64)
    for a in range(0, len(hashes), _BITS_AT_ONCE):
        part = hashes[a : a + _BITS_AT_ONCE]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[a : a + len(part)]
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    set_bits = 2 * ones > n_shingles[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def _run(at: int, shingle: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints(data, offsets, shingle) for _, _, data, offsets in slices(batch.column(at))]
            found = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at or batch.num_columns == len(schema) - 1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found.view(np.int64))], schema=schema)

    return run


def with_fingerprints(docs: DataFrame, text: str, keep_text: bool = True, shingle: int = SHINGLE) -> DataFrame:
    """docs with ``fp``, the fingerprint as a long; the text is left out on demand."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.withColumn(text, F.col(text).cast("string"))
    at = docs.columns.index(text)
    shape = T.StructType([f for i, f in enumerate(docs.schema.fields) if keep_text or i != at] + [T.StructField("fp", T.LongType())])
    return docs.mapInArrow(_run(at, shingle, to_arrow_schema(shape)), shape)


def shared_bytes(a, b):
    """Number of positional bytes in which two longs agree."""
    x = a.bitwiseXOR(b)
    return sum(F.when(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for k in range(8))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) links between different fingerprints of column ``fp``, enough to connect all that are within two bits."""
    block = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    pairs = list(combinations(range(4), 2))
    posting = []
    for k, (i, j) in enumerate(pairs):
        m, n = (x for x in range(4) if x not in (i, j))
        posting.append(F.struct(F.lit(k).alias("place"), (block(i) * 65536 + block(j)).alias("held"), (block(m) * 65536 + block(n)).alias("rest")))
    postings = distinct.select("fp", F.explode(F.array(*posting)).alias("p")).select("fp", "p.*")
    lists = postings.groupBy("place", "held").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(postings.join(lists, ["place", "held"]))

    short = met.where(F.col("n") <= PAIRED_LIST).groupBy("place", "held").agg(F.array_sort(F.collect_list("fp")).alias("l"))
    tally = lambda a, b: (shared_bytes(a, b) >= LEAST_BYTES) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)
    near = F.flatten(F.transform("l", lambda a: F.transform(F.filter("l", lambda b: (b > a) & tally(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    paired = short.select(F.explode(near).alias("x")).select("x.a", "x.b")

    files = F.array(F.col("rest"), *[F.col("rest").bitwiseXOR(F.lit(1 << i)) for i in range(32)])
    filed = met.where(F.col("n") > PAIRED_LIST).select("fp", "place", "held", F.explode(files).alias("file"))
    lead = filed.groupBy("place", "held", "file").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z")
    starred = filed.join(lead, ["place", "held", "file"]).where("fp > a").select("a", F.col("fp").alias("b"))
    return paired.union(starred).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for all nodes that have a link."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    either = lambda x, y, df: df.select(F.explode(F.array(x, y)).alias("e")).select("e.*")
    before = sign(edges)
    while before[0]:
        both = either(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")), edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        both = either(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")), large.join(lowest, "u"))
        edges = cut(both.where("u <> v").distinct())
        after = sign(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(rows: DataFrame) -> DataFrame:
    """(f, least, root, component_id) for each different ``fp`` of rows (id, fp): its smallest id, a fingerprint that
    names its component, and the component's smallest id."""
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    linked = components(links(distinct))
    roots = linked.select(F.explode(F.array("node", "root")).alias("node"), "root").distinct()
    lowest = roots.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("lowest"))
    found = roots.join(lowest, "root").select("node", "root", "lowest")
    both = distinct.join(found, F.col("fp") == F.col("node"), "left")
    return both.select(F.col("fp").alias("f"), "least", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("component_id"))


def _marked(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    rows = pick(docs, id=doc_id, text=text)
    return cut(with_fingerprints(rows, "text", keep_text=False, shingle=shingle))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """A row (doc_id, fingerprint, component_id) for each document: 16 hex digits, and the smallest id that links reach."""
    marked = _marked(docs, doc_id, text, shingle)
    out = marked.join(classes(marked), F.col("fp") == F.col("f"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = resemblance.SIMILARITY) -> DataFrame:
    """docs with one row of each group: the one of the smallest id (the smallest text, should that id be repeated).

    A group is a component of fingerprints within two bits; such components are further joined by
    links between texts with at least the given similarity on five-word shingles, unless it is None.
    Copies of a text ride along with it; different texts of one fingerprint are compared each on its own.
    If all ids of a component of fingerprints are null, one of its rows stays as well."""
    with small_batches(docs.sparkSession):
        return _keep_one(docs, doc_id, text, shingle, similarity)


def _keep_one(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float | None) -> DataFrame:
    df, names = numbered(docs)
    ident, body = (f"c{column_index(docs, c)}" for c in (doc_id, text))
    marked = pick(docs, id=doc_id, text=text).withColumn("body", F.xxhash64(F.col("text").cast("string")))
    marked = cut(with_fingerprints(marked, "text", keep_text=False, shingle=shingle))
    found = cut(classes(marked))
    named = found.where(F.col("least").isNotNull()).select(F.col("least").cast("long").alias("id"), F.col("component_id").cast("long").alias("to"), F.col("f").alias("fp"))
    leads = named.select(F.col("to").alias("id")).distinct()
    if similarity is not None:
        folder = f"{shared_folder(docs.sparkSession)}/simhash-{uuid.uuid4().hex}"
        rows = pick(docs, id=doc_id, text=text).select(F.col("id").cast("long"), F.col("text").cast("string"))
        bodies = marked.where("id is not null").groupBy("fp", "body").agg(F.min("id").cast("long").alias("id"))
        named = cut(bodies.join(named.select("to", F.col("fp").alias("f")), F.col("fp") == F.col("f")).select("id", "to", "fp"))
        edges = resemblance.similar(rows, named, lambda x, name: through_table(x, f"{folder}/{name}"), similarity)
        edges = cut(edges.unionAll(named.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))))
        leads = named.select("id").join(components(edges).select(F.col("node").alias("id")), "id", "left_anti")
    kept = df.join(leads, F.col(ident) == F.col("id")).drop("id")
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy(ident).orderBy(body)))
    nameless = with_fingerprints(df.where(F.col(ident).isNull()), body, shingle=shingle)
    nameless = nameless.join(found.where(F.col("component_id").isNull()), F.col("fp") == F.col("f"))
    nameless = nameless.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy(body)))
    return kept.unionByName(nameless.select(*kept.columns)).where("nth = 1").drop("nth").toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
