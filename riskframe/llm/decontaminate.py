"""Benchmark decontamination: a broadcast hash set of normalised test n-grams is held against
every window of words of the training texts; hits are verified word by word; spans or whole
documents are removed.

The n-grams of the benchmark are counted first and cut into blocks of a bounded number of rows
and bytes. A single block is broadcast and the documents are passed by it without any shuffle. Of
several, each is a job of its own: it is built, broadcast, passed by and destroyed before the next
one, and leaves a table of hits by row number; these small tables are merged at the end. So more
items mean more passes, never a larger broadcast or more workers in a task.

Defined results for odd input:
- a null or empty text (or one without words) has no words, no hits and isn't contaminated;
- an item without words has no windows; items that share a window are all found by it;
- a null item_id still marks words, but isn't counted among the items;
- repeated documents and repeated items are judged row by row and counted once each;
- extra columns are passed on; one that has the name of a result column gives way to it.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskframe.llm.frames import column_index, cut, numbered, pick, shared_folder, table, through_table, with_results
from riskframe.llm.words import ALNUM, LOWER, Words, code_points, read_words, slices, window_hashes

WINDOW = 13
#: A broadcast block of benchmark windows holds about so many rows and bytes at most.
BLOCK_ROWS, BLOCK_BYTES = 500_000, 64 << 20
#: A document is contaminated if at least one word in so many is hit.
ONE_HIT_IN = 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RESULTS = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "hit_spans"]
_GATE_BITS = 20


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(window, item): the distinct windows of every item; an item with fewer words is one window."""
    rows = pick(benchmark, item=item, text=text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.select(F.col("item").cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(window - 1), F.lit(1)))
    rows = rows.where(F.size("words") > 0).withColumn("at", F.explode(starts))
    return rows.select(F.array_join(F.slice("words", F.col("at"), F.lit(window)), " ").alias("window"), "item").distinct()


class _Block:
    """One broadcast block: by window length, a gate of bits and the sorted hashes; and the windows themselves."""

    def __init__(self, rows: list) -> None:
        self.items: dict[bytes, list] = defaultdict(list)
        for window, item in rows:
            self.items[window.encode()].append(item)
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for window in self.items:
            by_length[window.count(b" ") + 1].append(window)
        self.lengths = {}
        for length, windows in by_length.items():
            data = np.frombuffer(b" ".join(windows), dtype=np.uint8)
            words = read_words(data, np.array([0, len(data)]), ALNUM)
            hashes = np.unique(window_hashes(words.hashes(lower=True), length)[::length])
            gate = np.zeros(1 << _GATE_BITS, dtype=bool)
            gate[hashes >> np.uint64(64 - _GATE_BITS)] = True
            self.lengths[length] = gate, hashes

    def find(self, data: np.ndarray, words, hashes: np.ndarray) -> Iterator[tuple[int, int, list]]:
        """(start, length, items) of every verified occurrence."""
        lower = None
        for length, (gate, known) in self.lengths.items():
            found = window_hashes(hashes, length)
            maybe = np.flatnonzero(gate[found >> np.uint64(64 - _GATE_BITS)] & words.whole_windows(length))
            if not len(maybe):
                continue
            near = np.minimum(np.searchsorted(known, found[maybe]), len(known) - 1)
            lower = data.tobytes().translate(LOWER) if lower is None else lower
            for i in maybe[known[near] == found[maybe]].tolist():
                spans = zip(words.start[i : i + length].tolist(), words.end[i : i + length].tolist())
                items = self.items.get(b" ".join([lower[s:e] for s, e in spans]))
                if items is not None:
                    yield i, length, items


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _found(known, data: np.ndarray, words: Words) -> tuple[np.ndarray, dict[int, set]]:
    """Which words of a slice a block's windows cover, and the items of each of its texts."""
    hit, items, owner = np.zeros(len(words.start), dtype=bool), defaultdict(set), words.text_of_word()
    for i, length, which in known.find(data, words, words.hashes(lower=True)):
        hit[i : i + length] = True
        items[int(owner[i])].update(x for x in which if x is not None)
    return hit, items


def _hits(block):
    """(row, text) to (row, hits, items), rows with hits alone: one block of several."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value
        for batch in batches:
            rows, places, named = [], [], []
            for lo, hi, data, offsets in slices(batch.column(1)):
                words = read_words(data, offsets, ALNUM)
                hit, items = _found(known, data, words)
                for d in np.flatnonzero(words.summed(hit.astype(np.int64))):
                    rows.append(lo + int(d))
                    places.append(np.flatnonzero(hit[words.first[d] : words.first[d + 1]]).astype(np.int32))
                    named.append(sorted(items[int(d)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, type=pa.int64())), pa.array(places, type=pa.list_(pa.int32())), pa.array(named, type=pa.list_(pa.string()))], names=["row", "hits", "items"])

    return run


def _finish(block, at: int, schema: pa.Schema):
    """mapInArrow: what is returned for each text, from the only block, or (None) from the hits that stand in the last two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_in = batch.num_columns - 2 * (block is None)
            out: list[list] = [[] for _ in _RESULTS]
            for lo, hi, data, offsets in slices(batch.column(at)):
                words = read_words(data, offsets, ALNUM)
                hit, items = _found(block.value, data, words) if block is not None else (np.zeros(len(words.start), dtype=bool), {})
                points = code_points(data)
                for d in range(hi - lo):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    if block is None and batch.column(n_in)[lo + d].is_valid:
                        hit[a + batch.column(n_in)[lo + d].values.to_numpy()] = True
                        items[d] = set(batch.column(n_in + 1)[lo + d].as_py())
                    named = sorted(items[d]) if d in items else []
                    own = hit[a:b]
                    n_hit = int(own.sum())
                    spans = []
                    if n_hit:
                        base = points[offsets[d]]
                        spans = [{"start": int(points[words.start[a + s]] - base), "end": int(points[words.end[a + e - 1]] - base)} for s, e in zip(*_runs(own))]
                    row = (b - a, n_hit, len(named), named, hashlib.sha256(",".join(named).encode()).hexdigest(), n_hit > 0 and ONE_HIT_IN * n_hit >= b - a, spans)
                    for column, value in zip(out, row):
                        column.append(value)
            arrays = [batch.column(i) for i in range(n_in)]
            arrays += [pa.array(v, type=schema.field(n_in + i).type) for i, v in enumerate(out)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _through_blocks(df: DataFrame, grams: DataFrame, blocks: int, at: int) -> DataFrame:
    """df with __hits and __items. Each block is a job of its own: it is built, broadcast, held against all texts, and let go of
    before the next one; between them stand tables of hits by row number, in the shared folder."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/decontaminate-{uuid.uuid4().hex}"
    grams = through_table(grams.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)).cast("int")), f"{folder}/grams")
    rows = cut(df.withColumn("row", F.monotonically_increasing_id()))  # the numbers stay, whatever is run again
    for k in range(blocks):
        block = spark.sparkContext.broadcast(_Block([tuple(r) for r in grams.where(F.col("block") == k).drop("block").toLocalIterator()]))
        rows.select("row", f"c{at}").mapInArrow(_hits(block), "row long, hits array<int>, items array<string>").write.parquet(f"{folder}/hits/{k}")
        block.destroy()
    hits = spark.read.schema("row long, hits array<int>, items array<string>").parquet(*[f"{folder}/hits/{k}" for k in range(blocks)])
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("__hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items"))
    return rows.join(hits, "row", "left").select(*df.columns, "__hits", "__items")


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted as strings), items_sha256, contaminated, and hit_spans (code points)."""
    spark = docs.sparkSession
    grams = benchmark_windows(benchmark, item, item_text, window)
    n, size = grams.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / block_rows), math.ceil(size / block_bytes))
    df, names = numbered(docs)
    at, n_in = column_index(docs, text), len(names)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.StringType(), T.BooleanType(), T.ArrayType(span)]
    final = [T.StructField(k, v) for k, v in zip(_RESULTS, kinds)]
    df = df.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    shape = T.StructType([*df.schema.fields, *final])
    block = spark.sparkContext.broadcast(_Block([tuple(r) for r in grams.toLocalIterator()])) if blocks == 1 else None
    df = df if block else _through_blocks(df, grams, blocks, at)
    df = df.mapInArrow(_finish(block, at, to_arrow_schema(shape)), shape)
    return with_results(df, names, _RESULTS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit spans cut out of every text."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    names = docs.columns
    inner, _ = numbered(docs)
    at = column_index(docs, text)
    found = scan(inner, benchmark, text=f"c{at}", **options)
    if remove == "documents":
        return found.where(~F.col("contaminated")).select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
    starts = F.transform(F.array_union(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), "hit_spans"), lambda s: s["end"])
    ends = F.concat(F.transform("hit_spans", lambda s: s["start"]), F.array(F.char_length(f"c{at}")))
    kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(F.col(f"c{at}"), p["a"] + 1, p["b"] - p["a"]))
    cut = F.when(F.size("hit_spans") > 0, F.array_join(kept, "")).otherwise(F.col(f"c{at}"))
    return found.withColumn(f"c{at}", cut).select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, len(list_slice(w, i, i + 12)) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM g),
v AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
h AS (SELECT v.doc_id, v.i, v.n, g.item FROM v JOIN g ON v.n = g.n AND v.gram = g.gram),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
