"""Substring dedup: repeated runs of words, by prefix-partitioned suffix trees.

A suffix tree over all suffixes would move every word some fifty times. So the trees are sparse:
only suffixes that begin at an anchor are kept. The anchor of a window of 50 words is the k-gram
(16 words) of the smallest hash inside it, the first of equals. Equal windows have equal anchors
at equal places, so no repeat is lost, and neighbouring windows mostly share theirs, so there are
about as many anchored suffixes as there are words divided by 18.

1. Each document emits its segments: an anchor with the run of windows that have it. Segments are
   counted by anchor, which is the suffixes' prefix. A prefix that occurs in one document only
   cannot be an inner node of any tree and is dropped; equal segments become one, with the
   smallest id (this is where groups of copies collapse, before any shuffle by prefix).
2. For prefixes with several different segments, one document hands in the words of each.
3. Suffixes are partitioned by prefix. A group that fits in memory becomes a subtree: the sorted
   suffixes with their longest common prefixes, on both sides of the anchor. Deep internal nodes
   (50 words, counted over both sides) are the repeats, and the smallest id below such a node is
   where the repeat is kept. A prefix with more suffixes than that is lengthened to the whole window
   of 50 words, at which depth a node is a group of a plain aggregation.
4. Each document looks up its segments and removes the words of windows that an earlier document has.

Defined results for odd input:
- a null or empty text has no words, and texts of fewer words than a window lose nothing;
- a document whose id is null keeps its text and takes no part in the comparison;
- rows that share an id are one document: they take nothing from each other;
- a document that repeats itself keeps both passages (only a smaller id removes);
- an empty table gives no rows; extra columns are passed on, and give way to results of their name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskframe.llm.frames import column_index, numbered, pick, shared_folder, table, through_table, with_results
from riskframe.llm.words import U64, Words, mix, powers, read_words, slices, window_hashes

WINDOW = 50
#: At most so many windows have one anchor, so that a segment's verdicts fit in one long.
SPAN = 35
#: Suffixes of one prefix that are put into one subtree (11 MB of words); a prefix with more is lengthened.
GROUP = 16_384
_BATCH = 8192
_CHUNK = 1 << 18


def gram_of(window: int) -> int:
    return max(1, window - SPAN + 1)


def _borders(first: np.ndarray) -> list[int]:
    """Where chunks of at most _CHUNK words begin and end: a text that is cut is so at multiples from its own first word,
    so that its segments don't depend on its neighbours."""
    out = [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - out[-1] > _CHUNK and a > out[-1]:
            out.append(a)
        while b - out[-1] > _CHUNK:
            out.append(out[-1] + _CHUNK)
    return [*out, int(first[-1])]


class Segments:
    """The segments of a slice's texts: lo..hi are the first words of the windows that have the anchor."""

    def __init__(self, words: Words, window: int) -> None:
        hashes, valid, k = words.hashes(), words.whole_windows(window), gram_of(window)
        lo, hi, at, anchor, ident = [], [], [], [], []
        borders = _borders(words.first)
        for c, e in zip(borders[:-1], borders[1:]):
            part, ok = hashes[c : e + window - 1], valid[c:e]
            starts = np.flatnonzero(ok)
            if not len(starts):
                continue
            grams = window_hashes(part, k)
            places = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1)[: len(ok)].argmin(axis=1) + np.arange(len(ok))
            own = places[starts]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(own) != 0))))
            first, last = starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1]
            sums = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum(part * powers(len(part)), out=sums[1:])
            whole = (sums[last + window] - sums[first]) * powers(len(part), True)[first]
            lo.append(first + c), hi.append(last + c), at.append(own[new] + c)
            anchor.append(grams[own[new]]), ident.append(mix(whole ^ mix((own[new] - first).astype(U64) + U64(1))))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        self.hashes, self.lo, self.hi, self.at = hashes, join(lo, np.int64), join(hi, np.int64), join(at, np.int64)
        self.anchor, self.ident = join(anchor, U64).view(np.int64), join(ident, U64).view(np.int64)
        self.text = np.searchsorted(words.first, self.lo, side="right") - 1


def _emit(window: int):
    """(doc, text) to (doc, anchor, seg)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in slices(batch.column(1)):
                found = Segments(read_words(data, offsets), window)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + found.text].astype(np.int64)), pa.array(found.anchor), pa.array(found.ident)], names=["doc", "anchor", "seg"])

    return run


def _pair_keys(owner: np.ndarray, anchor: np.ndarray, seg: np.ndarray) -> np.ndarray:
    return mix(anchor.view(U64) ^ mix(seg.view(U64) ^ mix(owner.astype(U64) + U64(1))))


def _flat(lists: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each struct in a column of lists, and the structs' fields."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = lists.flatten()
    return np.repeat(np.arange(len(counts)), counts), [inner.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _hand_in(window: int):
    """(doc, text, wanted) to (anchor, seg, doc, n, place, words): the words of the wanted segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            row, (anchor, seg, n) = _flat(batch.column(2), ["anchor", "seg", "n"])
            keys = _pair_keys(row, anchor, seg)
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            for lo, _, data, offsets in slices(batch.column(1)):
                found = Segments(read_words(data, offsets), window)
                mine = _pair_keys(found.text + lo, found.anchor, found.ident)
                _, first = np.unique(mine, return_index=True)
                near = np.minimum(np.searchsorted(keys, mine[first]), max(len(keys) - 1, 0))
                got = first[keys[near] == mine[first]] if len(keys) else first[:0]
                size = n[near[keys[near] == mine[first]]] if len(keys) else n
                words = [found.hashes[a:b].tobytes() for a, b in zip(found.lo[got].tolist(), (found.hi[got] + window).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.anchor[got]), pa.array(found.ident[got]), pa.array(ids[lo + found.text[got]].astype(np.int64)), pa.array(size),
                     pa.array((found.at[got] - found.lo[got]).astype(np.int32)), pa.array(words, type=pa.binary())],
                    names=["anchor", "seg", "doc", "n", "place", "words"])

    return run


_HANDED = "anchor long, seg long, doc long, n long, place int, words binary"


def _matrix(flat: np.ndarray, base: np.ndarray, lengths: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """Row i holds flat[base[i]], flat[base[i] + 1], ... (or backwards), zero where it has no more."""
    step = np.arange(width)
    here = step[None, :] < lengths[:, None]
    at = base[:, None] + (-step if back else step)[None, :]
    return np.where(here, flat[np.where(here, at, 0)], U64(0))


def _nodes(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Suffix tree of the rows of each group: nodes[d, i] is row i's node at depth d.

    The rows are sorted, and two neighbours part where their longest common prefix ends."""
    order = np.lexsort([*rows.T[::-1], group])
    same = np.zeros((len(order), rows.shape[1] + 1), dtype=bool)
    same[1:, 0] = group[order][1:] == group[order][:-1]
    same[1:, 1:] = rows[order][1:] == rows[order][:-1]
    common = np.where(same.all(axis=1), rows.shape[1] + 1, same.argmin(axis=1))  # levels shared with the row before, the group being the first
    nodes = np.empty((rows.shape[1] + 1, len(order)), dtype=np.int64)
    for depth in range(rows.shape[1] + 1):
        nodes[depth, order] = np.cumsum(common <= depth)
    return nodes


def subtrees(anchor: np.ndarray, docs: np.ndarray, place: np.ndarray, flat: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """first[o, i]: the smallest id with the window that begins o words before segment i's anchor (no such window: the largest long)."""
    lengths = np.diff(starts)
    count = lengths - window + 1
    right = _nodes(anchor, _matrix(flat, starts[:-1] + place, np.minimum(lengths - place, window), window))
    span = window - gram_of(window) + 1
    left = _nodes(anchor, _matrix(flat, starts[:-1] + place - 1, place, span - 1, back=True)) if span > 1 else np.zeros((1, len(docs)), dtype=np.int64)
    first = np.full((span, len(docs)), np.iinfo(np.int64).max)
    for o in range(span):
        rows = np.flatnonzero((o <= place) & (o > place - count))
        node = right[window - o, rows] * (len(docs) + 1) + left[o, rows]  # equal to the right of the anchor and to its left
        _, back = np.unique(node, return_inverse=True)
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, back, docs[rows])
        first[o, rows] = least[back]
    return first


def _plant(window: int):
    """Groups of (anchor, seg, doc, n, place, words), sorted by anchor, to (anchor, seg, firsts)."""

    def grow(batch: pa.RecordBatch) -> pa.RecordBatch:
        anchor, seg, docs = (batch.column(c).to_numpy() for c in (0, 1, 2))
        place = batch.column(4).to_numpy().astype(np.int64)
        words = batch.column(5).cast(pa.large_binary())
        at = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
        flat = np.frombuffer(words.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].view(U64)
        starts = (at - at[0]) // 8
        first = subtrees(anchor, docs, place, flat, starts, window)
        count = np.diff(starts) - window + 1
        row = np.repeat(np.arange(len(docs)), count)
        ends = np.cumsum(count)
        j = np.arange(ends[-1]) - (ends - count)[row]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(first[place[row] - j, row]))
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(seg), lists], names=["anchor", "seg", "firsts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < _BATCH:
                continue
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            anchors = whole.column(0).to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))  # the last group may go on
            for a in _cuts(anchors[:cut]):
                yield grow(whole.slice(*a))
            waiting = [whole.slice(cut)]
        if waiting:
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            for a in _cuts(whole.column(0).to_numpy()):
                yield grow(whole.slice(*a))

    return run


def _cuts(anchors: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, length) of runs of whole groups with about _BATCH rows."""
    lo = 0
    while lo < len(anchors):
        hi = min(lo + _BATCH, len(anchors))
        if hi < len(anchors):
            cut = int(np.searchsorted(anchors, anchors[hi]))
            hi = cut if cut > lo else int(np.searchsorted(anchors, anchors[hi], side="right"))
        yield lo, hi - lo
        lo = hi


def _lengthen(window: int):
    """Segments of too large a group to (anchor, seg, j, prefix, doc): one row for each window, with the whole window as prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [window_hashes(np.frombuffer(w.as_buffer(), dtype=U64), window).view(np.int64) for w in batch.column(5)]
            if found:
                sizes = [len(f) for f in found]
                anchor, seg, doc = (np.repeat(batch.column(c).to_numpy(), sizes) for c in (0, 1, 2))
                j = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, seg, j, np.concatenate(found), doc)], names=["anchor", "seg", "j", "prefix", "doc"])

    return run


def earlier(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(doc, taken) of documents (doc, text): the list of segments with a bit for each window that a smaller id has as well.

    taken is a list of (anchor, seg, bits)."""
    folder = f"{shared_folder(docs.sparkSession)}/substrings-{uuid.uuid4().hex}"
    docs = docs.where(F.col("doc").isNotNull())
    found = through_table(docs.mapInArrow(_emit(window), "doc long, anchor long, seg long"), f"{folder}/segments")
    segments = found.groupBy("anchor", "seg").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    prefixes = segments.groupBy("anchor").agg(F.min("least").alias("lo"), F.max("most").alias("hi"), F.count(F.lit(1)).alias("n"))
    prefixes = prefixes.where("lo < hi").select("anchor", "n")
    shared = through_table(segments.join(prefixes, "anchor").select("anchor", "seg", "least", "n"), f"{folder}/shared")

    wanted = shared.where("n > 1").groupBy("least").agg(F.collect_list(F.struct("anchor", "seg", "n")).alias("wanted"))
    handed = docs.join(wanted, F.col("doc") == F.col("least")).select("doc", "text", "wanted").mapInArrow(_hand_in(window), _HANDED)
    handed = through_table(handed, f"{folder}/suffixes")

    small = handed.where(F.col("n") <= group).repartition("anchor").sortWithinPartitions("anchor")
    planted = small.mapInArrow(_plant(window), "anchor long, seg long, firsts array<long>")
    rows = handed.where(F.col("n") > group).mapInArrow(_lengthen(window), "anchor long, seg long, j int, prefix long, doc long")
    node = rows.groupBy("anchor", "prefix").agg(F.min("doc").alias("first"))
    deep = rows.join(node, ["anchor", "prefix"]).groupBy("anchor", "seg").agg(F.array_sort(F.collect_list(F.struct("j", "first"))).alias("l"))
    deep = deep.select("anchor", "seg", F.transform("l", lambda x: x["first"]).alias("firsts"))
    alone = shared.where("n = 1").select("anchor", "seg", F.array("least").alias("firsts"), F.lit(True).alias("all"))
    verdicts = planted.union(deep).select("*", F.lit(False).alias("all")).union(alone)

    powers_of_two = F.array(*[F.lit(1 << i).cast("long") for i in range(SPAN)])
    bits = F.aggregate(F.zip_with("firsts", F.slice(powers_of_two, 1, F.size("firsts")), lambda x, b: F.when(x < F.col("doc"), b).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    bits = F.when(F.col("all"), F.when(F.col("firsts")[0] < F.col("doc"), F.lit(-1)).otherwise(F.lit(0)).cast("long")).otherwise(bits)
    taken = found.distinct().join(verdicts, ["anchor", "seg"]).select("doc", "anchor", "seg", bits.alias("bits")).where("bits <> 0")
    return taken.groupBy("doc").agg(F.collect_list(F.struct("anchor", "seg", "bits")).alias("taken"))


def _apply(n_in: int, window: int, clean: bool, schema: pa.Schema):
    """(doc, text, others, taken): count what is left, or give back the text without what is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, (anchor, seg, bits) = _flat(batch.column(n_in), ["anchor", "seg", "bits"])
            keys = _pair_keys(row, anchor, seg)
            order = np.argsort(keys)
            keys, bits = keys[order], bits[order]
            counts, removed, digests, texts = [], [], [], []
            for lo, hi, data, offsets in slices(batch.column(1)):
                words = read_words(data, offsets)
                gone = np.zeros(len(words.start) + 1, dtype=np.int64)
                touched = np.isin(np.arange(lo, hi), row)
                if touched.any():
                    found = Segments(words, window)
                    mine = _pair_keys(found.text + lo, found.anchor, found.ident)
                    near = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    got = np.flatnonzero(keys[near] == mine)
                    size = (found.hi - found.lo + 1)[got]
                    each = np.repeat(np.arange(len(got)), size)
                    j = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
                    starts = (found.lo[got][each] + j)[(bits[near[got]][each] >> np.minimum(j, 63)) & 1 == 1]
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                counts.append(words.counts)
                removed.append(words.summed(gone.astype(np.int64)))
                raw = data.tobytes()
                for d in range(hi - lo):
                    text = raw[offsets[d] : offsets[d + 1]]
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    off = gone[a:b] if touched[d] else None
                    if clean:
                        texts.append(_without(text, words.start[a:b] - offsets[d], off) if off is not None and off.any() else text)
                        continue
                    kept = text.split() if off is None else [w for w, g in zip(text.split(), off.tolist()) if not g]
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            arrays = list(batch.columns[:n_in])
            join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64))
            if clean:
                texts = pa.array([t.decode() for t in texts], type=pa.string())
                arrays[1] = texts if arrays[1].null_count == 0 else pc.if_else(arrays[1].is_null(), None, texts)
                arrays += [join(counts), join(removed)]
            else:
                arrays = [arrays[0], join(counts), join(removed), pa.array(digests, type=pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _without(text: bytes, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """The text less the removed words, each with the white space that follows it."""
    edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    out, at, ends = [], 0, np.concatenate((starts, [len(text)]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        out.append(text[at : ends[a]])
        at = int(ends[b])
    return b"".join([*out, text[at:]])


def removal_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """A row (doc_id, n_words, n_removed, kept_sha256) for each document."""
    rows = pick(docs, doc=doc_id, text=text).select(F.col("doc").cast("long"), F.col("text").cast("string"))
    both = rows.join(earlier(rows, window, group).withColumnRenamed("doc", "d"), F.col("doc") == F.col("d"), "left").select("doc", "text", "taken")
    shape = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return both.mapInArrow(_apply(2, window, False, to_arrow_schema(shape)), shape)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """docs with repeated passages cut out of the text, n_words and n_removed."""
    df, names = numbered(docs)
    ident, body = (f"c{column_index(docs, c)}" for c in (doc_id, text))
    rest = [c for c in df.columns if c not in (ident, body)]
    rows = df.select(F.col(ident).cast("long").alias("doc"), F.col(body).cast("string").alias("text"), *rest)
    both = rows.join(earlier(rows.select("doc", "text"), window, group).withColumnRenamed("doc", "d"), F.col("doc") == F.col("d"), "left").drop("d")
    shape = T.StructType([*both.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = both.mapInArrow(_apply(len(names), window, True, to_arrow_schema(shape)), shape)
    return with_results(out.withColumnsRenamed({"doc": ident, "text": body}), names, ["n_words", "n_removed"])


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h HAVING count(DISTINCT doc_id) > 1),
g AS (
  SELECT doc_id, list(DISTINCT p) AS p
  FROM (SELECT v.doc_id, unnest(range(v.i, v.i + 50)) AS p FROM v JOIN f USING (h) WHERE f.first < v.doc_id) GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(p), 0) AS r,
    CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END AS kept
  FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


def query(spark, sf_dir: str) -> DataFrame:
    return removal_counts(table(spark, sf_dir, "documents"))
