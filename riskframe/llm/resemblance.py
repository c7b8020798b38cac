"""Links between texts that resemble each other more loosely than a fingerprint of 64 bits can tell.

Two texts with a Jaccard similarity of 0.8 on five-word shingles differ in four to thirteen bits of
their SimHash fingerprints, and no index of 64 bits finds such pairs without going through most of
all pairs. So texts are filed under a prefix of their shingle sets, and each step below leaves out
only pairs that cannot be alike:

1. Shingles have one order for all texts: rare ones first, then by hash. What counts as frequent is
   learned from a bounded sample; any order would give the same links, this one keeps lists short.
   A text is filed under its first n - ceil(0.8 n) + 1 shingles of n; two alike texts share one.
2. Pairs of a list are candidates if their sizes, and the places of the shared shingle in their
   prefixes, allow the similarity. In a first round each text meets the list's most typical text and
   its neighbours by length, in a second all that are then in other components, in blocks.
3. Each text has a sketch: two to four bits a shingle, each the parity of the shingles that fall on
   it. Where two sketches differ, the sets differ in at least one shingle, so candidates with too
   many different bits are left out; from 0.74 downwards that is nearly all of them.
4. What is left is verified on the whole sets. In the first round only the closest candidate of each
   text is, since one link joins it; so the sets that move grow with the texts and not with the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.lm import frequent
from riskframe.llm.words import U64, read_words, slices, window_hashes

SHINGLE, SIMILARITY, NEIGHBOURS = 5, 0.8, 4
#: Texts whose shingles are counted for the order, how often a frequent one occurs there, and how many there are at most.
ORDER_TEXTS, FREQUENT, ORDER_SHINGLES = 8_000, 3, 500_000
#: Texts on either side of a block of the second round, and texts whose sets a task holds at once.
BLOCK, ROWS_AT_ONCE = 2048, 256
#: So many ids are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_SLACK = 1e-9


def shingle_set(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of one text, 64 bits each, rising; a text of fewer words is one shingle."""
    if not len(hashes):
        return hashes
    return np.unique(window_hashes(hashes, min(size, len(hashes))))


def prefix(own: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the common order, so many that an alike set must share one."""
    n = len(own) - math.ceil(similarity * len(own) - _SLACK) + 1
    if not len(often):
        return own[:n]
    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
    common = often[at] == own
    rare = own[~common]
    return rare[:n] if len(rare) >= n else np.concatenate((rare, own[common][: n - len(rare)]))


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of a set over a power of two of bits, as bytes."""
    bits = max(64, 1 << int(2 * max(len(own), 1) - 1).bit_length())
    odd = np.bincount((own & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def at_least_different(p: np.ndarray, q: np.ndarray) -> int:
    """In so many shingles two sets differ at least. The wider sketch is folded to the other's width."""
    if len(p) < len(q):
        p, q = q, p
    return int(np.bitwise_count(np.bitwise_xor.reduce(p.reshape(-1, len(q)), axis=0) ^ q).sum())


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its lower-cased words)."""
    for lo, hi, data, offsets in slices(batch.column(1)):
        words = read_words(data, offsets)
        hashes = words.hashes(lower=True)
        for d in range(hi - lo):
            yield lo + d, hashes[words.first[d] : words.first[d + 1]]


def _of_sets(batches: Iterator[pa.RecordBatch], wanted, size: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[np.ndarray]]]:
    """Parts of batches (id, text) of wanted ids, with rows that have words and their sets."""
    for whole in batches:
        if wanted is not None:
            whole = whole.filter(pa.array(np.isin(whole.column(0).to_numpy(zero_copy_only=False), wanted.value)))
        for lo in range(0, len(whole), ROWS_AT_ONCE):
            batch = whole.slice(lo, ROWS_AT_ONCE)
            made = [(row, shingle_set(hashes, size)) for row, hashes in _each(batch) if len(hashes)]
            if made:
                yield batch, [r for r, _ in made], [s for _, s in made]


def _count(wanted, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sets in _of_sets(batches, wanted, size):
            words, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    return run


def _file(wanted, often, similarity: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, sets in _of_sets(batches, wanted, size):
            filed = [prefix(own, often.value, similarity) for own in sets]
            n = [len(f) for f in filed]
            at = pa.array(np.repeat(rows, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.repeat([len(s) for s in sets], n).astype(np.int32)), pa.array(np.concatenate([np.arange(k) for k in n]).astype(np.int32)), pa.array(np.concatenate(filed).view(np.int64))],
                names=["id", "size", "place", "gram"])

    return run


def _sketches(wanted, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, sets in _of_sets(batches, wanted, size):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([len(s) for s in sets], type=pa.int32()), pa.array([sketch(s).tobytes() for s in sets], type=pa.binary())], names=["id", "size", "sketch"])

    return run


def _sets(wanted, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, sets in _of_sets(batches, wanted, size):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["id", "shingles"])

    return run


class _Texts:
    """The documents (id, text), of which any ids can be picked."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs.where("id is not null")

    def map(self, ids: DataFrame, make, shape: str) -> DataFrame:
        """``make(wanted)`` over the texts of the ids. Ids up to a bound are broadcast, more are joined to what is made."""
        ids = ids.select("id")
        if ids.count() <= BROADCAST_IDS:
            wanted = np.sort(ids.toPandas()["id"].to_numpy(dtype=np.int64))  # BROADCAST_IDS at most
            return self.docs.mapInArrow(make(self.docs.sparkSession.sparkContext.broadcast(wanted)), shape)
        if shape.startswith("id "):
            return self.docs.mapInArrow(make(None), shape).join(ids, "id", "left_semi")
        return self.docs.join(ids, "id", "left_semi").mapInArrow(make(None), shape)


def in_lists(filed: DataFrame) -> DataFrame:
    """The rows (id, size, place, gram) whose gram others have too."""
    lists = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return filed.join(lists.select("gram"), "gram")


def _alike(a, b, similarity: float):
    """Whether sets of so many shingles can be of that similarity."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - _SLACK


def _first_shared(size_a, place_a, size_b, place_b, similarity: float):
    """Whether sets that share their first shingle at these places can be of that similarity. Alike sets pass at the first one that they share."""
    left = 1 + F.least(size_a - place_a - 1, size_b - place_b - 1)
    return left >= (size_a + size_b) * (similarity / (1 + similarity)) - _SLACK


def candidates(shared: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """First round: (a, b) with a < b from rows (id, size, place, gram) of different texts."""
    typical = shared.groupBy("id").agg((F.count(F.lit(1)) / F.first("size")).alias("typical"))
    shared = shared.join(typical, "id")
    mine = F.struct("id", "size", "place")
    lead = shared.groupBy("gram").agg(F.max(F.struct("typical", (-F.col("id")).alias("i"), "size", "place")).alias("l"))
    lead = lead.select("gram", F.struct((-F.col("l.i")).alias("id"), F.col("l.size").alias("size"), F.col("l.place").alias("place")).alias("o"))
    to_lead = shared.join(lead, "gram").select(mine.alias("x"), "o")
    beside = Window.partitionBy("gram", "part").orderBy("size", "id")  # lengths of one part are alike; long lists are dealt out by length
    part = F.floor(F.log(F.col("size").cast("double")) * 4).cast("int")
    near = shared.withColumn("part", F.explode(F.array(part, part - 1)))
    others = F.array(*[F.lag(mine, k).over(beside) for k in range(1, NEIGHBOURS + 1)])
    near = near.withColumn("others", others).select(mine.alias("x"), F.explode(F.array_compact("others")).alias("o"))
    both = to_lead.union(near).where("x.id <> o.id").where(_alike(F.col("x.size"), F.col("o.size"), similarity))
    both = both.where(_first_shared(F.col("x.size"), F.col("x.place"), F.col("o.size"), F.col("o.place"), similarity))
    return both.select(F.least("x.id", "o.id").alias("a"), F.greatest("x.id", "o.id").alias("b")).distinct()


def remaining(shared: DataFrame, known: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Second round: all pairs (a, b) with a < b of a list whose texts can be alike and are in different components.

    ``known`` has a row (id, comp) for each text. A list is dealt out by bands of size, of which two alike
    texts have the same or neighbouring ones, and each band in blocks."""
    band = F.floor(F.log(F.col("size").cast("double")) / (math.log(1 / similarity) + 0.01)).cast("int")
    rows = shared.select("id", "size", "place", "gram").join(known, "id").withColumn("band", band)
    either = rows.withColumn("part", F.explode(F.array("band", F.col("band") - 1)))
    load = either.groupBy("gram", "part").agg(F.count_if(F.col("band") == F.col("part")).alias("n"), F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    load = load.where("n > 0 AND lo < hi").select("gram", "part", F.ceil(F.col("n") / BLOCK).cast("int").alias("x_blocks"), F.ceil(F.col("m") / BLOCK).cast("int").alias("y_blocks"))
    slot = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    key = ["gram", "part", "x_block", "y_block"]
    fields = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("id", "size", "place", "comp", "band")]
    x = rows.withColumn("part", F.col("band")).join(load, ["gram", "part"]).withColumn("x_block", slot("x_blocks"))
    x = x.select("gram", "part", "x_block", every("y_blocks").alias("y_block"), *fields("x"))
    y = either.join(load, ["gram", "part"]).withColumn("y_block", slot("y_blocks"))
    y = y.select("gram", "part", every("x_blocks").alias("x_block"), "y_block", *fields("y"))
    once = (F.col("band_x") != F.col("band_y")) | (F.col("id_x") < F.col("id_y"))
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in key]
    first = _first_shared(F.col("size_x"), F.col("place_x"), F.col("size_y"), F.col("place_y"), similarity)
    pairs = x.alias("l").join(y.alias("r"), [*on, F.col("comp_x") != F.col("comp_y"), once, _alike(F.col("size_x"), F.col("size_y"), similarity), first])
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _prune(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(s.as_buffer(), dtype=np.uint8) for s in batch.column(i)] for i in (3, 5)]
            least = np.array([at_least_different(p, q) for p, q in zip(*sides)], dtype=np.int64)
            most = (batch.column(2).to_numpy() + batch.column(4).to_numpy()) * ((1 - similarity) / (1 + similarity)) + _SLACK
            good = pa.array(least <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(least).filter(good)], names=["a", "b", "least"])

    return run


def pruned(pairs: DataFrame, sketches: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) whose sketches allow the similarity, with the number of their different bits, ``least``."""
    side = lambda c: sketches.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    whole = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b")
    return whole.mapInArrow(_prune(similarity), "a long, b long, least long")


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= similarity * (len(p) + len(q) - both) - _SLACK)
            yield batch.select([0, 1]).filter(pa.array(good, type=pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: _Texts, through, similarity: float, shingle: int, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are of the similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = through(texts.map(wanted, lambda ids: _sets(ids, shingle), "id long, shingles binary").dropDuplicates(["id"]), f"shingles-{name}")
    first = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("p")), "a")
    whole = first.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("q")), "b").select("a", "b", "p", "q")
    return through(whole.mapInArrow(_verify(similarity), "a long, b long"), f"links-{name}")


def similar(docs: DataFrame, ids: DataFrame, through, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Verified links (a, b) between documents (id long, text) whose id is in ``ids`` (id distinct, to: a text it
    is joined with already): with those of ``ids``, enough to connect all that are alike. A repeated id counts with its first text that is met.

    ``through(df, name)`` writes a table of the shared folder and reads it back."""
    from riskframe.llm.simhash import components

    texts, context = _Texts(docs), docs.sparkSession.sparkContext
    sample = ids.select("id").orderBy(F.xxhash64("id"), "id").limit(ORDER_TEXTS)
    counts = texts.map(sample, lambda wanted: _count(wanted, shingle), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    often = frequent(through(counts, "order"), ORDER_SHINGLES).select("word").toPandas()["word"].to_numpy(dtype=np.int64)  # ORDER_SHINGLES at most
    order = context.broadcast(np.sort(often.view(np.uint64)))
    filed = texts.map(ids, lambda wanted: _file(wanted, order, similarity, shingle), "id long, size int, place int, gram long")
    shared = through(in_lists(filed), "lists")
    some = through(shared.select("id").distinct(), "listed")
    sketches = through(texts.map(some, lambda wanted: _sketches(wanted, shingle), "id long, size int, sketch binary").dropDuplicates(["id"]), "sketches")

    pairs = through(pruned(candidates(shared, similarity), sketches, similarity), "candidates")
    closest = pairs.groupBy("b").agg(F.min(F.struct("least", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = verified(closest, texts, through, similarity, shingle, "first")

    joined = components(links.unionAll(ids.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))))
    known = ids.join(joined, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("comp"))
    rest = remaining(shared, known, similarity).join(closest, ["a", "b"], "left_anti")
    rest = through(pruned(rest, sketches, similarity), "remaining")
    return links.unionAll(verified(rest, texts, through, similarity, shingle, "second"))
