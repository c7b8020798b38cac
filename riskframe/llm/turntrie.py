"""The prefix trie of rebuilt conversations, built as ternary search trees over range shards.

1. A turn becomes a token of 24 bytes: 16 of the SHA-256 of its role and text, and its number of
   words. Texts go no further. A conversation is the run of its tokens, 24 bytes a turn.
2. The rebuilt conversations are sorted in ranges by (tokens, id), so that those that share a prefix
   are neighbours, a prefix comes before what goes on from it, and a range may end anywhere, also
   within thousands of equal conversations.
3. Each range is a shard. It encodes its tokens as numbers and inserts its different sequences into
   one ternary search tree, the middle one first, so that the trees of siblings are balanced. A walk
   over the nodes from the last to the first adds up members, leaves and savings.
4. Neighbouring shards share the nodes that the last sequence of one and the first of the next have in
   common. Only these boundary nodes are merged, by Spark: a shard counts a boundary node's words and
   its being a child only if no shard before it has the node, and its being a leaf only if no shard
   after it has it. So all of a node's figures are sums over shards, and what is shared is counted once.

One task holds a shard's tokens and its tree, and one row a conversation's tokens. The conversations
that end in a boundary node come to one task as one text for each shard, in order, and are hashed as
they come, because SHA-256 takes its input in order.

Defined results for odd input:
- turns are ordered by turn (null first), equal ones by the token's digest; a null role or text is empty;
- rows without an id belong to no conversation; a conversation's remainder by 20 has the sign of its id;
- a conversation without a turn of its own or of the other's is a member of the root;
- repeated rows are repeated turns; an empty table gives no rows; extra columns are never looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.frames import cut, pick, shared_folder, table, through_table

FAMILY, MOST_SHARED, TOKEN_BYTES = 20, 4, 24
#: Boundary nodes up to which they are broadcast to their children; beyond it the children are joined over so many salts.
BROADCAST_NODES, SALTS = 200_000, 32
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"
_NODE = T.StructType([
    T.StructField("node", T.BinaryType()), T.StructField("parent", T.BinaryType()), T.StructField("shard", T.IntegerType()), T.StructField("depth", T.LongType()),
    T.StructField("conv_id", T.LongType()), T.StructField("parent_conv_id", T.LongType()), T.StructField("n_convs", T.LongType()), T.StructField("n_children", T.LongType()),
    T.StructField("n_leaves", T.LongType()), T.StructField("saved_tokens", T.LongType()), T.StructField("ends", T.StringType()),
])


def sequences(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, tokens): each conversation's own turns in order."""
    rows = pick(conversations, conv_id=conv_id, turn=turn, role=role, text=text).where(F.col("conv_id").isNotNull())
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256), 1, 32)
    token = F.unhex(F.concat(digest, F.lpad(F.hex(F.regexp_count(text_, F.lit(_WORD)).cast("long")), 16, "0")))
    turns = rows.select(F.col("conv_id").cast("long"), F.struct("turn", token.alias("token")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t"))["token"].alias("tokens"))


def rebuilt(convs: DataFrame, family: int = FAMILY, most_shared: int = MOST_SHARED) -> DataFrame:
    """(conv_id, path): the first h turns of the family's first conversation, then what follows a conversation's own first h."""
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first"), F.slice("tokens", 1, most_shared - 1).alias("lent"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most_shared)).cast("int")
    both = convs.withColumn("first", F.col("conv_id") - F.col("conv_id") % family).join(heads, "first", "left")
    taken = F.slice(F.coalesce(F.col("lent"), F.array().cast("array<binary>")), F.lit(1), h)
    own = F.slice("tokens", h + 1, F.greatest(F.size("tokens"), F.lit(1)))
    path = F.unhex(F.array_join(F.transform(F.concat(taken, own), F.hex), ""))
    return both.select("conv_id", path.alias("path"))


class Tree:
    """A ternary search tree: a node is a turn, its low and high sides are siblings, its middle is what follows.

    Node 0 is the root, which has no turn. A node is made after the one that it follows."""

    def __init__(self) -> None:
        self.code, self.low, self.high, self.middle = [-1], [0], [0], [0]
        self.before, self.depth = [-1], [0]

    def _new(self, code: int, before: int) -> int:
        for column, value in ((self.code, code), (self.low, 0), (self.high, 0), (self.middle, 0), (self.before, before), (self.depth, self.depth[before] + 1)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int]) -> int:
        """The node at which the sequence ends."""
        at, code_of, low, high, middle = 0, self.code, self.low, self.high, self.middle
        for code in codes:
            here = middle[at]
            if not here:
                here = middle[at] = self._new(code, at)
            while code != code_of[here]:
                side = low if code < code_of[here] else high
                if not side[here]:
                    side[here] = self._new(code, at)
                here = side[here]
            at = here
        return at

    def path(self, codes: list[int], most: int) -> list[int]:
        """The nodes of a sequence that is in the tree, the root first, down to depth ``most``."""
        out = [0]
        for code in codes[:most]:
            here = self.middle[out[-1]]
            while code != self.code[here]:
                here = self.low[here] if code < self.code[here] else self.high[here]
            out.append(here)
        return out


def middle_first(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle before both halves."""
    open_ = [(0, n)]
    while open_:
        a, b = open_.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            open_ += [(m + 1, b), (a, m)]


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TOKEN_BYTES
    return int(np.argmax(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8))) // TOKEN_BYTES


def shard_nodes(ids: np.ndarray, lengths: np.ndarray, tokens: bytes, shard: int, before: int, after: int) -> list[list]:
    """Columns of _NODE for a shard: conversations in order, and the depths down to which the shards before and after share its first and last path (-1: there is none)."""
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(TOKEN_BYTES), len(tokens) // TOKEN_BYTES, [None, pa.py_buffer(tokens)]).dictionary_encode()
    names = np.frombuffer(flat.dictionary.buffers()[1], dtype=f"S{TOKEN_BYTES}", count=len(flat.dictionary)) if len(flat) else np.zeros(0, dtype=f"S{TOKEN_BYTES}")
    rank = np.empty(len(names), dtype=np.int64)
    rank[np.argsort(names)] = np.arange(len(names))
    codes = rank[flat.indices.to_numpy()] if len(flat) else np.zeros(0, dtype=np.int64)
    words_of = np.zeros(len(names), dtype=np.int64)
    if len(names):
        words_of[rank] = np.frombuffer(flat.dictionary.buffers()[1], dtype=">i8", count=3 * len(names))[2::3]
    first = np.concatenate(([0], np.cumsum(lengths)))

    same = np.zeros(len(ids), dtype=bool)  # equal to the one before
    for i in np.flatnonzero(lengths[1:] == lengths[:-1]) + 1:
        same[i] = np.array_equal(codes[first[i] : first[i + 1]], codes[first[i - 1] : first[i]])
    heads = np.flatnonzero(~same)
    bounds = np.concatenate((heads, [len(ids)]))
    tree, ends = Tree(), {}
    sequence = lambda i: codes[first[i] : first[i + 1]].tolist()
    for k in middle_first(len(heads)):
        ends[tree.insert(sequence(heads[k]))] = k

    n = len(tree.code)
    code, up, depth = np.array(tree.code), np.array(tree.before), np.array(tree.depth)
    words = np.where(code >= 0, words_of[code], 0) if len(words_of) else np.zeros(n, dtype=np.int64)
    here, smallest = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
    for node, k in ends.items():
        here[node], smallest[node] = bounds[k + 1] - bounds[k], ids[bounds[k]]
    old, again = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)  # nodes of shards before, and of shards after
    if before >= 0:
        old[tree.path(sequence(0), before)] = True
    if after >= 0:
        again[tree.path(sequence(len(ids) - 1), after)] = True
    followed = np.zeros(n, dtype=bool)
    followed[up[1:]] = True
    children, members, saved = np.zeros(n, dtype=np.int64), here.copy(), np.zeros(n, dtype=np.int64)
    leaves = (~followed & ~again).astype(np.int64)
    own = np.where(old, 0, words)
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
    for level in reversed(levels):  # the deepest first: what follows a node is done before it
        saved[level] += members[level] * words[level] - own[level]
        if depth[level[0]]:
            into = up[level]
            np.add.at(members, into, members[level])
            np.add.at(leaves, into, leaves[level])
            np.add.at(saved, into, saved[level])
            np.add.at(children, into, (~old[level]).astype(np.int64))
            np.minimum.at(smallest, into, smallest[level])

    shared = old | again
    keys: list[bytes | None] = [None] * n
    by_rank = names[np.argsort(names)]
    for node in np.flatnonzero(shared):  # in the order of making, so that what it follows has its key
        turn = by_rank[code[node]].ljust(TOKEN_BYTES, b"\0") if node else b""
        keys[node] = hashlib.sha256((keys[up[node]] if node else b"") + turn).digest()[:16]
    listed = []
    for node in range(n):
        mine = ids[bounds[ends[node]] : bounds[ends[node] + 1]] if node in ends else ids[:0]
        text = ",".join(map(str, mine.tolist()))
        listed.append((text or None) if shared[node] else hashlib.sha256(text.encode()).hexdigest() if text else _NO_ENDS)
    above = np.where(up < 0, 0, up)
    known = (up >= 0) & ~shared[above]
    return [
        keys, [keys[p] if i and shared[p] else None for i, p in enumerate(up)], [shard] * n, depth, smallest,
        pa.array(smallest[above], mask=~known), members, children, leaves, saved, listed,
    ]


def _shard(edges) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, tokens, shard = [], [], [], None
        for batch in batches:
            if len(batch):
                shard = batch.column(2)[0].as_py()
                paths = batch.column(1).cast(pa.large_binary())
                at = np.frombuffer(paths.buffers()[1], dtype=np.int64)[paths.offset : paths.offset + len(paths) + 1]
                ids.append(batch.column(0).to_numpy())
                lengths.append(np.diff(at) // TOKEN_BYTES)
                tokens.append(paths.buffers()[2].to_pybytes()[at[0] : at[-1]] if at[-1] > at[0] else b"")
        if shard is None:
            return
        columns = shard_nodes(np.concatenate(ids), np.concatenate(lengths), b"".join(tokens), shard, *edges.value[shard])
        types = [pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 7, pa.string()]
        whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, types)], names=_NODE.names)
        for lo in range(0, len(whole), 10_000):
            yield whole.slice(lo, 10_000)

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = last = None
    for batch in batches:
        if len(batch):
            first = first or batch.slice(0, 1)
            last = batch.slice(len(batch) - 1, 1)
    if first:
        yield pa.RecordBatch.from_arrays([first.column(2), first.column(1), last.column(1)], names=["shard", "first", "last"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a node's ids, by node and shard, to the digest of all of them, joined by commas."""
    node, state = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([node], type=pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(2)):
            if key != node:
                if state:
                    yield done()
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.as_buffer())
    if state:
        yield done()


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = FAMILY, most_shared: int = MOST_SHARED) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    folder = f"{shared_folder(spark)}/turntrie-{uuid.uuid4().hex}"
    convs = through_table(sequences(conversations, conv_id, turn, role, text), f"{folder}/sequences")
    paths = rebuilt(convs, family, most_shared).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    shards = cut(paths.withColumn("shard", F.spark_partition_id()))
    ends = sorted(shards.mapInArrow(_edges, "shard int, first binary, last binary").collect())  # two rows for each shard
    touch = [common_turns(a["last"], b["first"]) for a, b in zip(ends, ends[1:])]
    edges = {r["shard"]: (before, after) for r, before, after in zip(ends, [-1, *touch], [*touch, -1])}
    nodes = through_table(shards.mapInArrow(_shard(spark.sparkContext.broadcast(edges)), _NODE), f"{folder}/nodes")

    shared = nodes.where(F.col("node").isNotNull())
    figures = [F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]]
    merged = shared.groupBy("node", "depth").agg(F.max("parent").alias("parent"), *figures)
    texts = shared.where(F.col("ends").isNotNull()).select("node", "shard", "ends")
    hashed = texts.repartition(F.col("node")).sortWithinPartitions("node", "shard").mapInArrow(_ends, "node binary, ends_sha256 string")
    merged = through_table(merged.join(hashed, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS))), f"{folder}/merged")

    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    own = nodes.where(F.col("node").isNull()).withColumnRenamed("ends", "ends_sha256")
    inner = own.where(F.col("parent").isNull()).select(*out)
    below = own.where(F.col("parent").isNotNull()).select("parent", *[c for c in out if c != "parent_conv_id"])
    below = below.unionByName(merged.where(F.col("parent").isNotNull()).select(*below.columns))
    top = merged.where(F.col("parent").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long")).select(*out)
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    if merged.count() <= BROADCAST_NODES:
        below = below.join(F.broadcast(parents), "parent")
    else:  # a node may have very many children
        parents = parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        below = below.withColumn("salt", F.pmod(F.hash("conv_id", "depth"), F.lit(SALTS))).join(parents, ["parent", "salt"])
    return inner.unionByName(below.select(*out)).unionByName(top)


def query(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


ORACLE = rf"""
WITH bits AS (SELECT list(crc ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(0 AS BIGINT) FOR i IN range(8)]),
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS crc FROM range(256) AS r(b))),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(strlen(r) || ':' || r || x), 1, 32)) AS k, r, x
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(z) AS BIGINT) FOR z IN string_split(CAST(conv_id AS VARCHAR), '')]),
  lambda c, z: xor(c // 256, bits.t[CAST(xor(c, z) % 256 AS INTEGER) + 1]))) % {MOST_SHARED} AS h FROM (SELECT DISTINCT conv_id FROM turns) CROSS JOIN bits),
built AS (SELECT c.conv_id, k, r, x FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % {FAMILY} AND k <= h
  UNION ALL SELECT c.conv_id, k, r, x FROM convs c JOIN turns t USING (conv_id) WHERE k > h),
steps AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, sha256(strlen(r) || ':' || r || x) AS token, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM built),
paths AS (SELECT conv_id, d, words, string_agg(token, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM steps
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lasts AS (SELECT conv_id, max(d) AS last FROM paths GROUP BY conv_id),
nodes AS MATERIALIZED (SELECT path, d, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = last), '')) AS ends FROM paths JOIN lasts USING (conv_id) GROUP BY path, d),
kids AS (SELECT substr(path, 1, 64 * (d - 1)) AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
subtree AS (SELECT a.path, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n - 1) * b.words) AS saved
  FROM (SELECT path AS whole, n_children, n, words, unnest(range(d + 1)) AS above FROM full_nodes) b JOIN full_nodes a ON a.path = substr(b.whole, 1, 64 * above) GROUP BY a.path)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN subtree USING (path) LEFT JOIN full_nodes p ON f.d > 0 AND p.path = substr(f.path, 1, 64 * (f.d - 1))
"""
