"""Quality of whole texts by attention-based multiple-instance learning.

1. A text is a bag of passages, 64 consecutive words each (the last may be shorter; a text without
   words is one empty passage). Each passage gets a vector: shares of kinds of characters, of word
   shapes, of repeated words and lines, and a hashed count of its words' beginnings and ends.
2. An encoder (one tanh layer) is learned together with gated attention: a passage's weight is
   softmax(w . (tanh(V h) * sigmoid(U h))) over the passages of its text. Only the texts have labels.
3. A text's score is the logistic function of the weighted sum of its encoded passages.

Learning takes at most ``fit_rows`` labelled texts outside the held-out fold, chosen by a hash of the
id, and leaves out texts of over ``fit_passages`` passages instead of cutting them; the passages'
vectors of these (at most fit_rows x fit_passages, in practice a few dozen MB) reach the driver,
which learns in numpy. Scoring reads every whole text in one pass, without a shuffle; a long text goes
through in blocks of passages, with the sums of its attention carried on, so its length takes no room.

Defined results for odd input:
- a null or empty text, or one of white space, is one passage of zeros and gets that passage's score;
- a null id is hashed as the empty text; repeated rows get a row each; a text with several labels
  counts as its worst (the smallest);
- with no labels to learn from, or labels of one kind only, the score is the share of label 1 with one
  of each kind added, the same for all texts; an empty table gives no rows;
- extra columns are never looked at: only the id and the text, and of labels the id and the label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.frames import pick, table
from riskframe.llm.words import SPACED, U64, Words, mix, read_words, slices

PASSAGE_WORDS, FOLDS, HELD_OUT, THRESHOLD = 64, 4, 2, 0.7
#: Bounds of learning: labelled texts, and passages of a text.
FIT_ROWS, FIT_PASSAGES = 6_000, 512
HIDDEN, GATES, BUCKETS, ROUNDS, BAGS, RATE, DECAY, SEED = 24, 12, 64, 30, 64, 0.01, 1e-4, 11
#: Bytes of a block of passages.
BLOCK_BYTES = 1 << 20

_KIND = np.zeros(256, dtype=np.int64)  # of bytes: other ASCII
_KIND[0x80:0xC0] = 1  # inside a character
_KIND[0xC0:] = 2
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A] = 3, 4, 5
for _kind, _characters in enumerate((b" \t\v\f\r", b"\n", b".,;:", b"!?", b"#*$%&", b"|<>{}[]\\^~=_", b"'\"()-/", b"@+"), start=6):
    _KIND[list(_characters)] = _kind
_KINDS = int(_KIND.max()) + 1
_SHAPES = 12
FEATURES = _KINDS + _SHAPES + BUCKETS


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def _first(keys: np.ndarray) -> np.ndarray:
    """Whether a key stands for the first time."""
    out = np.zeros(len(keys), dtype=bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def passage_vectors(data: np.ndarray, words: Words, lo: int, hi: int, passage: np.ndarray, n: int) -> np.ndarray:
    """Vectors of n passages that are made of words lo .. hi; ``passage`` has each word's passage, 0 .. n - 1, rising."""
    start, end = words.start[lo:hi], words.end[lo:hi]
    count = np.bincount(passage, minlength=n).astype(np.float64)
    heads = np.searchsorted(passage, np.arange(n))
    kinds = np.zeros(n * _KINDS)
    named = np.flatnonzero(count)  # of bytes from a passage's first word to its last
    opens, closes = start[heads[named]], end[heads[named] + count[named].astype(np.int64) - 1]
    for a in range(int(start[0]), int(end[-1]), BLOCK_BYTES) if hi > lo else ():
        b = min(a + BLOCK_BYTES, int(end[-1]))
        passed = []
        for marks in (opens, closes):
            i, j = np.searchsorted(marks, (a, b))
            step = np.zeros(b - a, dtype=np.int64)
            step[marks[i:j] - a] = 1
            passed.append(np.cumsum(step) + i)
        inside = passed[0] > passed[1]
        kinds += np.bincount(named[passed[0][inside] - 1] * _KINDS + _KIND[data[a:b][inside]], minlength=n * _KINDS)
    kinds = kinds.reshape(n, _KINDS)
    size = np.maximum(kinds.sum(axis=1, keepdims=True), 1.0)
    per_word = np.maximum(count, 1.0)
    add = lambda flag: np.bincount(passage, flag, minlength=n)

    part = Words(data, words.offsets, start, end, np.array([0, len(start)]))
    hashes = part.hashes(lower=True)
    first_byte, last_byte = data[start], data[end - 1]
    length = (end - start).astype(np.float64)
    own = hashes ^ mix(passage.astype(U64) + U64(1))
    beside = np.flatnonzero(passage[1:] == passage[:-1]) + 1  # words that follow one of their passage
    pair = hashes[beside] * U64(3) + hashes[beside - 1] + mix(passage[beside].astype(U64))
    again, new_pair = np.zeros(len(hashes), dtype=bool), np.ones(len(hashes), dtype=bool)
    again[beside] = hashes[beside] == hashes[beside - 1]
    new_pair[beside] = _first(pair)
    line = np.zeros(len(start), dtype=bool)
    if len(beside):
        breaks = np.flatnonzero(data[start[0] : end[-1]] == 0x0A) + start[0]
        line[beside] = np.searchsorted(breaks, start[beside]) > np.searchsorted(breaks, end[beside - 1])
    kind_first, kind_last = _KIND[first_byte], _KIND[last_byte]
    shapes = np.stack([
        add(length) / per_word / 10, np.sqrt(add((length - 5) ** 2) / per_word) / 10, add(length > 20) / per_word, add(length == 1) / per_word,
        add(kind_first == 4) / per_word, add(kind_last >= 8) / per_word, add(_first(own)) / per_word, add(again) / per_word, add(new_pair) / per_word,
        add(line) / per_word, np.log1p(count) / 5, (count > 0).astype(float),
    ], axis=1)
    prefix = mix(data[start].astype(U64) * U64(256) + data[np.minimum(start + 1, end - 1)].astype(U64))
    suffix = mix(data[np.maximum(end - 2, start)].astype(U64) * U64(256) + last_byte.astype(U64) + U64(1 << 20))
    bag = np.zeros((n, BUCKETS))
    for h in (prefix, suffix):
        bag += np.bincount(passage * BUCKETS + (h % U64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.concatenate((kinds / size, shapes, np.sqrt(bag / (2 * per_word[:, None]))), axis=1).astype(np.float32)


def text_passages(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors): blocks of passages in order, and the row of each."""
    for lo, _, data, offsets in slices(texts):
        words = read_words(data, offsets)
        counts = words.counts
        passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
        bounds = np.concatenate(([0], np.cumsum(passages)))
        owner = np.repeat(np.arange(words.texts), passages)
        first = words.first[owner] + PASSAGE_WORDS * (np.arange(bounds[-1]) - bounds[owner])  # each passage's first word
        last = np.minimum(first + PASSAGE_WORDS, words.first[owner + 1])
        stop = np.maximum.accumulate(np.where(last > first, words.end[last - 1], 0)) if len(words.end) else np.zeros(len(owner), dtype=np.int64)
        a = 0
        while a < len(owner):
            begin = words.start[first[a]] if first[a] < len(words.start) else len(data)
            b = min(max(a + 1, int(np.searchsorted(stop, begin + BLOCK_BYTES, side="right"))), a + 4096, len(owner))
            word_of = np.repeat(np.arange(b - a), last[a:b] - first[a:b])
            yield owner[a:b] + lo, passage_vectors(data, words, int(first[a]), int(last[b - 1]), word_of, b - a)
            a = b


class Network:
    """Encoder, gated attention and output, as float64 arrays, with the means and scales of the vectors."""

    NAMES = ("e", "eb", "v", "vb", "u", "ub", "w", "c", "cb")

    def __init__(self, mean: np.ndarray, scale: np.ndarray, arrays: dict[str, np.ndarray]) -> None:
        self.mean, self.scale = mean, scale
        self.__dict__.update(arrays)

    @classmethod
    def new(cls, vectors: np.ndarray, bias: float, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        mean, scale = vectors.mean(axis=0), np.maximum(vectors.std(axis=0), 0.02)
        small = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        return cls(mean, scale, {
            "e": small(vectors.shape[1], HIDDEN) * 0.5, "eb": np.zeros(HIDDEN), "v": small(HIDDEN, GATES), "vb": np.zeros(GATES), "u": small(HIDDEN, GATES), "ub": np.zeros(GATES),
            "w": small(GATES) * 0.1, "c": small(HIDDEN) * 0.1, "cb": np.array([bias]),
        })

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Standard vectors, encoded passages, both sides of the gate, and the attention before its softmax."""
        x = np.clip((vectors - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ self.e + self.eb)
        t, s = np.tanh(h @ self.v + self.vb), 1 / (1 + np.exp(-(h @ self.u + self.ub)))
        return x, h, t, s, (t * s) @ self.w

    def gradients(self, vectors: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of bags vectors[first[i]:first[i + 1]], and its slope in each array."""
        n, owner = len(labels), np.repeat(np.arange(len(labels)), np.diff(first))
        x, h, t, s, a = self.encode(vectors)
        weight = np.exp(a - np.maximum.reduceat(a, first[:-1])[owner])
        weight /= np.add.reduceat(weight, first[:-1])[owner]
        bag = np.add.reduceat(weight[:, None] * h, first[:-1], axis=0)
        p = 1 / (1 + np.exp(-(bag @ self.c + self.cb[0])))
        loss = float(-np.mean(labels * np.log(p + 1e-12) + (1 - labels) * np.log(1 - p + 1e-12)))
        d = (p - labels) / n
        into = d[:, None] * self.c
        dweight = (into[owner] * h).sum(axis=1)
        da = weight * (dweight - np.add.reduceat(weight * dweight, first[:-1])[owner])
        dt, ds = da[:, None] * s * self.w * (1 - t * t), da[:, None] * t * self.w * s * (1 - s)
        dh = (weight[:, None] * into[owner] + dt @ self.v.T + ds @ self.u.T) * (1 - h * h)
        return loss, {
            "e": x.T @ dh, "eb": dh.sum(axis=0), "v": h.T @ dt, "vb": dt.sum(axis=0), "u": h.T @ ds, "ub": ds.sum(axis=0),
            "w": (da[:, None] * t * s).sum(axis=0), "c": bag.T @ d, "cb": np.array([d.sum()]),
        }


def learn_network(vectors: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Network | float:
    """Adam over shuffled bags; with labels of one kind only, the share of label 1 instead."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        return float(share)
    net, rng = Network.new(vectors, float(np.log(share / (1 - share)))), np.random.default_rng(SEED)
    mean = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    square, step = {k: np.zeros_like(v) for k, v in mean.items()}, 0
    sizes = np.diff(first)
    for turn in range(rounds):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * turn / rounds))
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BAGS):
            bags = order[lo : lo + BAGS]
            rows = np.concatenate([np.arange(first[b], first[b + 1]) for b in bags])
            _, slopes = net.gradients(vectors[rows], np.concatenate(([0], np.cumsum(sizes[bags]))), labels[bags])
            step += 1
            for k, g in slopes.items():
                value = getattr(net, k)
                g = g + DECAY * value * (value.ndim > 1)
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                value -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, turn, text) to (label, turn, n, vectors): all passages of a text as one row."""
    for batch in batches:
        held: dict[int, list[np.ndarray]] = {}
        for rows, vectors in text_passages(batch.column(2)):
            for r in np.unique(rows):
                held.setdefault(int(r), []).append(vectors[rows == r])
        whole = [np.concatenate(held[r]) for r in range(len(batch))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(v) for v in whole], type=pa.int64()), pa.array([v.tobytes() if len(v) <= FIT_PASSAGES else b"" for v in whole], type=pa.binary())], names=["label", "turn", "n", "vectors"])


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> Network | float:
    """A network learned from at most ``fit_rows`` labelled texts outside the held-out fold."""
    marked = pick(labels, doc_id="doc_id", label=label).select(F.col("doc_id").cast("string"), F.col("label").cast("int")).dropna()
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    mine = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("string"), F.col("text").cast("string")).join(F.broadcast(marked), "doc_id")  # fit_rows rows at most
    rows = mine.select("label", F.xxhash64("doc_id", "text").alias("turn"), "text").mapInArrow(_vectors, "label int, turn long, n long, vectors binary")
    seen = rows.where(F.col("n") <= FIT_PASSAGES).orderBy("turn", "label").limit(fit_rows).collect()  # repeated rows don't make it more
    if not seen:
        return 0.5
    vectors = np.concatenate([np.frombuffer(r["vectors"], dtype=np.float32).reshape(-1, FEATURES) for r in seen])
    first = np.concatenate(([0], np.cumsum([r["n"] for r in seen])))
    return learn_network(vectors, first, np.array([float(r["label"] == 1) for r in seen]))


def bag_scores(net: Network | float, texts: pa.Array) -> np.ndarray:
    """The score of each whole text. The sums of a text's attention are carried from block to block."""
    n = len(texts)
    if isinstance(net, float):
        return np.full(n, net)
    top, weights, sums = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
    for rows, vectors in text_passages(texts):
        _, h, _, _, a = net.encode(vectors)
        heads = np.flatnonzero(np.diff(rows, prepend=-1))
        mine = rows[heads]
        high = np.maximum(top[mine], np.maximum.reduceat(a, heads))
        old = np.exp(top[mine] - high)
        weight = np.exp(a - np.repeat(high, np.diff(np.append(heads, len(rows)))))
        weights[mine] = weights[mine] * old + np.add.reduceat(weight, heads)
        sums[mine] = sums[mine] * old[:, None] + np.add.reduceat(weight[:, None] * h, heads, axis=0)
        top[mine] = high
    return 1 / (1 + np.exp(-(sums / weights[:, None] @ net.c + net.cb[0])))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bag_scores(shared.value, batch.column(1)), type=pa.float64())], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, net: Network | float, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(net)), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
