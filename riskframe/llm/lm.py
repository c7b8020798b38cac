"""Language-model scoring: a gated recurrent network, trained on the corpus and applied to every text.

1. Words are counted over all training documents (one shuffle by word).
2. The network knows the most frequent words by name and all others as one; the others share its
   probability by their counts. It is trained on all training documents in rounds: in each round
   every task goes on from the common weights over its part of the documents, and the weights that
   come back are averaged, weighted by tokens, in two steps, so that no task and no driver holds
   more than a few models whatever the number of tasks.
3. Every document is scored whole, with the state carried from window to window. Counts of frequent
   words are broadcast (a bounded table); a document's other words are joined to theirs by a shuffle.

A word is known by 64 bits of hash. The weights depend on how the input is split into tasks, so the
same input with the same splits gives the same scores.

Defined results for odd input:
- a null or empty text is one token, its end;
- a null id counts as the empty text, so it is a training document;
- repeated documents are learned from as often as they occur and get a row each;
- an empty table gives no rows; extra columns never clash, as only the id and the text are looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm import gru
from riskframe.llm.frames import pick, shared_folder, table, through_table
from riskframe.llm.words import U64, mix, read_words, slices

#: Words that the network knows by name; words whose counts are broadcast.
VOCABULARY, BROADCAST_WORDS = 2046, 1 << 18
#: Shares (of 16) of the training documents that the rounds of training take; together all of them, each once.
ROUNDS = (1, 3, 12)
FOLDS, HELD_OUT = 7, 2
#: Hash of the end of a text, a token of its own; and tasks that average the models of all others.
END, AVERAGERS = int(mix(np.array([0x454E44], dtype=U64)).view(np.int64)[0]), 16
_TRAIN_TOKENS = 1 << 18


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def _hashes(batch_texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the tokens with an end after each text, where each text begins)."""
    for lo, _, data, offsets in slices(batch_texts):
        words = read_words(data, offsets)
        first = words.first + np.arange(words.texts + 1)
        tokens = np.full(int(first[-1]), END, dtype=np.int64)
        tokens[np.arange(len(words.start)) + words.text_of_word()] = words.hashes(lower=True).view(np.int64)
        yield lo, tokens, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [tokens for _, tokens, _ in _hashes(batch.column(0))]
        if found:
            words, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], names=["word", "n"])


class Lexicon:
    """Counts of the most frequent words, and the numbers of those that the network knows: 0 is the end, 1 any other word."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, vocabulary: int = VOCABULARY) -> None:
        """words and counts are in the order of falling counts."""
        self.total, self.distinct = total, distinct
        ends = int(counts[words == END].sum())
        named = np.flatnonzero(words != END)[:vocabulary]
        number = np.ones(len(words), dtype=np.int64)
        number[named] = np.arange(len(named)) + 2
        number[words == END] = 0
        order = np.argsort(words)
        self.words, self.counts, self.number = words[order], counts[order], number[order]
        self.gains, self.slots, self.shift = np.log10(self.counts + 1.0), None, 0
        small = np.flatnonzero(self.number != 1)  # what the network knows by name: a table that stays in the cache
        self.known, self.known_number = self.words[small], self.number[small]
        self.other = int(total - ends - counts[named].sum())
        self.other_words = int(distinct - len(named) - (ends > 0))
        self.sizes = np.concatenate(([ends, self.other], counts[named])).astype(float)

    def _slots(self) -> tuple[np.ndarray, int]:
        """Places of the words by the upper bits of their hashes (the next free slot, if one is taken), and bits to shift by."""
        if self.slots is None:
            size = 1 << max(4, int(4 * len(self.words)).bit_length())
            shift = 64 - (size.bit_length() - 1)
            slots, left = np.full(size, -1, dtype=np.int32), np.arange(len(self.words), dtype=np.int32)
            at = (self.words.view(U64) >> U64(shift)).astype(np.int64)
            while len(left):
                free = slots[at] < 0
                slots[at[free]] = left[free]  # of several for one slot the last stays
                lost = slots[at] != left
                left, at = left[lost], (at[lost] + 1) & (size - 1)
            self.slots, self.shift = slots, shift
        return self.slots, self.shift

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each token in the table, and whether it is there."""
        place, there = np.zeros(len(tokens), dtype=np.int64), np.zeros(len(tokens), dtype=bool)
        if not len(self.words):
            return place, there
        slots, shift = self._slots()
        left, at = np.arange(len(tokens)), (tokens.view(U64) >> U64(shift)).astype(np.int64)
        while len(left):
            found = slots[at]
            same = (found >= 0) & (self.words[found] == tokens[left])
            place[left[same]], there[left[same]] = found[same], True
            on = (found >= 0) & ~same
            left, at = left[on], (at[on] + 1) & (len(slots) - 1)
        return place, there

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.where(tokens == END, 0, 1)
        at = np.minimum(np.searchsorted(self.known, tokens), len(self.known) - 1)
        return np.where(tokens == END, 0, np.where(self.known[at] == tokens, self.known_number[at], 1))


def _train(lexicon, weights, start: gru.Model, rate: float):
    """Texts to one row (tokens, weights): the common weights, moved on over this task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trainer, seen = lexicon.value, gru.Trainer(start.from_flat(np.frombuffer(weights.value, dtype="<f4")), rate), 0
        held: list[np.ndarray] = []
        marks: list[np.ndarray] = []

        def go() -> None:
            trainer.run(np.concatenate(held), np.concatenate(marks))
            held.clear(), marks.clear()

        for batch in batches:
            for _, tokens, first in _hashes(batch.column(0)):
                begin = np.zeros(len(tokens), dtype=bool)
                begin[first[:-1]] = True
                held.append(known.numbers(tokens)), marks.append(begin)
                seen += len(tokens)
                if sum(map(len, held)) >= _TRAIN_TOKENS:
                    go()
        if held:
            go()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([trainer.m.to_bytes()], type=pa.binary())], names=["tokens", "weights"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, sums = 0, None
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            one = np.frombuffer(raw.as_buffer(), dtype="<f4").astype(np.float64) * n
            total, sums = total + n, one if sums is None else sums + one
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([(sums / total).astype("<f4").tobytes()], type=pa.binary())], names=["tokens", "weights"])


def train(texts: DataFrame, lexicon: Lexicon, shares: tuple[int, ...] = ROUNDS, rate: float = gru.RATE) -> gru.Model:
    """A model trained on all texts (turn, text), each once; turn is 0 .. sum(shares) - 1."""
    context = texts.sparkSession.sparkContext
    model = gru.Model.new(lexicon.sizes)
    shared, low = context.broadcast(lexicon), 0
    for share in shares:
        part = texts.where(F.col("turn").between(low, low + share - 1)).select("text")
        weights = context.broadcast(model.to_bytes())
        each = part.mapInArrow(_train(shared, weights, model, rate), "tokens long, weights binary")
        rows = each.repartition(AVERAGERS).mapInArrow(_average, "tokens long, weights binary").collect()  # AVERAGERS rows at most
        total = sum(r["tokens"] for r in rows)
        if total:
            model = model.from_flat(sum(np.frombuffer(r["weights"], dtype="<f4").astype(np.float64) * (r["tokens"] / total) for r in rows))
        low += share
    return model


def _score(lexicon, model):
    """(doc_id, text) to (doc_id, n_tokens, n_known, gain, network, rare): what follows from the broadcast tables alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = lexicon.value, model.value
        share = np.log10(known.other + known.other_words + 1.0)
        for batch in batches:
            parts = list(_hashes(batch.column(1)))
            if not parts:
                continue
            tokens = np.concatenate([t for _, t, _ in parts])
            shift = np.cumsum([0] + [len(t) for _, t, _ in parts])
            first = np.concatenate([f[:-1] + s for (_, _, f), s in zip(parts, shift)] + [shift[-1:]])
            at, there = known.look_up(tokens)
            n, owner = len(first) - 1, np.repeat(np.arange(len(first) - 1), np.diff(first))
            gains = np.where(there, known.gains[at], 0.0) if len(known.words) else np.zeros(len(tokens))
            numbers = known.numbers(tokens)
            other = numbers == 1
            network = gru.score(net, numbers, first) - np.bincount(owner, other * share, n) + np.bincount(owner, gains * other, n)
            rare = np.flatnonzero(~there)
            bounds = np.searchsorted(rare, first).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first)), pa.array(np.bincount(owner, there, n).astype(np.int64)), pa.array(np.bincount(owner, gains, n)), pa.array(network), pa.ListArray.from_arrays(pa.array(bounds), pa.array(tokens[rare]))],
                names=["doc_id", "n_tokens", "n_known", "gain", "network", "rare"])

    return run


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words with the highest counts: as many steps of a sixteenth of an octave as hold ``most`` words at most."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()  # a thousand rows at most
    low, held = None, 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        held += row["words"]
        if held > most:
            break
        low = row["step"]
    return counts.where(step >= low) if low is not None else counts.limit(0)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY, broadcast_words: int = BROADCAST_WORDS, rate: float = gru.RATE) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.col("text").cast("string"))
    learned = rows.where(~held_out(F.col("doc_id"))).select(F.pmod(F.xxhash64("doc_id"), F.lit(sum(ROUNDS))).alias("turn"), "text")
    counts = learned.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = through_table(counts, f"{folder}/counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent(counts, broadcast_words).toPandas().sort_values(["n", "word"], ascending=[False, True])  # broadcast_words rows at most
    lexicon = Lexicon(top["word"].to_numpy(dtype=np.int64), top["n"].to_numpy(dtype=np.int64), int(total), int(distinct), vocabulary)
    model = train(learned, lexicon, rate=rate)

    context = spark.sparkContext
    shape = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, gain double, network double, rare array<long>"
    scored = rows.mapInArrow(_score(context.broadcast(lexicon), context.broadcast(model)), shape)
    scored = through_table(scored.withColumn("row", F.monotonically_increasing_id()), f"{folder}/scored")
    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_gain"))
    both = scored.drop("rare").join(found, "row", "left").fillna(0, ["more"]).fillna(0.0, ["more_gain"])
    return both.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("gain") + F.col("more_gain") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))).alias("base_score"),
        (F.col("network") + F.col("more_gain")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
