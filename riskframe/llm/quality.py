"""Quality rules: a decision list learned from labelled statistics.

Every text gets counts in one pass (no shuffle). Sequential covering then learns, from a bounded
sample of labelled rows, an ordered list of rules that reject: each rule is a conjunction of
thresholds, grown condition by condition on two thirds of the rows that no earlier rule covers
and pruned from its end on the last third. The list becomes one ordered Spark CASE expression.

Defined results for odd input:
- a null or empty text has no words, so it fails the base rule (fewer than ten words);
- repeated documents are judged row by row; a document with several labels counts as its worst;
- with no labels, or labels of one kind only, the list is empty and the base rule alone decides;
- extra columns are passed on; one that has the name of a result column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.frames import column_index, numbered, pick, table, with_results
from riskframe.llm.words import U64, code_points, mix, read_words, slices, window_hashes

#: Most labelled rows that the rules are learned from, chosen by a hash of the id.
FIT_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, MIN_COVERED, MIN_PRECISION = 12, 4, 10, 0.9
REPEAT_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
SYMBOLS = b"#*$%&|<>"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words", "n_same_as_last"]
_NOT_NEWLINE = np.arange(256) != 0x0A


def _flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_SYMBOL = _flags(SYMBOLS)
_UPPER, _DIGIT = _flags(bytes(range(0x41, 0x5B))), _flags(bytes(range(0x30, 0x3A)))
_MARK = _flags(b"!?#*$%&|<>")


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each owner has."""
    _, first = np.unique(keys ^ mix(owner.astype(U64) + U64(1)), return_index=True)
    return np.bincount(owner[first], minlength=n)


def count_slice(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The counts of _COUNTS for the texts of a slice."""
    words = read_words(data, offsets)
    n, owner, hashes = words.texts, words.text_of_word(), words.hashes()
    points = code_points(data)

    def of_bytes(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(flags[data], out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    starts = np.flatnonzero(words.whole_windows(REPEAT_WINDOW))
    keys = window_hashes(hashes, REPEAT_WINDOW)[starts] ^ mix(owner[starts].astype(U64) + U64(1))
    _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = starts[times[back] > 1]
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0

    lines = read_words(data, offsets, _NOT_NEWLINE)
    with_word = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    line_owner = lines.text_of_word()[with_word]
    n_lines = np.bincount(line_owner, minlength=n)

    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    return [
        words.counts, words.summed(points[words.end] - points[words.start]), of_bytes(_SYMBOL),
        n_lines - _distinct(lines.hashes()[with_word], line_owner, n), words.summed(covered.astype(np.int64)), n_lines,
        of_bytes(_UPPER), of_bytes(_DIGIT), of_bytes(_MARK), _distinct(hashes, owner, n), words.summed(same.astype(np.int64)),
    ]


def _measure(at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [count_slice(data, offsets) for _, _, data, offsets in slices(batch.column(at))]
            counts = [np.concatenate(c).astype(np.int64) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counts)], schema=schema)

    return run


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of every whole text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    df, names = numbered(docs)
    at = column_index(docs, text)
    df = df.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    shape = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in _COUNTS]])
    return with_results(df.mapInArrow(_measure(at, to_arrow_schema(shape)), shape), names, _COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def statistics() -> dict[str, Column]:
    """What the rules may look at: shares, so that they mean the same for texts of any length."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.col(c) / words
    return {
        "n_words": F.col("n_words").cast("double"), "word_length": share("word_chars"), "symbols": share("n_symbols"), "marks": share("n_marks"),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeats": share("n_repeat_words"),
        "upper": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), "digits": F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1)),
        "distinct": share("n_distinct_words"), "same_as_last": share("n_same_as_last"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def expression(self) -> Column:
        value = statistics()[self.name]
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold


Rule = tuple[Condition, ...]


def _hits(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(table[c.name])
    return out


def _grow(table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_CONDITIONS and bad[inside].sum() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, found = 1e-9, None
        for name, values in table.items():
            here = values[inside]
            cuts = np.unique(np.quantile(here, np.linspace(0.01, 0.99, 99)))
            for above in (True, False):
                held = here[None, :] > cuts[:, None] if above else here[None, :] <= cuts[:, None]
                p, n = (held & bad[inside]).sum(1), (held & ~bad[inside]).sum(1)
                gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0)))
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, found = gain[k], Condition(name, above, float(cuts[k]))
        if found is None:
            break
        rule += (found,)
        inside &= found.holds(table[found.name])
    return rule


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on rows it wasn't grown on."""
    def worth(k: int) -> float:
        hit = _hits(rule[:k], table, len(bad))
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / max(p + n, 1)

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def _centre(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The rule with each threshold midway between the rows that it keeps out and those that it is for,
    so that a text that is only a little beyond the good ones isn't rejected."""
    for k, c in enumerate(rule):
        others = _hits(rule[:k] + rule[k + 1 :], table, len(bad))
        values = table[c.name]
        inside, outside = values[others & c.holds(values) & bad], values[others & ~c.holds(values)]
        if len(inside) and len(outside):
            edge, near = (np.quantile(inside, 0.01), outside.max()) if c.above else (np.quantile(inside, 0.99), outside.min())
            rule = rule[:k] + (Condition(c.name, c.above, float((edge + near) / 2)),) + rule[k + 1 :]
    return rule


def cover(table: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """Sequential covering: rules in the order in which they are to be tried."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    turn = np.random.default_rng(seed).permutation(len(bad)) % 3
    while len(rules) < MAX_RULES and bad[left].sum() >= MIN_COVERED:
        grow, prune = left & (turn != 0), left & (turn == 0)
        of = lambda rows: ({k: v[rows] for k, v in table.items()}, bad[rows])
        rule = _centre(_prune(_grow(*of(grow)), *of(prune)), *of(left))
        hit = _hits(rule, table, len(bad)) & left
        if not rule or hit.sum() < MIN_COVERED or bad[hit].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules that reject, learned from at most ``fit_rows`` labelled documents (label 0 is bad)."""
    marked = pick(labels, doc_id="doc_id", label=label).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    mine = pick(docs, doc_id=doc_id, text=text).join(F.broadcast(marked), "doc_id")  # fit_rows rows at most
    seen = measure(mine).where(~base_failed())
    rows = seen.select((F.col("label") == 0).alias("bad"), F.xxhash64("doc_id", "text").alias("turn"), *[v.alias(k) for k, v in statistics().items()]).toPandas()
    rows = rows.sort_values("turn")
    return cover({k: rows[k].to_numpy(dtype=float) for k in statistics()}, rows["bad"].to_numpy(dtype=bool))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: true if the text stays."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        test = rule[0].expression()
        for c in rule[1:]:
            test &= c.expression()
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs with the counts, base_failed and kept."""
    inner, names = numbered(docs)
    seen = measure(inner, f"c{column_index(docs, text)}")
    seen = seen.select("*", base_failed().alias("base_failed"), verdict(rules).alias("kept"))
    return with_results(seen, names, [*_COUNTS, "base_failed", "kept"])


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs without those that the base rule or the decision list rejects."""
    inner, names = numbered(docs)
    return judge(inner, rules, f"c{column_index(docs, text)}").where("kept").select(*inner.columns).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
