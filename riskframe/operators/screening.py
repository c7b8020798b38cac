"""Screening by many rules at once: an inverted index from literals to rules, and patterns for what is left.

A rule is (ord, rule, pattern, fold) with a ``literal`` that every match of its pattern contains (in lower case
if the rule folds case), or none. All literals are found in one pass over a text by an automaton, whatever their
number; only the rules whose literal occurs, and those without one, are then tried by their patterns, by the same
expressions as :func:`riskframe.operators.validate.screen_text`. So the cost of a text follows from its length and
from what it nearly matches, not from the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rules that are broadcast; the rules' patterns are the caller's and as long as they are.
MOST_RULES = 200_000
_BETWEEN = "\x1f"


@dataclass(frozen=True)
class Rule:
    rule: str
    pattern: str
    fold: bool = True
    literal: str | None = None


class _Index:
    """The automaton over distinct literals, and the rules of each."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.always = [i for i, r in enumerate(rules) if not r.literal]
        self.rules: dict[bool, dict[str, list[int]]] = {True: {}, False: {}}
        for i, r in enumerate(rules):
            if r.literal:
                self.rules[r.fold].setdefault(r.literal.lower() if r.fold else r.literal, []).append(i)
        self.automata: dict[bool, object] | None = None

    def _build(self) -> None:
        import ahocorasick

        self.automata = {}
        for fold, by_literal in self.rules.items():
            if by_literal:
                automaton = ahocorasick.Automaton()
                for literal, which in by_literal.items():
                    automaton.add_word(literal, which)
                automaton.make_automaton()
                self.automata[fold] = automaton

    def near(self, text: str) -> list[int]:
        """The rules that may match, in their order."""
        if self.automata is None:
            self._build()
        found = set(self.always)
        for fold, automaton in self.automata.items():
            seen: set[int] = set()
            for _, which in automaton.iter(text.lower() if fold else text):
                if id(which) not in seen:
                    seen.add(id(which))
                    found.update(which)
        return sorted(found)


def candidates(df: DataFrame, rules: Sequence[Rule], text: str, out: str = "_near") -> DataFrame:
    """df with ``out``: the numbers of the rules that a row's text may match."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    shape = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    schema, at = to_arrow_schema(shape), df.columns.index(text)
    index = df.sparkSession.sparkContext.broadcast(_Index(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [index.value.near(t.as_py()) if t.is_valid else [] for t in batch.column(at)]
            bounds = np.cumsum([0, *map(len, near)]).astype(np.int32)
            flat = pa.array([i for n in near for i in n], type=pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds), flat).cast(schema.field(out).type)], schema=schema)

    return df.mapInArrow(run, shape)


def _constant(items: list[str]) -> Column:
    """An array that Spark folds into one literal; as so many literals it would cost more than the screening."""
    if any(_BETWEEN in x for x in items):
        raise ValueError("rules and patterns must not hold the unit separator")
    return F.split(F.lit(_BETWEEN.join(items)), _BETWEEN)


def screen(df: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """Adds ``rule`` (the first rule in their order that matches, NULL if none), ``rules`` (all that match, in order) and ``is_safe``.

    A null text matches nothing. No row is dropped and no text changed."""
    near = candidates(df, rules, text)
    if not rules:
        return near.drop("_near").withColumns({"rule": F.lit(None).cast("string"), "rules": F.array().cast("array<string>"), "is_safe": F.lit(True)})
    table = _constant([r.rule for r in rules])
    patterns = _constant([("(?i)" if r.fold else "") + r.pattern for r in rules])
    hits = F.filter("_near", lambda i: F.rlike(F.col(text), F.get(patterns, i)))
    out = near.withColumn("rules", F.transform(hits, lambda i: F.get(table, i)))
    return out.drop("_near").withColumn("rule", F.get("rules", F.lit(0))).withColumn("is_safe", F.col("rule").isNull())
