"""Plug-in points for models, and the deterministic stand-ins used without one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.text import head, is_blank, sanitise
from riskframe.functions.vectors import hashed_bag


def words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def keyword_findings(scenes: DataFrame, lexicon: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One raw finding per scene and class: highest scores of the terms that occur, number
    of occurrences and the terms as evidence.

    Words are counted within each scene's rows before the shuffle; a small lexicon is broadcast by
    Spark's own threshold, a large one is joined by a shuffle.
    """
    seen = (
        scenes.select(*key, F.explode(words(F.col(text))).alias("term"))
        .join(lexicon, "term")
        .groupBy(*key, "risk_class", "term")
        .agg(F.count("*").alias("n"), F.max("likelihood").alias("likelihood"), F.max("impact").alias("impact"))
    )
    return seen.groupBy(*key, "risk_class").agg(
        F.max("likelihood").alias("likelihood"),
        F.max("impact").alias("impact"),
        F.sum("n").alias("hits"),
        F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("evidence"),
    )


def call_model(
    scenes: DataFrame, fn: Callable[[pd.DataFrame], list[str]], concurrency: int | None = None, out: str = "model_json"
) -> DataFrame:
    """Adds what ``fn`` returns for each scene, and ``error`` where it failed.

    ``fn`` gets a batch as a pandas frame and returns one JSON text per row. A failing batch
    is tried again row by row, so one bad scene costs only itself; scenes of that batch that were
    answered the first time are asked again. ``concurrency`` bounds the
    calls in flight: it is the number of partitions of this step.
    """
    schema = scenes.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def one_by_one(pdf: pd.DataFrame) -> tuple[list, list]:
        results, errors = [], []
        for i in range(len(pdf)):
            try:
                (answer,) = fn(pdf.iloc[i : i + 1])
                results.append(answer)
                errors.append(None)
            except Exception as exc:
                results.append(None)
                errors.append(type(exc).__name__)
        return results, errors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                results, errors = list(fn(pdf)), [None] * len(pdf)
                if len(results) != len(pdf):
                    raise ValueError("the model gave another number of answers")
            except Exception:
                results, errors = one_by_one(pdf)
            yield pdf.assign(**{out: results, "error": errors})

    spread = scenes.repartition(concurrency) if concurrency else scenes
    return spread.mapInPandas(run, f"{fields}, `{out}` string, error string")


def embedding_input(text: Column, max_chars: int | None = None) -> Column:
    """STRUCT<text, truncated, error>: what an embedding model is given; whole unless a limit is asked for."""
    clean = sanitise(text)
    cut = F.char_length(clean) > max_chars if max_chars is not None else F.lit(False)
    return F.struct(
        F.when(~is_blank(text), head(clean, max_chars)).alias("text"),
        cut.alias("truncated"),
        F.when(is_blank(text), F.lit("empty text")).alias("error"),
    )


def embedding_slices(df: DataFrame, text: str, size: int) -> DataFrame:
    """All slices of a long text (slice_no, slice), for models with a limit: nothing is dropped."""
    clean = sanitise(F.col(text))
    last = F.floor((F.greatest(F.char_length(clean), F.lit(1)) - 1) / size).cast("int")
    at = df.withColumn("_clean", clean).withColumn("slice_no", F.explode(F.sequence(F.lit(0), last)))
    return at.withColumn("slice", F.substring("_clean", F.col("slice_no") * size + 1, F.lit(size))).drop("_clean")


def embed(df: DataFrame, fn: Callable[[pd.Series], list], text: str = "text", out: str = "embedding", concurrency: int | None = None) -> DataFrame:
    """Adds the vector that a provider returns for each text, and ``error`` where it gave none.

    ``fn`` gets a series of texts and returns a vector (or None) for each; a failing batch is tried
    again text by text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def ask(texts: pd.Series) -> list:
        answers = list(fn(texts))
        if len(answers) != len(texts):
            raise ValueError("the provider gave another number of vectors")
        return answers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors, errors = [], []
            try:
                vectors = ask(pdf[text])
                errors = [None if v is not None else "not implemented" for v in vectors]
            except Exception:
                vectors = []
                for i in range(len(pdf)):
                    try:
                        vectors += ask(pdf[text].iloc[i : i + 1])
                        errors.append(None if vectors[-1] is not None else "not implemented")
                    except Exception as exc:
                        vectors.append(None)
                        errors.append(type(exc).__name__)
            yield pdf.assign(**{out: vectors, "error": errors})

    dealt = df.repartition(concurrency) if concurrency else df
    return dealt.mapInPandas(run, f"{fields}, `{out}` array<float>, error string")


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Stand-in embedder: word counts in hashed buckets; equal texts, equal vectors."""
    return hashed_bag(words(text), dim)
