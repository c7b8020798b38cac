"""A corpus from raw documents: quality rules, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns documents for the next one. The last returns
every document that is left with its size, its source's size and target, and the words that the
mix takes of it (0: it isn't in the mix; more than its size: it is repeated).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import decontaminate, mixing, pseudonyms, quality, simhash
from riskframe.llm.frames import shared_folder, table, through_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the new text."""
    return pseudonyms.pseudonymise(docs, counts=False, length="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix of sources takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
]
#: Learned rules and XXH64 fingerprints have no SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last through a Parquet table in the shared folder."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = through_table(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
