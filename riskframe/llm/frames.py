"""Small helpers that all operators share: choosing columns, and cutting lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def column_index(df: DataFrame, name: str) -> int:
    """Where a column is: the exact spelling first, else the only one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    like = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(like) != 1:
        raise ValueError(f"no column {name!r} in {df.columns}")
    return like[0]


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the wanted columns, as ``new=old``; other columns never clash with them."""
    at = {new: column_index(df, old) for new, old in names.items()}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """All columns under the names c0, c1, ... and the names they had."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), list(df.columns)


def with_results(df: DataFrame, names: list[str], results: list[str]) -> DataFrame:
    """Undo :func:`numbered`: give the columns their names back and append the result columns.

    An input column that has the name of a result gives way to it."""
    taken = {r.lower() for r in results}
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in taken]
    return df.select(*kept, *results)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only a session on a local master that names none (a test) gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        own = context._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="riskframe-checkpoint-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """What runs inside hands whole texts to Python in batches of so many rows: an executor holds a few of them at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def through_table(df: DataFrame, path: str) -> DataFrame:
    """Write the rows as a Parquet table of the shared folder and read them back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
