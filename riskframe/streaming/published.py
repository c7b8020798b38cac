"""Several tables that appear together: a commit manifest for each batch.

Every attempt at a batch writes its tables into folders of its own. When all are written, one small
file named after the batch is made, which says what folders belong to it. Readers look at these
files alone: a batch is there with all of its tables, or not at all. The file is made by renaming a
finished one, and never replaced, so of two attempts at a batch the first to finish counts and the
other's folders are never read; :func:`sweep` takes such folders away.

All files are reached through Spark's Hadoop file systems, so the folder may be in any store that
renames a file in one step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources.files import Store


class Attempt:
    """One attempt at a batch: folders that nobody reads before they are published."""

    def __init__(self, spark: SparkSession, folder: str, number: int) -> None:
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), f"batch={number}/{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        self.passing: list[str] = []

    def write(self, table: str, rows: DataFrame, keep: bool = True) -> DataFrame:
        """Write a table of the batch and read it back; with ``keep=False`` it is only for this attempt."""
        where = f"{'data' if keep else 'passing'}/{table}/{self.name}"
        rows.write.mode("errorifexists").parquet(f"{self.folder}/{where}")
        if keep:
            self.tables[table] = where
        else:
            self.passing.append(where)
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{where}")


def _manifest(number: int) -> str:
    return f"commits/{number:020d}.json"


def publish(spark: SparkSession, folder: str, number: int, tables: Callable[[Attempt], None]) -> bool:
    """Write the tables of a batch and make them visible together; false if the batch was there before."""
    store = Store(spark, folder)
    if store.exists(_manifest(number)):
        return False
    attempt = Attempt(spark, folder, number)
    tables(attempt)
    done = store.put_new(_manifest(number), json.dumps({"batch": number, "tables": attempt.tables}))
    for name in attempt.passing if done else [*attempt.passing, *attempt.tables.values()]:
        store.delete(name)
    return done


def commits(spark: SparkSession, folder: str) -> list[dict]:
    """The manifests of all published batches, in order."""
    store = Store(spark, folder)
    names = [n for n in store.names("commits") if n.endswith(".json") and not n.startswith(".")]
    if not names:
        return []
    texts = spark.read.text([f"{store.root}/commits/{n}" for n in names], wholetext=True).collect()  # a short file for each batch
    return sorted((json.loads(r["value"]) for r in texts), key=lambda m: m["batch"])


def read(spark: SparkSession, folder: str, table: str, schema: str | None = None) -> DataFrame | None:
    """All published rows of a table with their ``batch``; None if no batch has it."""
    found = [(m["batch"], m["tables"][table]) for m in commits(spark, folder) if table in m["tables"]]
    if not found:
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(*[f"{folder.rstrip('/')}/{where}" for _, where in found])
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long"))


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Take away the folders of attempts that were never published. Only for when no batch is being written."""
    store, kept, swept = Store(spark, folder), set(), []
    for manifest in commits(spark, folder):
        kept.update(manifest["tables"].values())
    for top in ("data", "passing"):
        for table in store.names(top):
            for batch in store.names(f"{top}/{table}"):
                for attempt in store.names(f"{top}/{table}/{batch}"):
                    where = f"{top}/{table}/{batch}/{attempt}"
                    if where not in kept:
                        store.delete(where)
                        swept.append(where)
    return swept
