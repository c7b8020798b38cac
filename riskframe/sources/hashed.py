"""Stored keys that stay where they are: a table bucketed by key, so that a batch alone moves to be held against it.

Duplicate tests (of contents for a tenant, of idempotency keys) ask a store of any size which keys of a batch it
has. The store is a bucketed, sorted table in the warehouse; the batch's distinct keys are dealt out to its buckets
and joined bucket by bucket, without a shuffle of the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyStore:
    """Distinct keys (columns ``keys``) with the values that were stored with them first."""

    def __init__(self, spark: SparkSession, name: str, schema: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.name, self.keys, self.buckets, self.schema = spark, name, keys, buckets, T.StructType.fromDDL(schema)
        if not spark.catalog.tableExists(name):
            self._write(spark.createDataFrame([], self.schema))

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def _named(self, batch: DataFrame) -> DataFrame:
        there = F.lit(True)
        for k in self.keys:
            there &= F.col(k).isNotNull()
        return batch.where(there)

    def known(self, batch: DataFrame) -> DataFrame:
        """The distinct keys of a batch that are stored, with the stored values."""
        wanted = self._named(batch).select(*self.keys).distinct().repartition(self.buckets, *self.keys)
        return self.read().hint("merge").join(wanted, self.keys)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key isn't stored; those without a whole key always pass."""
        first = self._named(batch)
        keys = first.select(*self.keys).distinct()
        stored = self.known(batch).select(*self.keys)
        new = keys.join(stored, self.keys, "left_anti")
        rest = batch.where(~F.coalesce(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys)), F.lit(False)))
        return first.join(new, self.keys, "left_semi").unionByName(rest)

    def add(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """Store the first row (in ``order``) of each key that isn't there; returns the batch's rows (with a key) and ``is_new``.

        The new rows are fixed before they are stored, so what is returned doesn't change by it."""
        from riskframe.session import run_dir

        names = [f.name for f in self.schema.fields]
        firsts = self._named(rows).groupBy(*self.keys).agg(F.min(F.struct(*order, *[n for n in names if n not in order])).alias("f"))
        fresh = self.unseen(firsts.select(*self.keys, "f"))
        folder = run_dir(self.spark, "keystore")
        fresh.select(*self.keys, "f").write.parquet(folder)
        fresh = self.spark.read.parquet(folder)
        self._write(fresh.select(*[F.col(n) if n in self.keys else F.col(f"f.{n}").alias(n) for n in names]))
        mark = fresh.select(*self.keys, F.struct(*[F.col(f"f.{c}").alias(c) for c in order]).alias("at"))
        return self._named(rows).join(mark, self.keys, "left").withColumn("is_new", F.coalesce(F.struct(*order) == F.col("at"), F.lit(False))).drop("at")
