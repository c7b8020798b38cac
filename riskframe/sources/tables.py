"""Tables that change: hashed parts that are rewritten one by one.

A table is a folder of Parquet files, partitioned by ``part``: a group (say, the tenant) and the hash of
the key in so many buckets. An upsert or a delete reads and rewrites the parts that hold a wanted key,
by Spark's dynamic partition overwrite; all other files stay as they are, with their times. A part is
written by one task as one file, so every rewrite also compacts; the number of buckets bounds its size.

A rewrite replaces its parts when its job commits. If that fails half way, some parts are new and some
old; both operations give the same table when they are run again, so a repeated batch heals it.
One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.sources.files import Store

#: Parts that are named in a filter; more are joined.
FILTER_PARTS = 2000


class KeyedTable:
    """Rows with a unique ``key``, in ``buckets`` parts for each value of ``group``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, key: str, group: str | None = None, buckets: int = 16) -> None:
        self.spark, self.folder, self.key, self.group, self.buckets = spark, folder.rstrip("/"), key, group, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.store = Store(spark, self.folder)

    def part(self) -> Column:
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("string")
        return F.concat(F.coalesce(F.col(self.group).cast("string"), F.lit("")), F.lit("~"), bucket) if self.group else bucket

    def _all(self) -> DataFrame:
        if not any(n.startswith("part=") for n in self.store.names("")):
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("part", T.StringType())]))
        whole = T.StructType([*self.schema.fields, T.StructField("part", T.StringType())])
        return self.spark.read.schema(whole).parquet(self.folder)

    def read(self) -> DataFrame:
        return self._all().drop("part")

    def of_group(self, value: str) -> DataFrame:
        """The rows of one group: no other group's files are opened."""
        return self._within([f"{value}~{b}" for b in range(self.buckets)]).where(F.col(self.group) == value).drop("part")

    def _within(self, parts: list[str]) -> DataFrame:
        rows = self._all()
        if len(parts) <= FILTER_PARTS:
            return rows.where(F.col("part").isin(parts))
        return rows.join(F.broadcast(self.spark.createDataFrame([(p,) for p in parts], "part string")), "part", "left_semi")

    def parts_of(self, rows: DataFrame) -> list[str]:
        """The parts that hold the rows' keys; names of parts alone reach the driver."""
        return [r["part"] for r in rows.select(self.part().alias("part")).distinct().collect()]

    def _replace(self, rows: DataFrame, parts: list[str]) -> None:
        """The rows become the whole content of the parts; a part without rows goes."""
        names = [f.name for f in self.schema.fields]
        out = rows.select(*names, self.part().alias("part"))
        writer = out.repartition(max(1, min(len(parts), 10_000)), "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        before = {p: self.store.times(f"part={_escaped(p)}") for p in parts}
        writer.partitionBy("part").parquet(self.folder)
        for p in parts:  # dynamic overwrite leaves alone what gets no row
            if before[p] and self.store.times(f"part={_escaped(p)}") == before[p]:
                self.store.delete(f"part={_escaped(p)}")

    def upsert(self, rows: DataFrame, merge) -> int:
        """``merge(old rows and new rows)`` gives a row for each key. Returns the number of parts that were rewritten."""
        parts = self.parts_of(rows)
        if parts:
            names = [f.name for f in self.schema.fields]
            self._replace(merge(self._within(parts).select(*names).unionByName(rows.select(*names))), parts)
        return len(parts)

    def delete(self, keys: DataFrame) -> int:
        """Take the rows of the keys away (keys has ``key`` and, if there is one, ``group``). Returns how many there were."""
        by = [self.key, *([self.group] if self.group else [])]
        wanted = keys.select(*by).distinct()
        parts = self.parts_of(wanted)
        if not parts:
            return 0
        there = self._within(parts)
        hit = there.join(wanted, by, "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each part
        touched = [r["part"] for r in hit]
        if touched:
            self._replace(self._within(touched).join(wanted, by, "left_anti"), touched)
        return sum(r["n"] for r in hit)

    def compact(self, most_files: int = 1) -> list[str]:
        """Rewrite the parts of more than ``most_files`` files; their names."""
        parts = [n.removeprefix("part=") for n in self.store.names("") if n.startswith("part=")]
        many = [p for p in parts if sum(f.endswith(".parquet") for f in self.store.times(f"part={p}")) > most_files]
        names = [_plain(p) for p in many]
        if names:
            self._replace(self._within(names), names)
        return names


#: Characters that Spark writes as % and two hex digits in the name of a partition's folder.
_ESCAPED = "\"#%'*/:=?\\\x7f{}[]^" + "".join(map(chr, range(1, 32)))


def _escaped(part: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in part)


def _plain(name: str) -> str:
    from urllib.parse import unquote

    return unquote(name)


# --- latest state -------------------------------------------------------------------------------------


class LatestTable:
    """One row for each key with the latest value of each field and when it was set.

    A late event with an older time changes nothing, and one that doesn't set a field leaves it; a batch
    that is given twice changes nothing the second time."""

    def __init__(self, spark: SparkSession, folder: str, key: str, fields: dict[str, str], buckets: int = 16, key_type: str = "string") -> None:
        self.fields, self.key = list(fields), key
        columns = [f"{key} {key_type}", *[f"{n} {kind}, {n}_at timestamp" for n, kind in fields.items()]]
        self.table = KeyedTable(spark, folder, ", ".join(columns), key, buckets=buckets)

    def _latest(self, rows: DataFrame, value, at) -> DataFrame:
        newest = [F.max(F.when(value(n).isNotNull(), F.struct(at(n).alias("at"), value(n).alias("v")))).alias(n) for n in self.fields]
        per = rows.groupBy(self.key).agg(*newest)
        return per.select(self.key, *[c for n in self.fields for c in (F.col(n)["v"].alias(n), F.col(n)["at"].alias(f"{n}_at"))])

    def apply(self, events: DataFrame, ts: str = "ts") -> int:
        """Take in events (key, ts, any of the fields); the number of parts that were rewritten. Events without a key are left out."""
        missing = [F.lit(None).cast(self.table.schema[n].dataType).alias(n) for n in self.fields if n not in events.columns]
        given = [F.col(n).cast(self.table.schema[n].dataType).alias(n) for n in self.fields if n in events.columns]
        rows = events.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast(self.table.schema[self.key].dataType).alias(self.key), F.col(ts).cast("timestamp").alias("_at"), *given, *missing)
        fresh = self._latest(rows, F.col, lambda n: F.col("_at"))
        return self.table.upsert(fresh, lambda both: self._latest(both, F.col, lambda n: F.col(f"{n}_at")))

    def run(self, events: DataFrame, checkpoint: str, ts: str = "ts"):
        """A query that keeps the table up with a stream of events."""
        return events.writeStream.foreachBatch(lambda batch, number: self.apply(batch, ts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        return self.table.read()


# --- the knowledge store ------------------------------------------------------------------------------


class KnowledgeStore:
    """Documents and their chunks as two tables with the same parts, so that both change in step.

    A document's chunks go before the document itself: a delete that fails between the two finds the document
    again when it is repeated. Both tables hold doc_id and tenant_id."""

    def __init__(self, spark: SparkSession, folder: str, documents: str | T.StructType, chunks: str | T.StructType, buckets: int = 16) -> None:
        folder = folder.rstrip("/")
        self.documents = KeyedTable(spark, f"{folder}/documents", documents, "doc_id", "tenant_id", buckets)
        self.chunks = KeyedTable(spark, f"{folder}/chunks", chunks, "doc_id", "tenant_id", buckets)

    def add(self, documents: DataFrame, chunks: DataFrame) -> None:
        """Put documents in place of those of the same id, with their chunks."""
        replaced = documents.select("doc_id", "tenant_id").distinct()
        for table, rows in ((self.chunks, chunks), (self.documents, documents)):
            names, parts = [f.name for f in table.schema.fields], sorted({*table.parts_of(replaced), *table.parts_of(rows)})
            if parts:
                kept = table._within(parts).select(*names).join(replaced, ["doc_id", "tenant_id"], "left_anti")
                table._replace(kept.unionByName(rows.select(*names)), parts)

    def remove(self, doomed: DataFrame) -> dict[str, int]:
        """Take documents (doc_id, tenant_id) away for good; how many documents and chunks went."""
        keys = doomed.select("doc_id", "tenant_id").distinct()
        there = self.documents.read().join(keys, ["doc_id", "tenant_id"], "left_semi").select("doc_id", "tenant_id")
        chunks = self.chunks.delete(there)
        return {"documents": self.documents.delete(there), "chunks": chunks}

    def remove_by_tag(self, tenant: str, tag: str) -> dict[str, int]:
        if not tag or not tag.strip():
            raise ValueError("tag must not be blank")
        return self.remove(self.documents.of_group(tenant).where(F.array_contains("tags", tag)))

    def purge_expired(self, now: Column) -> dict[str, int]:
        """Without what has expired by ``now``, in all tenants."""
        return self.remove(self.documents.read().where(F.col("expires_at") <= now))

    def reseed(self, documents: DataFrame, chunks: DataFrame, tenant: str, tag: str) -> dict[str, int]:
        """The tagged documents of a tenant go, the fresh ones come."""
        gone = self.remove_by_tag(tenant, tag)
        self.add(documents, chunks)
        return gone
