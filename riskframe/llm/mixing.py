"""Mixing sources to target weights, with DataFrame operations only.

Each document gets a hash-random key. Within its source the keys are cut into ranges, as many as
the source's row count asks for, so that a source with a third of all rows is spread over many
tasks. Prefix sums of the ranges' word counts tell in which range a source's budget ends; only
that range is sorted, and the budget is cut there at the exact word. Whole epochs come first; the
rest goes to the documents that come first in key order. What a document takes then follows from
its key and its source's cut alone, so no text is shuffled.

Defined results for odd input:
- a null or empty text has size 0 and takes nothing; a source of size 0 has target 0;
- a null source is a source of its own and comes last in the order of weights;
- repeated documents count as often as they occur; equal keys are ordered by id and size, and the
  equal rows at a cut share what is left evenly, rounded down;
- an empty table gives no rows; extra columns are passed on, and give way to results of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.frames import column_index, cut, numbered, pick, table, with_results

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
#: About so many documents of a source are in one range.
RANGE_ROWS = 5_000
#: The table of cuts has one row for each source; it is broadcast up to so many sources, and joined by a shuffle beyond.
BROADCAST_SOURCES = 100_000
_KEY_DIGITS = 13
_RESULTS = ["size", "source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_key(ident: Column, seed: str) -> Column:
    """52 bits, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))), 1, _KEY_DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes (source, source_size, n_rows) with the target of each source.

    All sizes are shared out by weight; a source that would get more than ``most`` times its size
    stops there, and the rest is shared among the others. With the sources in the order of size
    over weight, those that stop are the first ones, and the level left for the others after the
    first k have stopped shows for which k that holds. The table has one row for each source."""
    place = F.pmod(F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(len(weights)))
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1))
    limit = most * F.col("source_size")
    order = [F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    words = F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    heads = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = out.withColumn("level", words / heads).withColumn("open", F.col("level") * F.col("weight") < limit)
    first = F.min(F.when(F.col("open"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "level"))).over(every)
    share = F.when(F.col("open"), first["level"] * F.col("weight")).otherwise(limit.cast("double"))
    return out.select("source", "source_size", "n_rows", share.alias("target"))


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row for each source of rows (source, id, key, size): its target, its whole epochs, and where the last epoch is cut."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    goals = targets(sizes, weights, most)
    goals = goals.withColumn("budget", F.round("target").cast("long"))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    goals = cut(goals.withColumn("ranges", F.greatest(F.ceil(F.col("n_rows") / RANGE_ROWS), F.lit(1)).cast("long")))

    small = goals.select(F.col("source").alias("s"), "rest", "ranges")
    ranged = beside(rows, small, goals.count()).withColumn("range", F.floor(F.col("key") / F.lit(float(16**_KEY_DIGITS)) * F.col("ranges")).cast("long"))
    totals = ranged.groupBy("source", "range", "rest").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("offset", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    ends = totals.where((F.col("offset") <= F.col("rest")) & (F.col("rest") < F.col("offset") + F.col("total")))
    ends = ends.select(F.col("source").alias("es"), F.col("range").alias("er"), "offset")
    near = ranged.join(ends, F.col("source").eqNullSafe(F.col("es")) & (F.col("range") == F.col("er")))
    near = near.groupBy("source", "rest", "offset", "key", "id", "size").agg(F.count(F.lit(1)).alias("copies"))
    inside = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    block = F.col("copies") * F.col("size")
    near = near.withColumn("before", F.col("offset") + F.coalesce(F.sum(block).over(inside), F.lit(0)))
    near = near.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + block))
    at = near.select(F.col("source").alias("cs"), F.struct("key", "id", "size").alias("cut"), F.floor((F.col("rest") - F.col("before")) / F.col("copies")).cast("long").alias("left"))
    return goals.join(at, F.col("source").eqNullSafe(F.col("cs")), "left").select("source", "source_size", "target", "epochs", "cut", "left")


def beside(rows: DataFrame, by_source: DataFrame, sources: int) -> DataFrame:
    """rows with what a table of one row for each source (named s) says of theirs."""
    right = F.broadcast(by_source) if sources <= BROADCAST_SOURCES else by_source
    return rows.join(right, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def taken(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """rows (source, id, size and others) with source_size, target and taken. rows is read twice: pass a table, or cut() it."""
    narrow = cut(rows.select("source", "id", "key", "size"))
    ends = cut(cuts(narrow, weights, most).withColumnRenamed("source", "s"))
    out = beside(rows, ends, ends.count())
    here = F.struct("key", "id", "size")
    last = F.when(here < F.col("cut"), F.col("size")).when(here == F.col("cut"), F.col("left")).otherwise(F.lit(0))
    last = F.when(F.col("cut").isNull(), F.lit(0)).otherwise(last)
    return out.withColumn("taken", (F.col("epochs") * F.col("size") + last).cast("long")).drop("epochs", "cut", "left")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """docs with size, source_size, target (of the source) and taken (words that the mix takes, repeats counted)."""
    df, names = numbered(docs)
    ident, body, name = (f"c{column_index(docs, c)}" for c in (doc_id, text, source))
    rows = df.select("*", F.col(name).alias("source"), F.col(ident).alias("id"), hash_key(F.col(ident), seed).alias("key"), word_count(F.col(body).cast("string")).alias("size"))
    return with_results(taken(rows, weights, most), names, _RESULTS)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [1, 2, 3][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS weight FROM d GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, CASE WHEN level * weight < 3 * source_size
    THEN (SELECT level FROM levels WHERE level * weight < 3 * source_size ORDER BY source_size / weight, source IS NULL, source LIMIT 1) * weight
    ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goal),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.epochs, CAST(round(g.target) AS BIGINT) - g.epochs * g.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN plan g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", source="source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
