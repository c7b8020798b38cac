"""URL filters: association rules over URL tokens.

FP-growth mines the combinations of tokens (host labels and the words of compound ones, path words,
extension, query keys) of labelled URLs, all of them. A rule is kept if enough URLs bear it out, if the
lower bound of its confidence (Wilson's, so that few URLs prove little) is high enough, and if no
shorter rule among its parts is as reliable. Tokens that too few bad URLs have are left out before
mining, as no rule can hold them. Rules are matched by an inverted index: each rule
is filed under its rarest token, each distinct URL looks up its tokens, and a rule that comes back
is checked for the rest of its tokens. Rules that are given by hand (host, path) come first.

Defined results for odd input:
- a null URL, or one without "://", has an empty host and path, fits no rule, and is allowed;
- no labels, no bad ones, or too few for a reliable rule: no mined rules, everything is allowed;
- a label is bad if any row for the URL says so; repeated pages get a row each;
- an empty table gives no rows; extra columns are passed on, and give way to results of their name.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.frames import column_index, cut, numbered, pick, table, with_results

MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
#: URLs that a rule must have blocked rightly, however small the table is, and deviations of the confidence's lower bound.
MIN_URLS, DEVIATIONS = 20, 2.58
#: An index of at most so many rules is broadcast; a larger one is joined by a shuffle.
BROADCAST_RULES = 20_000
BAD, GOOD = "=bad", "=good"

# The rules given by hand, as (verdict, host, path).
GIVEN = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens, each with a letter for where it stands."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    words = F.flatten(F.transform(F.filter(labels, lambda x: x.rlike("[-_]")), lambda x: F.split(x, "[-_]")))
    segments = F.split(path_of(url), "/")
    plain = F.filter(segments, lambda s: s.rlike("^[A-Za-z_-]+$"))
    extension = F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]{1,5})$", 1)
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    mark = lambda letter, items: F.transform(items, lambda x: F.concat(F.lit(letter + ":"), x))
    every = F.concat(mark("h", labels), mark("w", words), mark("p", plain), mark("e", F.array(extension)), mark("q", keys))
    return F.array_distinct(F.filter(every, lambda x: F.length(x) > 2))


def lower_bound(right, n, deviations: float = DEVIATIONS):
    """Wilson's lower bound of a share of which ``right`` of n were seen."""
    p, z2 = right / n, deviations * deviations
    return (p + z2 / (2 * n) - deviations * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS) -> DataFrame:
    """Rules (tokens, confidence, support) from rows (url, bad); all rows are used. ``confidence`` is the lower bound."""
    spark = labelled.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = labelled.where("url is not null and bad is not null").groupBy("url").agg(F.max("bad").alias("bad"))
    rows = cut(rows.select(tokens_of(F.col("url")).alias("own"), "bad"))
    n = rows.count()
    least = max(min_urls, int(-(-min_support * n // 1)))
    worth = rows.where("bad").select(F.explode("own").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    tokens = [r["token"] for r in worth.collect()]  # each has its share of the bad URLs: 1 / min_support times the tokens of a URL at most
    baskets = cut(rows.select(F.concat(F.array_intersect("own", F.array(*map(F.lit, tokens)).cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")).where(F.size("items") > 0).repartition(parts))
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(baskets.count(), 1)), numPartitions=parts).fit(baskets).freqItemsets
    sets = cut(sets.select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.array_contains("items", BAD).alias("bad"), "freq"))
    both = sets.where(F.size("tokens") > 0).groupBy("tokens").agg(F.max(F.when(F.col("bad"), F.col("freq"))).alias("right"), F.max(F.when(~F.col("bad"), F.col("freq"))).alias("freq"))
    bound = lower_bound(F.col("right").cast("double"), F.col("freq").cast("double"))
    rules = both.where(F.col("right") >= least).select("tokens", bound.alias("confidence"), (F.col("right") / F.lit(max(n, 1))).alias("support"))
    rules = cut(rules.where(F.col("confidence") >= min_confidence))
    # a rule is worth keeping if leaving out any one token makes it less reliable
    fewer = rules.where(F.size("tokens") > 1).select("tokens", F.col("confidence").alias("c"), F.explode("tokens").alias("without"))
    fewer = fewer.select("tokens", "c", F.array_remove("tokens", F.col("without")).alias("part"))
    known = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_c"))
    beaten = fewer.join(known, "part").where("part_c >= c").select("tokens").distinct()
    return rules.join(beaten, "tokens", "left_anti")


def blocked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls (column url) that a mined rule fits."""
    seen = urls.where("url is not null").select("url").distinct().withColumn("own", tokens_of(F.col("url")))
    filed = rules.select(F.monotonically_increasing_id().alias("rule"), "tokens")
    filed = cut(filed)
    spread = seen.select(F.explode("own").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posting = filed.select("rule", "tokens", F.explode("tokens").alias("token")).join(spread, "token", "left")
    index = posting.groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"), F.first("tokens").alias("tokens"))
    index = index.drop("rule")
    index = F.broadcast(index) if filed.count() <= BROADCAST_RULES else index
    hits = seen.select("url", "own", F.explode("own").alias("token")).join(index, "token")
    return hits.where(F.size(F.array_except("tokens", "own")) == 0).select("url").distinct()


def given_rule(host: Column, path: Column, rules=GIVEN) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for what, of, begin in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(begin)
        name, verdict = F.when(fits, F.lit(of + begin)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", given=GIVEN) -> DataFrame:
    """pages with host, path, rule (given by hand, or null) and verdict (allow or block)."""
    df, names = numbered(pages)
    at = F.col(f"c{column_index(pages, url)}").cast("string")
    df = df.withColumn("url", at)
    bad = blocked(df.select("url"), rules).withColumn("mined", F.lit("block"))
    # a null url joins nothing: it gets a key of its own, so that such rows don't meet in one task
    key = F.coalesce("url", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    df = df.withColumn("key", key).join(bad.withColumnRenamed("url", "key"), "key", "left").drop("key").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = given_rule(F.col("host"), F.col("path"), given)
    df = df.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.col("mined"), F.lit("allow")))
    return with_results(df, names, ["host", "path", "rule", "verdict"])


def query(spark, sf_dir: str) -> DataFrame:
    """Labels are of documents; a page's path names the document that it shows."""
    pages = pick(table(spark, sf_dir, "pages"), page_id="page_id", url="url")
    labels = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", quality="quality", toxic="toxic")
    bad = labels.select("doc_id", ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    shown = pages.select("url", F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[/.]|$)", 1).try_cast("long").alias("doc_id"))
    rules = mine(shown.join(bad, "doc_id").select("url", "bad"))
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")
