"""Checks that report every error of a row and split good rows from bad ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import limits as L
from riskframe.functions.network import callback_error
from riskframe.functions.text import head, is_blank, strip_ws


def body_errors(content: Column, fmt: Column) -> Column:
    """Base64 body: blank, encoding, size and the first bytes of the declared format."""
    decoded = F.try_to_binary(content, F.lit("base64"))
    # Strict: no characters outside the alphabet, padding only at the end, whole quads.
    strict = content.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    blank = is_blank(content)
    ok = ~blank & strict
    magic = F.hex(F.substring(decoded, 1, 4))
    return F.array(
        F.when(blank, "content: empty"),
        F.when(~blank & ~strict, "content: not base64"),
        F.when(F.char_length(content) > L.MAX_ENCODED_CHARS, "content: encoded text too long"),
        F.when(ok & (F.octet_length(decoded) > L.MAX_BODY_BYTES), "content: body too large"),
        F.when(ok & (fmt == "fdx") & F.contains(decoded, F.lit(b"\x00")), "content: null bytes"),
        F.when(
            ok & (fmt == "fdx") & F.try_validate_utf8(decoded.cast("string")).isNull(), "content: not UTF-8 text"
        ),
        F.when(ok & (fmt == "pdf") & ~magic.startswith("25504446"), "content: not a PDF"),
    )


def project_error(project_id: Column) -> Column:
    good = project_id.rlike(rf"\A[A-Za-z0-9_-]{{1,{L.MAX_PROJECT_ID}}}\z")
    return F.when(~F.coalesce(good, F.lit(False)), "project_id: not allowed")


def metadata_errors(metadata: Column) -> Column:
    """``metadata`` is MAP<STRING,STRING> with each value as JSON text, so that the kind of
    a value is still visible: scalars only."""
    keys, values = F.map_keys(metadata), F.map_values(metadata)

    def too_long(v: Column) -> Column:
        return v.startswith('"') & (F.char_length(F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")) > L.MAX_META_VALUE_CHARS)

    return F.array(
        F.when(F.size(keys) > L.MAX_META_KEYS, "metadata: too many keys"),
        F.when(F.exists(keys, lambda k: ~k.rlike(rf"\A[A-Za-z0-9_-]{{1,{L.MAX_META_KEY_CHARS}}}\z")), "metadata: bad key"),
        F.when(F.exists(values, too_long), "metadata: value too long"),
        F.when(F.exists(values, lambda v: strip_ws(v).rlike(r"\A[\[{]")), "metadata: value is not a scalar"),
    )


def submission_errors(columns: Sequence[str], allowed_hosts: Sequence[str]) -> Column:
    fmt = F.lower(F.col("script_format"))
    refused = callback_error(F.col("callback_url"), allowed_hosts)
    single = [
        F.when(~F.coalesce(fmt.isin(*L.SCRIPT_FORMATS), F.lit(False)), "script_format: unsupported"),
        project_error(F.col("project_id")),
        F.when(refused.isNotNull(), F.concat(F.lit("callback_url: "), refused)),
        F.when(F.char_length("idempotency_key") > L.MAX_IDEMPOTENCY_KEY, "idempotency_key: too long"),
    ]
    if "priority" in columns:
        single.append(F.when(~F.coalesce(F.col("priority"), F.lit(5)).between(1, 10), "priority: out of range"))
    lists = [F.array(*single), body_errors(F.col("script_content"), fmt)]
    if "metadata" in columns:
        lists.append(F.coalesce(metadata_errors(F.col("metadata")), F.array().cast("array<string>")))
    return F.array_compact(F.concat(*lists))


def check_submissions(df: DataFrame, allowed_hosts: Sequence[str]) -> DataFrame:
    """Adds ``errors``: every violation of the row, empty if it is fine."""
    return df.withColumn("errors", submission_errors(df.columns, allowed_hosts))


def validate_submissions(df: DataFrame, allowed_hosts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with ``errors``)."""
    checked = check_submissions(df, allowed_hosts)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def decode_body(df: DataFrame) -> DataFrame:
    return df.withColumn("body", F.try_to_binary("script_content", F.lit("base64")))


def split_by_format(df: DataFrame, fmt: str = "script_format") -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows per supported format, unsupported rows with the list of supported ones)."""
    name = F.lower(F.col(fmt))
    supported = {f: df.where(name == f) for f in L.SCRIPT_FORMATS}
    rest = df.where(~F.coalesce(name.isin(*L.SCRIPT_FORMATS), F.lit(False)))
    return supported, rest.withColumn(
        "error", F.concat(F.lit("unsupported format: "), F.coalesce(fmt, F.lit("")), F.lit(f"; supported: {', '.join(L.SCRIPT_FORMATS)}"))
    )


def screen_text(df: DataFrame, rules: Sequence[tuple[str, str, str, bool]], text: str = "text") -> DataFrame:
    """Adds ``rule`` (first matching rule, NULL if none) and ``is_safe``. Reports only:
    no row is dropped and no text changed.

    ``rules`` is the collected rule table, compiled into one expression.
    """
    first = F.coalesce(
        *(F.when(F.col(text).rlike(("(?i)" if fold else "") + pattern), F.lit(rule)) for rule, _, pattern, fold in rules)
    )
    return df.withColumn("rule", first).withColumn("is_safe", F.col("rule").isNull())


def parse_tags(c: Column) -> Column:
    """Comma list without blanks; order kept, repeats kept."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip_ws), lambda t: t != "")


def normalise_kb(df: DataFrame, max_title: int | None = None, max_source: int | None = None) -> DataFrame:
    """Title, source and tags in their stored form, plus ``errors``.

    Limits are only kept if they are given; ``title_truncated`` and ``source_truncated`` then mark
    what was cut."""
    tags = parse_tags(F.col("tags"))
    title, source = strip_ws(F.col("title")), strip_ws(F.upper("source"))
    over = lambda c, most: F.char_length(c) > most if most is not None else F.lit(False)
    return df.select(
        *[c for c in df.columns if c not in ("title", "source", "tags")],
        head(title, max_title).alias("title"),
        over(title, max_title).alias("title_truncated"),
        head(source, max_source).alias("source"),
        over(source, max_source).alias("source_truncated"),
        F.array_distinct(tags).alias("tags"),
        F.array_compact(
            F.array(
                F.when(F.size(tags) > L.MAX_TAGS, "tags: too many"),
                F.when(~F.col("ttl_hours").between(L.MIN_TTL_HOURS, L.MAX_TTL_HOURS), "ttl_hours: out of range"),
            )
        ).alias("errors"),
    )
