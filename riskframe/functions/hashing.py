"""Hashes, stable ids and the encrypted original text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def key_prefix(token: Column) -> Column:
    """First 16 hex digits of the token's hash; the token itself is never stored."""
    return F.left(F.sha2(token, 256), F.lit(16))


def stable_id(*parts: Column) -> Column:
    """Id derived from its parts: the same after a task is run again."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)


def encrypt_column(df: DataFrame, name: str, keys: DataFrame, key_id: str = "key_id") -> DataFrame:
    """AES-GCM under the key of the row's ``key_id``.

    ``keys(key_id, key BINARY)`` comes from a protected table, so the key is in no plan text. A row
    without a key isn't lost: its content stays in ``<name>_pending`` and ``<name>_error`` says why,
    until it is handled. Keys are joined like any other table, however many there are.
    """
    joined = df.join(keys.select(key_id, "key"), key_id, "left")
    has = F.col("key").isNotNull()
    return joined.withColumns(
        {
            f"{name}_pending": F.when(~has, F.col(name)),
            f"{name}_error": F.when(~has, F.lit("no key")),
            name: F.when(has, F.aes_encrypt(F.col(name), F.col("key"))),
        }
    ).drop("key")


def decrypt_column(df: DataFrame, name: str, keys: DataFrame, key_id: str = "key_id") -> DataFrame:
    """Text again; where the key is missing, wrong or rotated, ``readable`` is false and the
    encrypted bytes stay in ``<name>_encrypted``."""
    joined = df.join(keys.select(key_id, "key"), key_id, "left")
    plain = F.try_aes_decrypt(F.col(name), F.col("key")).cast("string")
    return joined.withColumns(
        {f"{name}_encrypted": F.when(plain.isNull(), F.col(name)), "readable": plain.isNotNull(), name: plain}
    ).drop("key")
