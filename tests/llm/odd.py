"""Rows that every operator must take: nulls, empty and very long texts, repeats, clashing names."""

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
GIANT = "x" * 2_500_000

ROWS = [
    (1, "Plain words of a short text", "a"), (1, "Plain words of a short text", "a"), (2, None, "a"), (3, "", None), (4, " \t\n ", "b"), (None, "no id here at all", "b"),
    (5, LONG, "a"), (6, GIANT, "c"), (7, "é ü ß 漢字 😀 \x85 \xa0 words", None), (8, LONG, "a"), (None, None, None), (9, "one", "a"),
]
SCHEMA = "doc_id long, text string, source string, TEXT2 string, n_words string, size int, kept int, host string, component_id string"


def docs(spark):
    return spark.createDataFrame([(*r, "t", "clash", 1, 2, "h", "c") for r in ROWS], SCHEMA).withColumnRenamed("TEXT2", "Text")


def none(spark):
    return docs(spark).limit(0)


def spaced(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
