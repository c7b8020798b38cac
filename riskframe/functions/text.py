"""Text expressions. White space means the Unicode set, not only ASCII."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.limits import REDACTED
from riskframe.schemas import CONTENT_COLUMNS

# The characters counted as white space, as the inside of a character class.
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The same characters as one string, for trimming without a regular expression.
WS_CHARS = "".join(
    chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B))
) + "".join(chr(c) for c in (0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
SENTINEL = chr(1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def lstrip_ws(c: Column) -> Column:
    return F.ltrim(c, F.lit(WS_CHARS))


def rstrip_ws(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip_ws(c) == "")


def first_line(c: Column) -> Column:
    return strip_ws(F.split_part(c, F.lit("\n"), F.lit(1)))


def head(c: Column, n: int | None) -> Column:
    return c if n is None else F.substring(c, 1, n)


def sanitise(c: Column, max_chars: int | None = None) -> Column:
    """Cut (optional), drop NUL, one blank per white-space run, drop unprintables, strip."""
    cut = F.replace(head(c, max_chars), F.lit(chr(0)), F.lit(""))
    flat = F.regexp_replace(cut, f"[{WS}]+", " ")
    return F.trim(F.regexp_replace(flat, r"\p{C}", ""))


def locked_prompt(user: Column, system: Column, guard: str, max_chars: int | None = None) -> Column:
    """System text followed by a guard text, paired with the sanitised user text."""
    return F.struct(
        F.concat(system, F.lit("\n\n"), F.lit(guard)).alias("system_text"),
        sanitise(user, max_chars).alias("user_text"),
    )


def fill_template(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace ``{name}`` variables; the error field names variables left unfilled.

    Values are put in behind a sentinel brace so that braces inside them are not read
    as variables.
    """
    left = F.lit(chr(2))
    known = "|".join(values) or chr(3)
    missing = F.array_distinct(
        F.filter(
            F.regexp_extract_all(template, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)\}"), F.lit(1)),
            lambda name: ~name.rlike(rf"\A(?:{known})\z"),
        )
    )
    text = template
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.replace(value, F.lit("{"), left))
    text = F.replace(text, left, F.lit("{"))
    return F.struct(
        F.when(F.size(missing) == 0, text).alias("text"),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ","))).alias("error"),
    )


def html_escape(c: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def file_extension(name: Column) -> Column:
    """Lower-cased extension with its dot, empty if there is none."""
    return F.regexp_extract(F.lower(name), r"(?s)(\.[^.]*)\z", 1)


def title_from_stem(path: Column, max_chars: int | None = None) -> Column:
    """File name without folder and last extension, ``_`` and ``-`` as blanks."""
    name = F.regexp_replace(path, r"(?s)\A.*/", "")
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*\z", "")
    return head(F.translate(stem, "_-", "  "), max_chars)


def snippet(c: Column, max_chars: int | None = None) -> Column:
    """Stripped text, whole unless a limit is asked for; a cut text ends in three dots."""
    if max_chars is None:
        return strip_ws(c)
    return let(
        strip_ws(c),
        lambda text: F.when(
            F.char_length(text) > max_chars, F.concat(rstrip_ws(F.substring(text, 1, max_chars)), F.lit("..."))
        ).otherwise(text),
    )


def redact(c: Column, dtype: T.DataType) -> Column:
    """Marker with the size of the hidden value, by kind."""

    def marker(label: str, size: Column) -> Column:
        return F.concat(F.lit(f"{REDACTED}({label}="), size.cast("string"), F.lit(")"))

    if isinstance(dtype, T.ArrayType):
        out = marker("len", F.size(c))
    elif isinstance(dtype, T.MapType):
        out = marker("keys", F.size(c))
    elif isinstance(dtype, T.StructType):
        out = F.lit(f"{REDACTED}(keys={len(dtype.fields)})")
    elif isinstance(dtype, T.BinaryType):
        out = marker("bytes", F.octet_length(c))
    elif isinstance(dtype, T.StringType):
        out = marker("chars", F.char_length(c))
    else:
        out = F.lit(REDACTED)
    return F.when(c.isNull(), F.lit(REDACTED)).otherwise(out)


def redact_frame(df, sensitive: Sequence[str] = CONTENT_COLUMNS):
    """Replace content-bearing columns by their markers, leave the others."""
    hide = set(sensitive)
    return df.select(
        *(redact(F.col(f.name), f.dataType).alias(f.name) if f.name in hide else F.col(f.name) for f in df.schema)
    )


def in_list(c: Column, allowed: Sequence[str]) -> Column:
    """Upper-cased, stripped enum value; anything else (also NULL) becomes UNKNOWN."""
    value = strip_ws(F.upper(c))
    return F.when(value.isin(*allowed), value).otherwise(F.lit("UNKNOWN"))
