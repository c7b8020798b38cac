"""Format-preserving pseudonyms for personal data, with DataFrame operations only.

One pattern finds candidates in the whole text; each is validated (Luhn, ISO 7064, calendar,
octets, number plan) and then permuted within its own format by a keyed Feistel network, so that
equal values stay equal across documents and different values stay different:

- strings of digits and letters: two halves shift each other's characters within their class;
  payment cards get a fresh Luhn digit and IBANs fresh check digits;
- numbers with a fixed domain (addresses of the internet, social security numbers, dates): a Feistel
  network over the product of two ranges that is exactly the domain, so no value leaves it.

What fails its validation isn't personal data by these rules and stays as it is.

Defined results for odd input:
- a null text stays null; a text without candidates stays as it is, down to the byte;
- dates are permuted within their own 200 years (73,000 days from 1900-01-01, and blocks of as many
  days before and after), so every date of four-digit years keeps a valid form;
- repeated documents give equal results; extra columns are passed on.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.frames import column_index, numbered, pick, table, with_results

#: The session's setting with the key, a secret of the caller's: whoever knows it can undo the permutation.
KEY_SETTING = "spark.riskframe.pseudonyms.key"
#: Where nobody has set one: a key drawn for this driver process, so that all that it writes is linked, and nobody has it afterwards.
_OWN_KEY = os.urandom(24).hex()
ROUNDS = 4
DAYS = (292, 250)  # their product is 73,000 days, near 200 years
EPOCH = "1900-01-01"
KINDS = ("email", "card", "iban", "ssn", "ip", "date", "phone")

_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IBAN = _EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END
CARD = _EDGE + r"(?<![0-9][.-])[0-9](?:[ -]?[0-9]){12,18}" + _END
SSN = _EDGE + r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-)" + _END
IP = _EDGE + r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9])" + _END
DATE = _EDGE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + _END
PHONE = r"(?:(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}|" + _EDGE + r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})" + _END
#: The first that fits at a place wins.
CANDIDATE = "|".join((EMAIL, IBAN, SSN, IP, DATE, CARD, PHONE))
#: Whatever holds a candidate holds one of these; it is much cheaper to look for.
GATE = r"@|[0-9][0-9 .()/-]{5}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]"


def _number(text: Column, most: int | Column) -> Column:
    """A keyed pseudo-random number from 0 to most - 1 for a string."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long"), F.lit(most) if isinstance(most, int) else most)


def feistel_number(value: Column, a: int, b: int, key: str, tweak: str) -> Column:
    """A permutation of 0 .. a * b - 1."""
    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))

    def turn(acc: Column, n: Column) -> Column:
        f = lambda side, other, most: F.pmod(acc[side] + _number(F.concat_ws("|", F.lit(f"{key}|{tweak}|{side}"), n.cast("string"), other.cast("string")), most), F.lit(most))
        left = f("l", acc["r"], a)
        return F.struct(left.alias("l"), f("r", left, b).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * b + s["r"])


def _shift(text: Column, digest: Column) -> Column:
    """Each letter and digit moved within its class by an amount from the digest."""
    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, F.pmod(i * 3, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(c)
        moved = lambda first, n: F.chr(F.pmod(code - first + by, F.lit(n)) + first)
        return F.when(code.between(48, 57), moved(48, 10)).when(code.between(97, 122), moved(97, 26)).when(code.between(65, 90), moved(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def feistel_string(text: Column, key: str, tweak: str) -> Column:
    """A permutation of the strings of one format: the same classes of characters in the same places."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def turn(acc: Column, n: Column) -> Column:
        digest = lambda side, other: F.sha2(F.concat_ws("|", F.lit(f"{key}|{tweak}|{side}"), n.cast("string"), other), 256)
        left = _shift(acc["l"], digest("l", acc["r"]))
        return F.struct(left.alias("l"), _shift(acc["r"], digest("r", left)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number whose last digit counts once."""
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(i, F.lit(2)) == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), worth), F.lit(0), lambda a, x: a + x)


def is_card(text: Column) -> Column:
    return text.rlike(f"^{CARD}$") & (F.pmod(luhn_sum(_digits(text)), F.lit(10)) == 0) & ~_digits(text).rlike("^0+$")


def mod97(text: Column) -> Column:
    """Remainder of the number that letters and digits spell in ISO 7064 (A is 10)."""
    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def is_iban(text: Column) -> Column:
    bare = F.replace(text, F.lit(" "), F.lit(""))
    return text.rlike(f"^{IBAN}$") & (mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1)


def _parts(text: Column, sep: str) -> list[Column]:
    return [F.element_at(F.split(text, sep), i + 1).cast("int") for i in range(4)]


def is_ip(text: Column) -> Column:
    return text.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}(?<!\.)$")


def is_ssn(text: Column) -> Column:
    return text.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def as_date(text: Column) -> Column:
    """Day first for points; for slashes the month first unless it can only be the day. Null if it is no date."""
    n = lambda a, size: F.substring(text, a, size).cast("int")
    iso = F.when(text.rlike(r"^[0-9]{4}-"), F.expr("true"))
    y, m, d = (F.when(iso, n(*x)).otherwise(n(*z)) for x, z in zip(((1, 4), (6, 2), (9, 2)), ((7, 4), (1, 2), (4, 2))))
    day_first = text.rlike(r"^[0-9]{2}\.") | (text.rlike("/") & (n(1, 2) > 12))
    m, d = F.when(day_first, n(4, 2)).otherwise(m), F.when(day_first, n(1, 2)).otherwise(d)
    made = F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    return F.when(text.rlike(f"^{DATE}$") & (y > 0), made)


def _new_email(text: Column, key: str) -> Column:
    """The local part and all but the last two labels of the host."""
    head, tail = F.regexp_extract(text, r"^(.*?)([A-Za-z0-9-]+\.[A-Za-z]+)$", 1), F.regexp_extract(text, r"^(.*?)([A-Za-z0-9-]+\.[A-Za-z]+)$", 2)
    return F.concat(feistel_string(head, key, "email"), tail)


def _spread(digits: Column, pattern: Column) -> Column:
    """Put digits into the places that digits have in a pattern."""
    place = F.filter(F.split(pattern, ""), lambda c: c != "")
    done = F.aggregate(place, F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), lambda a, c: F.when(c.rlike("^[0-9A-Za-z]$"), F.struct(F.concat(a["s"], F.substring(digits, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))), lambda a: a["s"])
    return done


def _new_card(text: Column, key: str) -> Column:
    digits = _digits(text)
    moved = F.transform(F.array(feistel_string(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")), lambda p: F.concat(p, F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
    return _spread(moved[0], text)


def _new_iban(text: Column, key: str) -> Column:
    bare = F.replace(text, F.lit(" "), F.lit(""))
    land = F.substring(bare, 1, 2)
    whole = F.transform(F.array(feistel_string(F.substring(bare, F.lit(5), F.length(bare)), key, "iban")), lambda p: F.concat(land, F.lpad((F.lit(98) - mod97(F.concat(p, land, F.lit("00")))).cast("string"), 2, "0"), p))
    return _spread(whole[0], text)


def _new_ip(text: Column, key: str) -> Column:
    a, b, c, d = (p.cast("long") for p in _parts(text, r"\."))
    moved = F.transform(F.array(feistel_number(((a * 256 + b) * 256 + c) * 256 + d, 1 << 16, 1 << 16, key, "ip")), lambda v: F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))
    return moved[0]


def _new_ssn(text: Column, key: str) -> Column:
    """899 areas less one, 99 groups, 9,999 serials."""
    area, group, serial = (F.substring(text, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    def spell(v: Column) -> Column:
        r = F.floor(v / (99 * 9999))
        return F.format_string("%03d-%02d-%04d", (r + 1 + F.when(r >= 665, 1).otherwise(0)).cast("int"), (F.pmod(F.floor(v / 9999), F.lit(99)) + 1).cast("int"), (F.pmod(v, F.lit(9999)) + 1).cast("int"))

    return F.transform(F.array(feistel_number((rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")), spell)[0]


def _new_date(text: Column, key: str) -> Column:
    size = DAYS[0] * DAYS[1]
    day = F.datediff(as_date(text), F.lit(EPOCH).cast("date")).cast("long")
    block = F.floor(day / size).cast("long")
    iso, points = text.rlike(r"^[0-9]{4}-"), text.rlike(r"\.")
    day_first = points | (text.rlike("/") & (F.substring(text, 1, 2).cast("int") > 12))

    def spell(v: Column) -> Column:
        made = F.date_add(F.lit(EPOCH).cast("date"), (v + block * size).cast("int"))
        written = F.when(iso, F.date_format(made, "yyyy-MM-dd")).when(points, F.date_format(made, "dd.MM.yyyy"))
        return written.when(day_first, F.date_format(made, "dd/MM/yyyy")).otherwise(F.date_format(made, "MM/dd/yyyy"))

    return F.transform(F.array(feistel_number(F.pmod(day, F.lit(size)), *DAYS, key, "date")), spell)[0]


def _new_phone(text: Column, key: str) -> Column:
    """The country code stays."""
    land = F.regexp_extract(text, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 1)
    return F.concat(land, feistel_string(F.substring(text, F.length(land) + 1, F.length(text)), key, "phone"))


def kind_of(text: Column) -> Column:
    """The kind of a candidate that holds its validation, else null."""
    out = F.when(F.contains(text, F.lit("@")), "email").when(is_ip(text), "ip").when(is_ssn(text), "ssn").when(as_date(text).isNotNull(), "date")
    return out.when(is_card(text), "card").when(is_iban(text), "iban").when(text.rlike(f"^{PHONE}$") & F.length(_digits(text)).between(8, 15), "phone")


def replaced(text: Column, kind: Column, key: str) -> Column:
    out = F.when(kind == "email", _new_email(text, key)).when(kind == "ip", _new_ip(text, key)).when(kind == "ssn", _new_ssn(text, key)).when(kind == "date", _new_date(text, key))
    return out.when(kind == "card", _new_card(text, key)).when(kind == "iban", _new_iban(text, key)).when(kind == "phone", _new_phone(text, key)).otherwise(text)


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or _OWN_KEY


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None, counts: bool = True, length: str | None = None) -> DataFrame:
    """docs with personal data replaced in the text, and (on demand) pii_found, a count of each kind found.

    ``length`` names a column that holds the text's code points, which then follows the new text. Without a ``key`` the
    session's setting counts; runs that are to be linked across driver processes need one."""
    key = key or session_key(docs.sparkSession)
    df, names = numbered(docs)
    body = f"c{column_index(docs, text)}"
    value = F.col(body).cast("string")
    found = F.when(value.rlike(GATE), F.regexp_extract_all(value, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("found", F.transform(found, lambda m: F.struct(m.alias("was"), kind_of(m).alias("kind"))))
    df = df.withColumn("found", F.transform("found", lambda m: F.struct(m["kind"].alias("kind"), replaced(m["was"], m["kind"], key).alias("now"))))
    gaps = F.split(value, CANDIDATE, -1)
    whole = F.zip_with(gaps, F.col("found"), lambda g, m: F.concat(g, F.coalesce(m["now"], F.lit(""))))
    df = df.withColumn(body, F.when(F.exists("found", lambda m: m["kind"].isNotNull()), F.array_join(whole, "")).otherwise(value))
    if length is not None:
        df = df.withColumn(f"c{column_index(docs, length)}", F.char_length(body).cast("long"))
    if not counts:
        return df.drop("found").toDF(*names)
    per_kind = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*[F.size(F.filter("found", lambda m: m["kind"] == k)).cast("long") for k in KINDS]))  # noqa: B023
    return with_results(df.withColumn("pii_found", F.coalesce(per_kind, F.lit(None))), names, ["pii_found"])


def query(spark, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = pseudonymise(docs)
    return found.select("doc_id", "text", *[F.col("pii_found")[k].alias(f"n_{k}") for k in KINDS])
