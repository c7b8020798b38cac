import hashlib
import re
from datetime import date

import odd
from pyspark.sql import functions as F
from riskframe.llm import pseudonyms as P


def shift(text, digest):
    out = []
    for i, c in enumerate(text):
        at = i * 3 % 60
        by = int(digest[at : at + 4], 16)
        for first, n in ((48, 10), (97, 26), (65, 26)):
            if first <= ord(c) < first + n:
                c = chr((ord(c) - first + by) % n + first)
                break
        out.append(c)
    return "".join(out)


def feistel(text, key, tweak):
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for n in range(1, P.ROUNDS + 1):
        left = shift(left, hashlib.sha256(f"{key}|{tweak}|l|{n}|{right}".encode()).hexdigest())
        right = shift(right, hashlib.sha256(f"{key}|{tweak}|r|{n}|{left}".encode()).hexdigest())
    return left + right


def luhn(number):
    digits = [int(c) for c in reversed(re.sub("[^0-9]", "", number))]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def iban(number):
    bare = number.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def run(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text for r in P.pseudonymise(rows, key=key).collect()}
    return [got[i] for i in range(len(texts))]


def test_strings_as_brute_force_and_one_to_one(spark):
    values = [f"{i:03d}" for i in range(1000)] + ["a", "ab", "Zz.9-x", "", "é1"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", P.feistel_string(F.col("v"), "k", "t").alias("n")).collect()
    assert all(r.n == feistel(r.v, "k", "t") for r in got)
    assert len({r.n for r in got if len(r.v) == 3 and r.v.isdigit()}) == 1000


def test_numbers_are_permuted(spark):
    got = [r[0] for r in spark.range(0, 2990).select(P.feistel_number(F.col("id"), 65, 46, "k", "t")).collect()]
    assert sorted(got) == list(range(2990)) and got != list(range(2990))


def test_formats_hold_and_equal_values_stay_linked(spark):
    texts = ["a 4111 1111 1111 1111 b 4111111111111112", "x4111-1111-1111-1111", "4111-1111-1111-1111, 4111-1111-1111-1111.", "GB82 WEST 1234 5698 7654 32", "2024-02-29 and 29.02.2024 and 02/29/2024 and 2023-02-29",
             "123-45-6789 and 000-12-3456", "10.1.2.255 and 1.2.3 and 300.1.1.1", "+1 (017) 555-7713 / (017) 555-7713", "und.34@mail7.example.com", "UND.34@mail7.example.com"]
    got = run(spark, texts)
    assert luhn(got[0][2:21]) and got[0][2:21] != texts[0][2:21] and got[0].endswith("b 4111111111111112") and re.fullmatch(r"a \d{4} \d{4} \d{4} \d{4} b \d{16}", got[0])
    assert got[1] == texts[1] and len(set(got[2].rstrip(".").split(", "))) == 1 and re.sub(r"\D", "", got[2][:19]) == re.sub(r"\D", "", got[0][2:21])
    assert iban(got[3]) and got[3] != texts[3] and re.fullmatch(r"GB\d\d [A-Z]{4}( \d{4}){3} \d\d", got[3])
    iso, points, slash, wrong = re.fullmatch(r"(\S+) and (\S+) and (\S+) and (\S+)", got[4]).groups()
    day = date.fromisoformat(iso)
    assert wrong == "2023-02-29" and points == day.strftime("%d.%m.%Y") and slash == day.strftime("%m/%d/%Y") and iso != "2024-02-29"
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4} and 000-12-3456", got[5]) and got[5][:11] != "123-45-6789"
    assert re.fullmatch(r"(\d{1,3})(\.\d{1,3}){3} and 1\.2\.3 and 300\.1\.1\.1", got[6]) and all(int(x) < 256 for x in got[6].split(" ")[0].split("."))
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} / \(\d{3}\) \d{3}-\d{4}", got[7]) and "555-7713" not in got[7]
    assert got[8].endswith(".example.com") and got[8] != texts[8] and got[9] != got[8]
    assert run(spark, texts, key="other") != got and run(spark, texts) == got


def test_dates_and_numbers_one_to_one(spark):
    days = spark.range(0, 3000).select(F.date_format(F.date_add(F.lit("1999-06-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    got = [r.text for r in P.pseudonymise(days).collect()]
    assert len(set(got)) == 3000 and all(date.fromisoformat(x).year in range(1900, 2101) for x in got)


def test_all_planted_data_change(spark, data):
    seen = {}
    pattern = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])|(?<!\w)\d{16}(?!\w)")
    rows = P.pseudonymise(spark.read.parquet(f"{data}/documents.parquet").withColumnRenamed("text", "was").withColumn("text", F.col("was"))).collect()
    for r in rows:
        a, b = pattern.findall(r.was), pattern.findall(r.text)
        assert len(a) == len(b) and pattern.sub("_", r.was) == pattern.sub("_", r.text)
        for x, y in zip(a, b):
            private = "@" in x or "(" in x or ("." in x and all(int(p) < 256 for p in x.split("."))) or (x.isdigit() and luhn(x))
            assert (x != y) == private and seen.setdefault(x, y) == y


def test_odd_rows_and_plan(spark, data, capsys):
    got = P.pseudonymise(odd.docs(spark)).collect()
    assert sorted(str(r.text) for r in got) == sorted(str(r[1]) for r in odd.ROWS) and got[0].Text == "t"
    assert P.pseudonymise(odd.none(spark)).count() == 0
    P.query(spark, data).explain()
    shown = capsys.readouterr().out
    assert "Python" not in shown and "Arrow" not in shown and "Exchange" not in shown


def test_the_key_is_the_callers(spark):
    """No key stands in the code: the session's setting counts, and without one a key that is drawn for the process."""
    texts = ["write to jane.doe@example.org or call", "card 4111111111111111"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    of = lambda **k: [r.text for r in P.pseudonymise(rows, **k).orderBy("doc_id").collect()]
    drawn = of()
    assert drawn == of() != texts
    spark.conf.set(P.KEY_SETTING, "a secret")
    try:
        assert of() == of(key="a secret") != drawn
    finally:
        spark.conf.unset(P.KEY_SETTING)
    assert of() == drawn and not hasattr(P, "KEY")
