from collections import Counter

import numpy as np
import odd
import pytest
from riskframe.llm import quality as Q


def brute(text):
    words, lines = odd.spaced(text), (text or "").split("\n")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    spoken = [x for x in lines if odd.spaced(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(spoken) - len(set(spoken)), len(covered)


def test_counts_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = Q.judge(docs, Q.learn(docs, labels)).collect()
    for r in rows:
        n, chars, symbols, dup, repeat = want = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.base_failed and r.kept)
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    clean = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)


def test_rules_are_learned_and_pruned(spark):
    rng = np.random.default_rng(0)
    table = {"symbols": rng.random(3000), "upper": rng.random(3000), "repeats": rng.random(3000)}
    bad = ((table["symbols"] > 0.8) & (table["upper"] > 0.5)) | (table["repeats"] > 0.9)
    rules = Q.cover(table, bad)
    hit = np.zeros(3000, dtype=bool)
    for rule in rules:
        hit |= Q._hits(rule, table, 3000)
    assert (hit == bad).mean() > 0.97 and all(len(r) <= Q.MAX_CONDITIONS for r in rules)
    assert Q.cover(table, np.zeros(3000, dtype=bool)) == [] and Q.cover({"x": np.zeros(0)}, np.zeros(0, dtype=bool)) == []


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = Q.judge(docs.join(rest, "doc_id"), Q.learn(docs, fit)).collect()
    right = np.mean([r.kept == (r.quality == 1) for r in rows if not r.base_failed])
    assert right > 0.95


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1)], "doc_id long, quality int")
    got = Q.judge(odd.docs(spark), Q.learn(odd.docs(spark), labels)).collect()
    assert len(got) == len(odd.ROWS) and got[0].Text == "t"
    assert all(not r.kept for r in got if r.doc_id in (1, 2, 3, 4, 6, 9))
    assert Q.judge(odd.none(spark), []).count() == 0
    assert Q.learn(odd.docs(spark), labels.limit(0)) == []


@pytest.mark.parametrize("text", ["a\n\na\n \na", "x y\nx y\n x y", "#*$%&|<>é#", " a b c d e a b c d e f"])
def test_small_texts(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    assert tuple(int(c[0]) for c in Q.count_slice(data, np.array([0, len(data)]))[:5]) == brute(text)
