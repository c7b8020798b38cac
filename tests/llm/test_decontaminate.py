import hashlib
import random
import re

import odd
from riskframe.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(texts, items, n=13):
    split = lambda t: WORD.findall(odd.lower(t))
    windows = [(i, w[k : k + n]) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - n + 1))]
    for t in texts:
        words = split(t)
        hit, found = set(), set()
        for item, w in windows:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
                    found.add(item)
        found = sorted(str(i) for i in found)
        yield len(words), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(words)


def test_against_brute_force_in_one_and_in_several_blocks(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["the", "of", "Über", "x1", "to,", "and"]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 12, 13, 14, 30]))) for i in range(12)] + [(3, None), (None, say(14))]
    texts = [say(rng.randrange(0, 60)) for _ in range(40)] + [f"{say(20)} {items[5][1].upper()} {say(9)}", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = {i: r for i, r in enumerate(brute(texts, [x for x in items if x[0] is not None]))}
    for rows in (10**6, 40):
        got = D.scan(docs, bench.where("item_id is not null"), block_rows=rows).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want


def test_each_block_is_a_job_of_its_own(spark, capsys):
    """Forty blocks, also for repeated rows and items: the last plan reads tables and has one Python step."""
    item = " ".join(f"w{i}" for i in range(52))
    docs = spark.createDataFrame([(i, f"{item} x{i}" if i % 2 else None) for i in range(20)] + [(1, item)] * 3, "doc_id int, text string").repartition(3)
    bench = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id int, text string")
    found = D.scan(docs, bench, block_rows=2)
    found.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    got = sorted(map(str, found.drop("items").collect()))
    assert got == sorted(map(str, D.scan(docs, bench).drop("items").collect())) and len(got) == 23
    assert {r.n_hit for r in found.collect()} == {0, 52} and {tuple(r["items"]) for r in found.collect()} == {(), ("1", "2")}


def test_removal_of_spans_and_documents(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"é before, {item}! after", "k"), (2, "clean words", "k"), (3, None, "k")], "doc_id int, text string, n_hit string")
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    spans = {r.doc_id: r for r in D.decontaminate(docs, bench, remove="spans").collect()}
    assert spans[1].text == "é before, ! after" and spans[2].text == "clean words" and spans[3].text is None and spans[1].n_hit == "k"
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "one"), (2, None), (None, "short text")], "item_id int, text string")
    got = D.scan(odd.docs(spark), bench).collect()
    assert len(got) == len(odd.ROWS)
    assert {r.doc_id: r.n_hit for r in got if r.doc_id in (2, 3, 4, 9)} == {2: 0, 3: 0, 4: 0, 9: 1}
    assert [r.n_items for r in got if r.doc_id == 1] == [0, 0] and [r.n_hit for r in got if r.doc_id == 1] == [2, 2]
    assert D.scan(odd.none(spark), bench).count() == 0
    assert D.scan(odd.docs(spark), bench.limit(0)).where("n_hit > 0").count() == 0
