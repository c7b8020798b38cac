import random

import numpy as np
import odd
import xxhash
from riskframe.llm import simhash as S

MASK = (1 << 64) - 1


def fingerprint(text, n=3):
    words = odd.spaced(odd.lower(text))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles))


def joined(nodes, near):
    """The smallest member of each node's component, all pairs compared."""
    top = {x: x for x in nodes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {x: root(x) for x in nodes}


def test_documents_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = S.near_duplicates(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    prints = {d: fingerprint(t) for d, t in text.items()}
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == joined(sorted(text), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    kept = S.keep_one(docs, similarity=None)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got})


def test_links_of_crowds_and_chains(spark):
    rng = random.Random(2)
    flip = lambda x, n: x ^ sum(1 << k for k in rng.sample(range(64), n))
    found = {rng.getrandbits(64) for _ in range(40)}
    for start in list(found)[:20]:
        found |= {flip(start, rng.randrange(1, 4)) for _ in range(5)}
    crowd = rng.getrandbits(64)
    found |= {crowd} | {flip(crowd, rng.randrange(1, 5)) for _ in range(250)}
    step = rng.getrandbits(64)
    for _ in range(30):
        step = flip(step, 2)
        found.add(step)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in found)
    want = joined(signed, lambda a, b: bin((a ^ b) & MASK).count("1") <= 2)
    rows = S.components(S.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    got = {x: x for x in signed} | {r.node: r.root for r in rows}
    assert got == want


def jaccard(a, b, n=5):
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (odd.spaced(odd.lower(a)), odd.spaced(odd.lower(b)))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_are_found_and_others_stay(spark):
    """Copies with a few words changed: every pair of 0.8 or more is linked, none below it is."""
    rng = random.Random(11)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, line = [], say(30)
    for _ in range(25):
        source = say(rng.choice([60, 90, 200, 500]))
        rows.append(source)
        for _ in range(rng.randrange(0, 7)):
            copy = list(source)
            for _ in range(rng.randrange(0, max(2, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(["changed", "other", "new"])
            rows.append(copy + say(rng.choice([0, 0, 2])))
    rows += [say(70) + line for _ in range(30)]
    rng.shuffle(rows)
    text = {i: " ".join(w) for i, w in enumerate(rows)}
    prints = {i: fingerprint(t) for i, t in text.items()}
    want = joined(sorted(text), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2 or jaccard(text[a], text[b]) >= 0.8)
    docs = spark.createDataFrame(sorted(text.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == sorted(set(want.values()))
    assert sorted(r.doc_id for r in S.keep_one(docs, similarity=None).collect()) != sorted(set(want.values()))


def kept_by_brute_force(text):
    """The smallest id of each component over all pairs within two bits or of 0.8 and more."""
    prints = {i: fingerprint(t) for i, t in text.items()}
    want = joined(sorted(text), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2 or jaccard(text[a], text[b]) >= 0.8)
    return sorted(set(want.values()))


def test_a_large_group_of_edited_copies_without_its_source(spark):
    """Lists of hundreds of equally long texts that resemble each other in pairs that no order shows."""
    rng = random.Random(5)
    source, text = [f"w{rng.randrange(3000)}" for _ in range(120)], {}
    for i in range(300):
        copy = list(source)
        for at in rng.sample(range(len(copy)), 2):
            copy[at] = f"new{rng.randrange(10**6)}"
        text[i] = " ".join(copy)
    docs = spark.createDataFrame(sorted(text.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == kept_by_brute_force(text)


def test_blocks_of_a_list_meet(spark, monkeypatch):
    from riskframe.llm import resemblance

    monkeypatch.setattr(resemblance, "BLOCK", 3)
    test_a_large_group_of_edited_copies_without_its_source(spark)


def test_short_near_copies_are_found(spark):
    """Texts of 8 to 50 words with a word changed or added at an edge or dropped within."""
    rng = random.Random(7)
    rows = []
    for size in range(4, 51):
        for _ in range(6):
            source = [f"w{rng.randrange(30000)}" for _ in range(size)]
            rows += [source, rng.choice([[*source, "more"], ["more", *source], [*source[:-1], "more"], ["more", *source[1:]], [*source[: size // 2], *source[size // 2 + 1 :]], [*source[1:], *source[:1]]])]
    rows += [["b", "a"], ["a", "b"]]
    rng.shuffle(rows)
    text = {i: " ".join(w) for i, w in enumerate(rows)}
    docs = spark.createDataFrame(sorted(text.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == kept_by_brute_force(text)


def test_texts_with_repeated_phrases(spark):
    """Alike by their sets, though their fingerprints differ in many bits and no run of 25 words need be the same."""
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, body = [], say(120)
    rows += [body + [f"{side}{k}" for k in range(5)] * 300 for side in "ab"]
    lines = [["start", "of", "the", "entry", *say(10), "end", "of", "the", "entry"] for _ in range(60)]
    rows += [[w for line in lines for w in [*line, mark]] for mark in ("--", "**", "--")]  # another mark behind each line
    rows += [[w for line in lines[:30] for w in [*line, "--"]], say(120), say(1000)]
    text = {i: " ".join(w) for i, w in enumerate(rows)}
    assert jaccard(text[0], text[1]) >= 0.8 and jaccard(text[2], text[3]) >= 0.8 > jaccard(text[2], text[5])
    assert bin(fingerprint(text[0]) ^ fingerprint(text[1])).count("1") > 24
    docs = spark.createDataFrame(sorted(text.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == kept_by_brute_force(text)


def test_prefixes_and_sketches_leave_no_alike_pair_out():
    from riskframe.llm import resemblance as R

    rng = np.random.default_rng(6)
    for _ in range(400):
        n, often = int(rng.choice([1, 2, 3, 5, 9, 20, 64, 65, 300, 1500])), np.unique(rng.integers(0, 400, 60, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        pool = np.unique(rng.integers(0, 4000, 4 * n, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        a = np.sort(rng.permutation(pool)[:n])
        keep = a[rng.random(len(a)) > rng.choice([0.0, 0.05, 0.1, 0.2, 0.3])]
        b = np.unique(np.concatenate((keep, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 5)), dtype=np.uint64))))
        if not len(b):
            continue
        different = len(np.setxor1d(a, b))
        assert R.at_least_different(R.sketch(a), R.sketch(b)) <= different
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            p, q = (R.prefix(x, often, 0.8).tolist() for x in (a, b))
            shared = next(x for x in p if x in set(q))
            left = 1 + min(len(a) - p.index(shared) - 1, len(b) - q.index(shared) - 1)
            assert left >= (len(a) + len(b)) * 0.8 / 1.8 - 1e-9


def test_joins_beyond_the_broadcast_bound(spark, data, monkeypatch):
    from riskframe.llm import resemblance

    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted(r.doc_id for r in S.keep_one(docs).collect())
    monkeypatch.setattr(resemblance, "BROADCAST_IDS", 0)
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == want


def test_odd_rows(spark):
    got = S.near_duplicates(odd.docs(spark)).collect()
    assert len(got) == len(odd.ROWS)
    empty = [r for r in got if r.fingerprint == "0" * 16]
    assert len(empty) == 4 and {r.component_id for r in empty} == {2}
    assert {r.component_id for r in got if r.doc_id == 8} == {5}
    kept = S.keep_one(odd.docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "5", "6", "7", "9", "None"]
    assert S.near_duplicates(odd.none(spark)).count() == 0 and S.keep_one(odd.none(spark)).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "x y z w v")], "doc_id long, text string")
    assert S.keep_one(nameless).count() == 2
