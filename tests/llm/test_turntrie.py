import hashlib
import random
import re
import zlib

import duckdb
import pytest
from riskframe.llm import turntrie as R


def brute(rows):
    """Plain Python over whole prefixes; rows are (conv_id, turn, role, text)."""
    digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32]
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append(((t is not None, t or 0, digest(r, x)), (r, x)))
    own = {c: [p for _, p in sorted(v)] for c, v in own.items()}
    members, ends = {(): []}, {}
    if not own:
        return []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(own.get(first, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p in members:
        under, left = [], [p]
        while left:
            q = left.pop()
            under.append(q)
            left += children.get(q, [])
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), sum(q not in children for q in under), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows(seed, n=150):
    rng = random.Random(seed)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["hello", "two words", "", None, " a\tb\nc ", "é 漢"]))
    out = []
    for c in rng.sample(range(-60, 400), n):
        out += [(c, rng.choice([None, k, k, 2]), *say()) for k in range(rng.choice([1, 1, 2, 3, 5, 9]))]
    common = [say() for _ in range(5)]
    for c in range(1000, 1000 + n):  # a hot group: all turns but the family's are equal
        out += [(c, k, *t) for k, t in enumerate(common)]
    return out + [(2000, k, "user", f"word {k}") for k in range(700)] + [(2001, k, "user", f"word {k}") for k in range(700)] + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 7), (3, 60), (4, 211)])
def test_against_brute_force_over_few_and_many_shards(spark, seed, partitions):
    mine = rows(seed)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "clash", 1) for r in mine], "conv_id long, turn long, role string, text string, depth string, n_convs int")
        want = brute(mine)
        assert got(R.trie(df)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_children_of_boundary_nodes_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_NODES", 0)
    mine = rows(5)
    assert got(R.trie(spark.createDataFrame(mine, "conv_id long, turn int, role string, text string"))) == brute(mine)


def test_against_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    found = con.execute(R.ORACLE)
    df = R.query(spark, data)
    assert sorted(df.columns) == sorted(d[0] for d in found.description) and [str(d[1]) for d in found.description][:-1] == ["BIGINT"] * 7
    assert got(df.select(*[d[0] for d in found.description])) == sorted(found.fetchall(), key=repr)


def test_odd_tables(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert R.trie(spark.createDataFrame([], shape)).count() == 0
    assert R.trie(spark.createDataFrame([(None, 0, "user", "x")], shape)).count() == 0
    lone = [(7, None, None, None)]  # crc32 decides whether its only turn is given away to an absent conversation
    assert got(R.trie(spark.createDataFrame(lone, shape))) == brute(lone)
    long = [(20, 0, "user", "x" * 2_000_000), (20, 1, "user", "a b " * 400_000), (21, 0, "user", "x" * 2_000_000)]
    assert got(R.trie(spark.createDataFrame(long, shape))) == brute(long)


def test_the_middle_comes_first():
    assert sorted(R.middle_first(1000)) == list(range(1000)) and next(R.middle_first(1000)) == 500
    tree = R.Tree()
    for k in R.middle_first(1023):
        tree.insert([k])
    deep, open_ = 0, [(tree.middle[0], 1)]
    while open_:
        node, d = open_.pop()
        deep = max(deep, d)
        open_ += [(s, d + 1) for s in (tree.low[node], tree.high[node]) if s]
    assert deep == 10
