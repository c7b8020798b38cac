import hashlib
import math
import random

import duckdb
import numpy as np
import odd  # noqa: F401  (the folder's helpers are on the path)
from riskframe.llm import centroids as C


def brute(rows, k=8, rounds=10):
    """Plain Python over whole numbers."""
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e):
            x = [math.floor(1024 * float(np.float32(v))) for v in e]
            if max(map(abs, x)) <= C.MOST:
                kept.append((vec_id, x))
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centroids = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    out = [(vec_id, *nearest(x)) for vec_id, x in kept]
    inertia = {j: sum(d for _, d, c in out if c == j) for j in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((v, c, d, inertia[c], sum(inertia.values()), digest[c]) for v, d, c in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_brute_force_with_ties_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 7)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.0, 1e-4, rng.gauss(0, 0.2)]) for _ in range(64)]) for i in range(90)]
    rows += [(i, list(rows[5][1])) for i in (5, 200, 201, None, None)]  # copies, one id twice, and no id
    rows += [(300, None), (301, []), (302, [0.1] * 63), (303, [0.1] * 63 + [None]), (304, [float("nan")] + [0.1] * 63), (305, [float("inf")] + [0.0] * 63), (306, [3e38] + [0.0] * 63), (307, [131072.0] + [0.0] * 63), (308, [-0.0] * 64)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, cluster string, Distance int")
    want = brute(rows)
    assert got(C.report(*C.cluster(df))) == want
    assert got(C.report(*C.cluster(df.repartition(11)))) == want
    few = [r for r in rows if r[0] in (1, 2, 3)]
    assert got(C.report(*C.cluster(spark.createDataFrame(few, "vec_id long, embedding array<float>")))) == brute(few)
    assert C.report(*C.cluster(df.limit(0))).count() == 0


def test_against_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    found = con.execute(C.ORACLE)
    df = C.query(spark, data)
    assert df.columns == [d[0] for d in found.description]
    assert got(df) == sorted(found.fetchall(), key=repr)
    assert [str(d[1]) for d in found.description] == ["BIGINT", "INTEGER", "BIGINT", "BIGINT", "BIGINT", "VARCHAR"] and [k for _, k in df.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]


def test_tables_hold_only_what_occurs():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, (50, 64)).astype(np.int32)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(vectors.tolist(), type=pa.list_(pa.int32()))], names=["vec_id", "x"])
    (packed,) = C._pack(64, 4096)(iter([batch]))
    ((_, block),) = C._blocks(iter([packed]), 64)
    assert all(len(v) <= 7 for v in block.values)
    centroids = rng.integers(-9, 9, (8, 64))
    assert (block.distances(centroids) == ((vectors[None] - centroids[:, None]) ** 2).sum(2)).all()
