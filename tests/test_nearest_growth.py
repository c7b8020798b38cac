"""What a Python task holds in a search does not grow with the cells of the index times a batch of queries."""

import numpy as np
from pyspark.sql import functions as F

from riskframe.operators import nearest
from test_class_measures import plan


def test_routes_are_found_in_blocks(spark, tmp_path, monkeypatch):
    """F6, F7, F8: every query carried all cells of its tenant into Python, as objects, ten thousand queries a batch."""
    monkeypatch.setattr(nearest, "ROUTED", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [0, 1, None][i % 3], [float(x) for x in rng.normal(size=4)]) for i in range(400)] + [(400 + i, 0, [1.0, 2.0, 3.0, 4.0]) for i in range(30)]
    chunks = spark.createDataFrame(rows, "chunk_id long, tenant_id long, embedding array<float>")
    queries = chunks.where("chunk_id % 4 = 0").withColumnRenamed("chunk_id", "query_id")
    queries = queries.unionByName(queries.where("query_id = 8")).unionByName(queries.where("query_id = 4").withColumn("tenant_id", F.lit(7).cast("long")))
    index = nearest.build_index(chunks, f"{tmp_path}/index", 4, pivots=25)
    routes = nearest._route(queries, index, index.read(spark, "cells"), 3, 16, None)
    assert "collect_list" not in plan(routes)
    vectors = {i: (t, np.array(v, np.float32).astype(float)) for i, t, v in rows}
    got = {}
    for r in nearest.knn(queries.distinct(), index, 3, block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    for q in [i for i, t, _ in rows if i % 4 == 0 and t is not None]:
        tenant, a = vectors[q]
        d = sorted((round(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), 12), i) for i, (t, b) in vectors.items() if t == tenant)
        assert [c for _, c in sorted(got[q])] == [i for _, i in d[:3]]
    cell, r = nearest._nearest(nearest._unit(chunks.toPandas()["embedding"]), index.pivots)
    assert cell.dtype == np.int32 and sum(x.n for x in index.read(spark, "cells").collect()) == len(cell) == len(r) == 430
