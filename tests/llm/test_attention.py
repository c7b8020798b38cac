import re
import zlib

import numpy as np
import odd
import pyarrow as pa
import pytest
from riskframe.llm import attention as A


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    vectors, first, labels = rng.random((9, 10)), np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 1.0])
    net = A.Network.new(vectors, 0.3)
    _, slopes = net.gradients(vectors, first, labels)
    for name in net.NAMES:
        value, flat = getattr(net, name), slopes[name].ravel()
        for i in rng.choice(value.size, min(5, value.size), replace=False):
            old, e = value.flat[i], 1e-6
            value.flat[i] = old + e
            high = net.gradients(vectors, first, labels)[0]
            value.flat[i] = old - e
            low = net.gradients(vectors, first, labels)[0]
            value.flat[i] = old
            assert (high - low) / (2 * e) == pytest.approx(flat[i], abs=1e-7)


def slow_score(net, vectors):
    """Attention of one text over all its passages at once."""
    x = np.clip((np.array(vectors, dtype=float) - net.mean) / net.scale, -6, 6)
    h = np.tanh(x @ net.e + net.eb)
    a = [float(np.dot(net.w, np.tanh(r @ net.v + net.vb) / (1 + np.exp(-(r @ net.u + net.ub))))) for r in h]
    weight = np.exp(np.array(a) - max(a))
    z = sum(w * r for w, r in zip(weight / weight.sum(), h))
    return 1 / (1 + np.exp(-(float(z @ net.c) + net.cb[0])))


def test_blocks_of_passages_make_no_difference(monkeypatch):
    """Each passage on its own, as a text of its own, gives the same vectors and the same score."""
    texts = ["", None, " \n ", "one", "Ä ö! x\ny " * 300, "a b\n" * 64, "Shout!! IT*** out$$$ | x " * 50, "y" * 5000, "word " * 64 + "end", "é " * 2000]
    whole = {}
    for rows, vectors in A.text_passages(pa.array(texts)):
        for r, v in zip(rows, vectors):
            whole.setdefault(int(r), []).append(v)
    cut = lambda t: [m.group(0) for m in re.finditer(r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){1,64}", t or "")] or [""]
    for r, text in enumerate(texts):
        alone = [v for part in cut(text) for _, vs in A.text_passages(pa.array([part.strip(" \t\n")])) for v in vs]
        assert np.allclose(whole[r], alone, atol=1e-6)
    monkeypatch.setattr(A, "BLOCK_BYTES", 700)
    pieces = {}
    for rows, vectors in A.text_passages(pa.array(texts)):
        for r, v in zip(rows, vectors):
            pieces.setdefault(int(r), []).append(v)
    assert all(np.array_equal(whole[r], pieces[r]) for r in whole)
    net = A.Network.new(np.random.default_rng(1).random((20, A.FEATURES)), 0.1)
    net.w = net.w * 30
    assert np.allclose(A.bag_scores(net, pa.array(texts)), [slow_score(net, whole[r]) for r in range(len(texts))], atol=1e-9)


def test_held_out_rows_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = A.score_documents(docs, A.learn(docs, labels)).collect()
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    seen = [(marks[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in marks]
    good, bad = [s for m, s, _ in seen if m], [s for m, s, _ in seen if not m]
    area = np.mean([[(g > b) + (g == b) / 2 for g in good] for b in bad])
    print(len(good), len(bad), area, np.mean([p for m, _, p in seen if m]), np.mean([p for m, _, p in seen if not m]))
    assert area > 0.95 and np.mean([p == m for m, _, p in seen]) > 0.95


def test_held_out_labels_change_nothing(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, 1 - quality, quality) as quality")
    first, second = A.learn(docs, labels), A.learn(docs.drop("lang", "source"), turned)
    assert all(np.array_equal(getattr(first, k), getattr(second, k)) for k in first.NAMES)


def test_a_single_bad_passage_is_found(spark):
    """What only attention over passages can tell: one passage of forty decides."""
    rng = np.random.default_rng(4)
    fine = lambda n: " ".join(rng.choice(["the", "tower", "stands", "over", "old", "town"], n))
    texts = [(i, fine(64 * 9) + (" " + "BUY$$$ NOW!!! " * 32 if i % 2 else "") + fine(64 * 9)) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, quality int")
    got = A.score_documents(docs, A.learn(docs, labels)).where("held_out").collect()
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in got]) > 0.97


def test_odd_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    net = A.learn(docs, labels)
    got = A.score_documents(odd.docs(spark), net).collect()
    assert len(got) == len(odd.ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert A.score_documents(odd.none(spark), net).count() == 0
    none, one = labels.limit(0), spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert A.learn(odd.docs(spark), none) == 0.5 and 0 < A.learn(odd.docs(spark), one) < 1
    assert {r.score for r in A.score_documents(odd.docs(spark), 0.75).collect()} == {0.75}
    strange = spark.createDataFrame([("a", "some text", 3)], "doc_id string, text string, score int")
    assert A.score_documents(strange, net).columns == ["doc_id", "held_out", "score", "predicted"]
