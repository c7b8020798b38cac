import math
import zlib
from collections import Counter

import numpy as np
import odd
import pytest
from riskframe.llm import gru, lm


def model(n=12, seed=3):
    m = gru.Model.new(np.arange(n, 0, -1) * 5.0, hidden=4, seed=seed)
    rng = np.random.default_rng(seed)
    for k in gru.Model.NAMES:
        a = getattr(m, k)
        a += (rng.standard_normal(a.shape) * 0.5).astype(np.float32)
    return m


def probabilities(m, history):
    """All next tokens' probabilities after a text's beginning, one step at a time."""
    h = np.zeros((1, m.u.shape[0]), dtype=np.float32)
    for token in [0, *history]:
        h, _ = m.step(h, np.array([token]))
    return 10 ** m.log_probability(np.repeat(h, m.size, axis=0), np.arange(m.size))


def test_next_token_probabilities_sum_to_one_and_texts_are_scored_whole():
    m, rng = model(), np.random.default_rng(0)
    texts = [np.concatenate((rng.integers(1, m.size, n), [0])) for n in (0, 1, 7, 70, 33, 3)]
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = gru.score(m, np.concatenate(texts), first, steps=8)
    for text, total in zip(texts, got):
        want = 0.0
        for i, token in enumerate(text):
            p = probabilities(m, text[:i])
            assert p.sum() == pytest.approx(1, abs=1e-5)
            want += math.log10(p[token])
        assert total == pytest.approx(want, rel=1e-5)


def test_gradients(monkeypatch):
    """The moves of one window follow the slope of the loss."""
    m = model(9)
    x, y = np.array([[0, 3, 5, 0, 2], [0, 1, 8, 4, 4]]), np.array([[3, 5, 0, 2, 7], [1, 8, 4, 4, 6]])
    new = np.array([[1, 0, 0, 1, 0], [1, 0, 0, 0, 0]], dtype=bool)

    def loss():
        h, total = np.zeros((2, 4), dtype=np.float32), 0.0
        for t in range(5):
            h, _ = m.step(h * ~new[:, t, None], x[:, t])
            total -= m.log_probability(h, y[:, t]).sum() * math.log(10)
        return total

    moves = {}

    def keep(self, name, grad, rows=slice(None)):
        whole = np.zeros_like(getattr(m, name))
        whole[rows] = grad
        moves[name] = moves.get(name, 0) + whole

    monkeypatch.setattr(gru.Trainer, "_move", keep)
    gru.Trainer(m)._window(np.zeros((2, 4), dtype=np.float32), x, y, new)
    scale = {"x": 2, "u": 2, "p": gru.LANES, "pb": gru.LANES, "q": gru.LANES, "qb": gru.LANES}
    rng = np.random.default_rng(1)
    for name in gru.Model.NAMES:
        a = getattr(m, name)
        for _ in range(6):
            at = tuple(int(rng.integers(s)) for s in a.shape)
            old, step = a[at], 0.02
            a[at] = old + step
            up = loss()
            a[at] = old - step
            slope = (up - loss()) / (2 * step)
            a[at] = old
            assert moves[name][at] * scale[name] == pytest.approx(slope, abs=0.02 + 0.05 * abs(slope)), name


@pytest.mark.parametrize("n", [1, 200, 256, 500, 7001])
def test_every_token_is_learned_from(monkeypatch, n):
    rng, seen, output = np.random.default_rng(n), [], gru.Trainer._output
    tokens, starts = rng.integers(0, 9, n), rng.random(n) < 0.1
    monkeypatch.setattr(gru.Trainer, "_output", lambda self, h, y: (seen.extend(y.tolist()), output(self, h, y))[1])
    gru.Trainer(model(9)).run(tokens, starts)
    assert Counter(seen) == Counter(tokens.tolist())


def test_places_without_a_token_move_nothing():
    x, y = np.array([[0, 3, 5], [0, 1, 0]]), np.array([[3, 5, 2], [1, 8, 0]])
    new, real = np.array([[1, 0, 0], [1, 0, 0]], dtype=bool), np.array([[1, 1, 1], [1, 1, 0]], dtype=bool)
    moved = []
    for other in (0, 7):
        x[1, 2] = y[1, 2] = other
        m = model(9)
        gru.Trainer(m)._window(np.zeros((2, 4), dtype=np.float32), x, y, new, real)
        moved.append(m.to_bytes())
    assert moved[0] == moved[1]


def test_query_against_brute_force(spark, data):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    tokens = {d: [*odd.spaced(odd.lower(t)), None] for d, t in text.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in text}
    counts = Counter(w for d in text if not held[d] for w in tokens[d])
    n, v = sum(counts.values()), len(counts)
    for broadcast in (1 << 18, 100):
        rows = lm.score_documents(spark.read.parquet(f"{data}/documents.parquet"), broadcast_words=broadcast, vocabulary=90).collect()
        assert len(rows) == len(text)
        for r in rows:
            own = tokens[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_held_out_texts_are_better_told_than_by_counts(spark):
    rows = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)


def test_odd_rows(spark):
    got = lm.score_documents(odd.docs(spark)).collect()
    assert len(got) == len(odd.ROWS) and {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert lm.score_documents(odd.none(spark)).count() == 0
