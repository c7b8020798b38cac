"""A gated recurrent language model in numpy: the network alone, without Spark.

Tokens are numbers below ``size``; 0 ends a text and also stands before its first word. Numbers
are in the order of frequency, and words of nearby frequency make up a class, so that a token's
probability is that of its class times that within the class: two small softmaxes for one large.
"""

from __future__ import annotations

import numpy as np

HIDDEN, LANES, STEPS, RATE = 16, 256, 24, 0.12
_LN10 = float(np.log(10.0))
#: Rows whose softmax over classes is made at once: so many stay in a core's cache.
_ROWS = 1024


def class_starts(counts: np.ndarray) -> np.ndarray:
    """Where each class begins: about sqrt(n) classes with equal sums of root frequencies."""
    mass = np.cumsum(np.sqrt(np.maximum(counts, 1.0)))
    n = max(1, int(np.sqrt(len(counts))))
    starts = np.unique(np.searchsorted(mass, mass[-1] * np.arange(n) / n, side="left"))
    return np.concatenate((starts, [len(counts)]))


def _exps(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | np.float32]:
    """(e, sums of its rows, top): exp(logits - top). One top for all rows serves unless they lie far apart."""
    top = logits.max()
    if top - logits.min() > 60:
        top = logits.max(axis=1, keepdims=True)
    e = np.subtract(logits, top)
    np.exp(e, out=e)
    return e, e @ np.ones(e.shape[1], dtype=e.dtype), top


def _by_class(classes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): the rows of class c are order[bounds[c]:bounds[c + 1]]."""
    return np.argsort(classes, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(classes, minlength=n))))


class Model:
    """Parameters as float32 arrays. A word's row of x holds what it adds to the three gates."""

    NAMES = ("x", "u", "p", "pb", "q", "qb")

    def __init__(self, starts: np.ndarray, arrays: dict[str, np.ndarray]) -> None:
        self.starts, self.size = starts, int(starts[-1])
        self.of_class = np.repeat(np.arange(len(starts) - 1, dtype=np.int16), np.diff(starts))  # 16 bits sort in linear time
        self.__dict__.update(arrays)

    @classmethod
    def new(cls, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 1) -> Model:
        """Small random weights; the biases already give each word its share of all tokens."""
        rng, starts = np.random.default_rng(seed), class_starts(counts)
        n, c = len(counts), len(starts) - 1
        share = np.maximum(counts, 0.5)
        per_class = np.add.reduceat(share, starts[:-1])
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return cls(starts, {
            "x": small(n, 3 * hidden), "u": small(hidden, 3 * hidden), "p": small(hidden, c), "pb": np.log(per_class / per_class.sum()).astype(np.float32),
            "q": small(n, hidden), "qb": np.log(share / np.repeat(per_class, np.diff(starts))).astype(np.float32),
        })

    def to_bytes(self) -> bytes:
        return b"".join(getattr(self, k).astype("<f4").tobytes() for k in self.NAMES)

    def from_flat(self, flat: np.ndarray) -> Model:
        arrays, at = {}, 0
        for k in self.NAMES:
            old = getattr(self, k)
            arrays[k] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return Model(self.starts, arrays)

    def step(self, h: np.ndarray, tokens: np.ndarray):
        """The next state, and what the way back needs."""
        k = h.shape[1]
        inner, outer = h @ self.u, self.x[tokens]
        gates = inner[:, : 2 * k] + outer[:, : 2 * k]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :k], gates[:, k:]
        m = inner[:, 2 * k :]
        n = np.tanh(outer[:, 2 * k :] + r * m)
        return n + z * (h - n), (z, r, n, m)

    def log_probability(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 of each target's probability, given the state before it."""
        classes = self.of_class[targets]
        out = np.empty(len(h))
        for lo in range(0, len(h), _ROWS):
            logits = h[lo : lo + _ROWS] @ self.p
            logits += self.pb
            own = logits[np.arange(len(logits)), classes[lo : lo + _ROWS]]
            _, total, top = _exps(logits)
            out[lo : lo + _ROWS] = own - np.ravel(top) - np.log(total)
        order, bounds = _by_class(classes, len(self.starts) - 1)
        sorted_h, sorted_targets, inner = h[order], targets[order], np.zeros(len(h))
        for c in np.flatnonzero(np.diff(bounds)):
            lo, hi, a, b = bounds[c], bounds[c + 1], self.starts[c], self.starts[c + 1]
            if b - a == 1:
                continue
            inside = sorted_h[lo:hi] @ self.q[a:b].T
            inside += self.qb[a:b]
            own = inside[np.arange(hi - lo), sorted_targets[lo:hi] - a]
            _, total, top = _exps(inside)
            inner[lo:hi] = own - np.ravel(top) - np.log(total)
        out[order] += inner
        return out / _LN10


def score(model: Model, tokens: np.ndarray, first: np.ndarray, steps: int = 32) -> np.ndarray:
    """log10 probability of each whole text, tokens[first[d]:first[d + 1]].

    All texts run side by side, the longest first, and drop out as they end; the state is carried
    from window to window, so nothing is cut at a window's edge."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    at, left = first[:-1][order], lengths[order]
    out = np.zeros(len(lengths))
    h = np.zeros((len(lengths), model.u.shape[0]), dtype=np.float32)
    last = np.zeros(len(lengths), dtype=np.int64)
    t, most, falling = 0, int(left[0]) if len(left) else 0, -left
    while t < most:
        states, targets, owners = [], [], []
        for _ in range(min(steps, most - t)):
            n = int(np.searchsorted(falling, -t, side="left"))  # texts with more than t tokens
            h, _ = model.step(h[:n], last[:n])
            last = tokens[at[:n] + t]
            states.append(h), targets.append(last), owners.append(order[:n])
            t += 1
            if sum(map(len, states)) > 1 << 16:
                break
        lp = model.log_probability(np.concatenate(states), np.concatenate(targets))
        out += np.bincount(np.concatenate(owners), lp, len(out))
    return out


class Trainer:
    """Truncated backpropagation through time with per-parameter step sizes (Adagrad)."""

    def __init__(self, model: Model, rate: float = RATE) -> None:
        self.m, self.rate = model, rate
        self.past = {k: np.full_like(getattr(model, k), 1e-4) for k in Model.NAMES}

    def _move(self, name: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        past = self.past[name]
        past[rows] += grad * grad
        getattr(self.m, name)[rows] -= self.rate * grad / np.sqrt(past[rows])

    def run(self, tokens: np.ndarray, starts: np.ndarray, lanes: int = LANES, steps: int = STEPS) -> None:
        """One pass over a stream of tokens; ``starts`` marks the first token of each text.

        The stream is cut into lanes that run side by side; the state of a lane goes from window to
        window and begins anew with each text. Lanes are filled up behind the last token with places
        that are not learned from."""
        if not len(tokens):
            return
        if len(tokens) < lanes:
            lanes = 1
        length = -(-len(tokens) // lanes)
        inputs = np.concatenate(([0], tokens[:-1]))
        inputs[starts] = 0
        cut = lambda a: np.concatenate((a, np.zeros(lanes * length - len(a), dtype=a.dtype))).reshape(lanes, length)
        x, y, new, real = cut(inputs), cut(tokens), cut(starts), cut(np.ones(len(tokens), dtype=bool))
        h = np.zeros((lanes, self.m.u.shape[0]), dtype=np.float32)
        for t in range(0, length, steps):
            h = self._window(h, x[:, t : t + steps], y[:, t : t + steps], new[:, t : t + steps], real[:, t : t + steps])

    def _window(self, h: np.ndarray, x: np.ndarray, y: np.ndarray, new: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
        m, (lanes, n), k = self.m, x.shape, h.shape[1]
        before, states, kept = [], [], []
        for t in range(n):
            h = h * ~new[:, t, None]
            before.append(h)
            h, inside = m.step(h, x[:, t])
            states.append(h)
            kept.append(inside)
        if real is None or real.all():
            grads = self._output(np.concatenate(states), y.T.ravel()).reshape(n, lanes, k)
        else:  # places without a token have no loss, and none comes back to them
            there = real.T.ravel()
            grads = np.zeros((n * lanes, k), dtype=np.float32)
            grads[there] = self._output(np.concatenate(states)[there], y.T.ravel()[there])
            grads = grads.reshape(n, lanes, k)
        back = np.zeros_like(h)
        into = np.empty((n, lanes, 3 * k), dtype=np.float32)
        du = np.zeros_like(m.u)
        for t in range(n - 1, -1, -1):
            z, r, c, inner = kept[t]
            d = back + grads[t]
            dn = d * (1 - z) * (1 - c * c)
            dr = dn * inner * r * (1 - r)
            dz = d * (before[t] - c) * z * (1 - z)
            into[t, :, :k], into[t, :, k : 2 * k], into[t, :, 2 * k :] = dz, dr, dn
            through = np.concatenate((dz, dr, dn * r), axis=1)
            du += before[t].T @ through
            back = (d * z + through @ m.u.T) * ~new[:, t, None]
        flat, words = into.reshape(-1, 3 * k), x.T.ravel()
        order = np.argsort(words.astype(np.uint16) if m.size <= 1 << 16 else words, kind="stable")
        cuts = np.flatnonzero(np.diff(words[order], prepend=-1))
        scale = np.float32(1.0 / lanes)
        self._move("x", np.add.reduceat(flat[order], cuts, axis=0) * scale, words[order][cuts])
        self._move("u", du * scale)
        return h

    def _output(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Move the output weights, and return the loss's slope in the states."""
        m, scale = self.m, np.float32(1.0 / LANES)
        classes = m.of_class[y]
        out, back = np.empty_like(h), m.p.T.copy()
        dp, dpb = np.zeros_like(m.p), np.zeros_like(m.pb)
        for lo in range(0, len(h), _ROWS):
            part = h[lo : lo + _ROWS]
            logits = part @ m.p
            logits += m.pb
            d, total, _ = _exps(logits)
            d /= total[:, None]
            d[np.arange(len(d)), classes[lo : lo + _ROWS]] -= 1
            np.matmul(d, back, out=out[lo : lo + _ROWS])
            dp += part.T @ d
            dpb += np.ones(len(d), dtype=d.dtype) @ d
        order, bounds = _by_class(classes, len(m.starts) - 1)
        sorted_h, sorted_y, inner = h[order], y[order], np.zeros_like(out)
        for c in np.flatnonzero(np.diff(bounds)):
            lo, hi, a, b = bounds[c], bounds[c + 1], m.starts[c], m.starts[c + 1]
            if b - a == 1:
                continue
            own = sorted_h[lo:hi]
            inside = own @ m.q[a:b].T
            inside += m.qb[a:b]
            e, total, _ = _exps(inside)
            e /= total[:, None]
            e[np.arange(hi - lo), sorted_y[lo:hi] - a] -= 1
            np.matmul(e, m.q[a:b], out=inner[lo:hi])
            self._move("q", (e.T @ own) * scale, slice(a, b))
            self._move("qb", (np.ones(hi - lo, dtype=e.dtype) @ e) * scale, slice(a, b))
        out[order] += inner
        self._move("p", dp * scale)
        self._move("pb", dpb * scale)
        return np.clip(out, -5, 5)
