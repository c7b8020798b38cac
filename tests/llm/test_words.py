import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import words as W

TEXT = st.text(alphabet=st.sampled_from("ab \n\té😀Z9."), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, most):
    seen = {}
    for lo, hi, data, offsets in W.slices(pa.array(texts, type=pa.string()), most):
        found = W.read_words(data, offsets)
        hashes = found.hashes()
        for d in range(hi - lo):
            own = re.findall(r"[^\x20\x09-\x0D]+", texts[lo + d] or "")
            a, b = found.first[d], found.first[d + 1]
            assert [data[s:e].tobytes().decode() for s, e in zip(found.start[a:b], found.end[a:b])] == own
            for word, h in zip(own, hashes[a:b].tolist()):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_place_or_length():
    long = "x" * (W.BLOCK + 5)
    text = f"{long} a {long} b a".encode()
    data = np.frombuffer(text, dtype=np.uint8)
    h = W.read_words(data, np.array([0, len(data)])).hashes()
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_window_hashes_over_block_edges(monkeypatch):
    h = np.arange(100, dtype=np.uint64) % np.uint64(7)
    whole = W.window_hashes(h, 5)
    monkeypatch.setattr(W, "BLOCK", 16)
    assert (W.window_hashes(h, 5) == whole).all()
    assert whole[0] == whole[7] and len(set(whole.tolist())) == 7
