import hashlib
import random

import numpy as np
import odd
import pytest
from riskframe.llm import substrings as S
from riskframe.llm.words import read_words


def brute(rows, window):
    first = {}
    for doc, text in rows:
        w = odd.spaced(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    for doc, text in rows:
        w = odd.spaced(text)
        gone = {p for k in range(len(w) - window + 1) if doc is not None and first[tuple(w[k : k + window])] < doc for p in range(k, k + window)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        yield doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: [rng.choice(["a", "b", "c", "dd"]) if rng.random() < 0.3 else f"w{rng.randrange(400)}" for _ in range(n)]
    passages = [say(rng.choice([49, 50, 51, 70, 160])) for _ in range(6)]
    rows = []
    for doc in range(60):
        words = say(rng.randrange(0, 90))
        for _ in range(rng.randrange(0, 4)):
            words += rng.choice(passages) + say(rng.randrange(0, 30))
        rows.append((doc, " \n".join(words)))
    rows += [(100 + k, rows[k % 5][1]) for k in range(12)] + [(7, rows[9][1]), (None, rows[1][1]), (200, "same " * 300), (201, "same " * 120), (202, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("group", [S.GROUP, 2])
def test_against_brute_force(spark, group):
    rows = corpus(3)
    got = S.removal_counts(spark.createDataFrame(rows, "doc_id long, text string"), group=group).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, 50), key=repr)


def test_other_windows_and_chunks(spark, monkeypatch):
    rows = corpus(4)
    for window in (3, 36, 64):
        got = S.removal_counts(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, window), key=repr)


def test_segments_depend_on_their_own_text_alone():
    """Texts of one-character words, together longer than a chunk and one of them alone so, in two row orders."""
    rng = np.random.default_rng(6)
    texts = [b" ".join(rng.choice([b"0", b"1", b"2", b"a", b"b"], n).tolist()) for n in (120_000, 90_001, 110_000, 300_000, 70, 95_000)]

    def found(order):
        offsets = np.cumsum([0, *(len(texts[i]) for i in order)])
        words = read_words(np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8), offsets)
        got = S.Segments(words, 50)
        covered = sum(int((got.hi - got.lo + 1)[got.text == d].sum()) for d in range(len(order)))
        assert covered == sum(len(texts[i].split()) - 49 for i in order)
        return {i: list(zip(got.anchor[got.text == d].tolist(), got.ident[got.text == d].tolist())) for d, i in enumerate(order)}

    alone = {i: found([i])[i] for i in range(len(texts))}
    assert found([0, 1, 2, 3, 4, 5]) == alone and found([5, 3, 0, 4, 2, 1]) == alone


def test_cleaned_text(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    docs = spark.createDataFrame([(1, f"start {passage} end", "x"), (2, f"Other,\n{passage} tail here", "y"), (3, None, "z")], "doc_id long, text string, n_removed string")
    got = {r.doc_id: r for r in S.remove_repeats(docs).collect()}
    assert got[2].text == "Other,\ntail here" and got[2].n_removed == 55 and got[1].n_removed == 0 and got[3].text is None


def test_odd_rows(spark):
    got = S.removal_counts(odd.docs(spark)).collect()
    assert len(got) == len(odd.ROWS)
    by = {r.doc_id: r for r in got}
    assert by[8].n_removed == by[8].n_words == 120_000 and by[5].n_removed == 0 and by[6].n_words == 1 and by[2].n_words == 0
    assert S.removal_counts(odd.none(spark)).count() == 0
    assert S.remove_repeats(odd.docs(spark)).count() == len(odd.ROWS)
