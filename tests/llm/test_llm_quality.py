import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edges import PROSE, documents, unchanged, words

from kermesse.llm.quality import good_documents, longest_matches, measure, quality


def repeated_words(text):
    found = (text or "").encode().split()
    grams = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    cover = set()
    for i in range(len(found) - 7):
        if grams[tuple(found[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    return len(found), len(cover)


def test_repeats_agree_with_counted_windows():
    draw = random.Random(1)
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randint(0, 80))) for _ in range(300)]
    texts += [None, "", " a\tb ", "x y z " * 3000, "q " * 5000, words(5, 3000)]
    found = measure(pa.array(texts), 30, 100)
    assert [repeated_words(t) for t in texts] == list(zip(found[0].tolist(), found[4].tolist()))


def test_longest_matches_against_every_pair():
    draw = random.Random(2)
    for _ in range(200):
        row = [draw.randint(0, 2) for _ in range(draw.randint(0, 50))]
        want = []
        for i in range(len(row)):
            best = 0
            for j in range(len(row)):
                n = 0
                while i != j and max(i, j) + n < len(row) and row[i + n] == row[j + n]:
                    n += 1
                best = max(best, n)
            want.append(best)
        assert longest_matches(np.array(row, dtype=int), np.zeros(len(row), int)).tolist() == want


@pytest.mark.parametrize(
    "text, symbols, lines, characters",
    [("a#b <c> é", 3, 0, 7), ("x\n\nx\n \nx", 0, 2, 3), ("", 0, 0, 0), (None, 0, 0, 0)],
)
def test_measures(text, symbols, lines, characters):
    found = [column[0] for column in measure(pa.array([text], pa.string()), 30, 100)]
    assert (found[2], found[3], found[1]) == (symbols, lines, characters)


def test_verdicts(spark):
    long_repeat = words(6, 150, 10**6)
    rows = [
        (1, words(4, 300, 10**6), "clean"),
        (2, " ".join([long_repeat, words(7, 900, 10**6), long_repeat]), "one long repeat"),
        (3, "spam and more spam and then some eggs " * 10, "repeats"),
        (4, "too short", "short"),
    ]
    kept = quality(documents(spark, rows, clash=False)).collect()
    assert [r.kept for r in kept] == [True, False, False, False]
    assert [r.base_failed for r in kept] == [False, False, True, True]
    assert kept[1].longest_repeat == 150


def test_edges(spark):
    docs = documents(spark)
    out = quality(docs)
    assert out.count() == docs.count() and {"kept", "n_words"} <= set(out.columns)
    good = good_documents(docs)
    assert unchanged(docs, good) and good.where("text is null").count() == 0
    assert {r.text for r in good.collect()} >= {PROSE}
    assert quality(docs.limit(0)).count() == good_documents(docs.limit(0)).count() == 0
