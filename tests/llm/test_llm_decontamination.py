import random

import numpy as np
from edges import documents, unchanged, words

from kermesse.llm import decontamination
from kermesse.llm.decontamination import align, clean_documents, overlaps, words_of


def table_of_scores(a, b):
    scores, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            step = scores[i - 1][j - 1] + (2 if x == y else -1)
            scores[i][j] = max(0, step, scores[i - 1][j] - 1, scores[i][j - 1] - 1)
            best = max(best, scores[i][j])
    return best


def test_alignment_agrees_with_the_full_table():
    draw = random.Random(3)
    for _ in range(300):
        a = np.array([draw.randint(0, 3) for _ in range(draw.randint(1, 15))])
        b = np.array([draw.randint(0, 3) for _ in range(draw.randint(0, 30))], dtype=int)
        score, first, end = align(a, b)
        assert score == table_of_scores(a, b)
        assert not score or table_of_scores(a, b[first:end]) == score


ITEMS = [(i, words(100 + i, 25, 4000)) for i in range(20)] + [(20, "two Words"), (21, None), (22, "")]


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def planted():
    draw, rows = random.Random(9), []
    for i in range(60):
        text = words(500 + i, 300, 4000).split()
        if i % 3 == 0:
            item = words_of(ITEMS[i % 20][1])
            edited = [w if draw.random() > 0.12 else "edited" for w in item]
            text[100:100] = [w.upper() + "!!" for w in edited]
        rows.append((i, " ".join(text), "s"))
    return rows


def by_every_pair(rows, items):
    found = {}
    for id, text, _ in rows:
        for item, words_ in items:
            a, b = words_of(words_), words_of(text)
            if a and table_of_scores(a, b) >= 0.5 * 2 * len(a):
                found[(id, item)] = table_of_scores(a, b) / (2 * len(a))
    return found


def test_edited_copies_are_found_and_nothing_else(spark, monkeypatch):
    rows, items = planted(), ITEMS[:20]
    want = by_every_pair(rows, items)
    for size in (32 << 20, 500):  # with 500 the benchmark takes several passes
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        out = overlaps(spark, documents(spark, rows, clash=False), benchmark(spark, items)).collect()
        assert {(r.doc_id, r.item_id): r.score for r in out} == want
    assert {d for d, _ in want} == {i for i in range(60) if i % 3 == 0}


def test_short_items_and_places(spark):
    rows = [(1, "a b two words c", "s"), (2, "two a words", "s"), (3, None, "s")]
    out = overlaps(spark, documents(spark, rows, clash=False), benchmark(spark)).collect()
    assert [(r.doc_id, r.item_id, r.score, r.first_word, r.end_word) for r in out] == [(1, 20, 1.0, 2, 4)]


def test_edges(spark):
    docs = documents(spark, [*documents(spark, clash=False).collect(), (None, ITEMS[0][1], "x")])
    clean = clean_documents(spark, docs, benchmark(spark))
    assert unchanged(docs, clean) and clean.count() == docs.count() - 1
    assert clean_documents(spark, docs, benchmark(spark, [])).count() == docs.count()
    assert clean_documents(spark, docs.limit(0), benchmark(spark)).count() == 0
    twice = benchmark(spark, [ITEMS[0], ITEMS[0]])
    assert overlaps(spark, documents(spark, [(1, ITEMS[0][1], "x")]), twice).count() == 1


def test_every_fourth_word_edited_is_found_at_all_lengths_and_offsets(spark):
    """Alone and in many copies; the edited words stand nowhere else, nor do the item's other triples."""
    items, rows = [], []
    for length in range(15, 60):
        for offset in range(4):
            item = words(9000 + 4 * length + offset, length, 10**6).split()
            items.append((len(items), " ".join(item)))
            edited = [f"new{length}" if i % 4 == offset else w for i, w in enumerate(item)]
            rows.append((len(rows), f"{words(length, 30)} {' '.join(edited)} {words(offset, 30)}", "s"))
    many = [(1000 + i, rows[14][1], "s") for i in range(40)]
    out = overlaps(spark, documents(spark, rows + many, clash=False), benchmark(spark, items)).collect()
    reached = by_every_pair_of(rows, items)
    assert len(reached) == 180
    wanted = reached | {(1000 + i, 14) for i in range(40)}
    assert {(r.doc_id, r.item_id) for r in out} == wanted


def by_every_pair_of(rows, items):
    """Pairs of equal number that score enough: items of random words meet in no other way."""
    scores = (table_of_scores(words_of(b), words_of(a)) for (_, a, _), (_, b) in zip(rows, items))
    return {(i, i) for i, s in enumerate(scores) if s >= len(words_of(items[i][1]))}
