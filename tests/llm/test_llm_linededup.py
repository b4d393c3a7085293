import random

import pytest
from edges import documents, words

from kermesse.llm import linededup
from kermesse.llm.linededup import chunks, removable, without_repeats


def by_hand(rows):
    """Each chunk stays where it stands first, by id (null last)."""
    seen, out = set(), {}
    for id, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, left = (text or "").split("\n"), []
        for start, end in chunks(text):
            chunk = tuple(lines[start:end])
            if removable(lines[start:end]) and chunk in seen:
                continue
            seen.add(chunk)
            left += chunk
        out[id] = "\n".join(left)
    return out


def shared_passages():
    draw = random.Random(8)
    passages = ["\n".join(words(900 + i * 50 + j, 7) for j in range(12)) for i in range(4)]
    passages.append(words(77, 80))  # one long line
    rows = []
    for i in range(80):
        lines = [words(2000 + i * 40 + j, 6) for j in range(draw.randint(1, 12))]
        if i % 2:
            lines.insert(draw.randint(0, len(lines)), passages[0 if i % 3 else draw.randrange(5)])
        rows.append((i, "\n".join(lines), "s"))
    return rows


@pytest.mark.parametrize("hot", [1000, 3])  # with 3, frequent chunks are dealt to several tasks
def test_agrees_with_chunks_by_hand(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT_CHUNK", hot)
    rows = shared_passages()
    out = without_repeats(documents(spark, rows, clash=False)).collect()
    assert {r.doc_id: r.text for r in out} == by_hand(rows)
    assert all(r.n_lines - r.n_removed == (r.text.count("\n") + 1 if r.text else 0) for r in out)
    assert sum(r.n_removed for r in out) > 0


def test_boundaries_follow_content():
    """Lines put in front shift boundaries by their number and change no chunk further on."""
    text = "\n".join(words(i, 5) for i in range(60))
    shifted = "new line one\nand two\n" + text
    ends = {end + 2 for _, end in chunks(text)}
    assert len(ends & {end for _, end in chunks(shifted)}) >= len(ends) - 1
    assert [c for pair in chunks(text) for c in pair][1:-1:2] == [s for s, _ in chunks(text)][1:]


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "\n\n\n", "b"), (4, "\n\n\n", "b"), (None, "a\nb\n" * 50, "c")]
    docs = documents(spark, [*rows, (5, words(3, 70), "c"), (6, words(3, 70), "c"), (6, words(3, 70), "c")]).drop("n_removed")
    out = without_repeats(docs)
    found = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert [t for i, t in found if i in (1, 2, 3, 4)] == [None, "", "\n\n\n", "\n\n\n"]
    assert [t for i, t in found if i == 6] == ["", ""] and (5, words(3, 70)) in found
    assert without_repeats(docs.limit(0)).count() == 0
