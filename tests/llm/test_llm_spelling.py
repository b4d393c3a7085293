import random
import re
import zlib
from collections import Counter

import pyarrow as pa
from edges import documents

from kermesse.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = {c: c + 32 for c in range(65, 91)}


def counted(rows):
    n = Counter()
    for key, text in rows:
        for run in RUN.findall((text or "").translate(LOW)):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return n


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(rows):
    n = {w: c for w, c in counted(rows).items() if c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def edited(draw, word, letters):
    p = draw.randrange(len(word))
    kind = draw.randrange(4)
    if kind == 0:
        return word[:p] + word[p + 1 :]
    if kind == 1:
        return word[:p] + draw.choice(letters) + word[p:]
    if kind == 2:
        return word[:p] + draw.choice(letters) + word[p + 1 :]
    return word[:p] + word[p + 1 : p + 2] + word[p : p + 1] + word[p + 2 :]


def corpus(seed, letters="abcéß÷Aÿ", bases=25):
    draw = random.Random(seed)
    words = []
    for _ in range(bases):
        base = "".join(draw.choice(letters) for _ in range(draw.randint(6, 11)))
        words += [base] * draw.choice([2, 30, 200])
        for _ in range(8):
            one = edited(draw, base, letters)
            words += [one] * draw.randint(1, 20) + [edited(draw, one, letters)] * 2
    words += ["Chained"] * 400 + ["chainedx"] * 30 + ["chaimedx"] * 2
    draw.shuffle(words)
    texts = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)]


def test_words_against_plain_code():
    draw = random.Random(3)
    rows = corpus(1)
    rows += [(5, None), (6, ""), (7, "x" * 9000 + "é" * 700), (8, "Ã" * 7), (-3, "Abcdefg×hijk Äbcdefgh")]
    rows += [(i, "".join(draw.choice("abcÉ ,1日") for _ in range(60))) for i in range(500)]
    found, n = spelling.word_rows([r[0] for r in rows], pa.array([r[1] for r in rows], pa.string()))
    assert dict(zip(found.to_pylist(), n.tolist())) == dict(counted(rows))


def test_against_a_plain_version(spark):
    for seed, cell in ((1, 20_000), (2, 20), (3, 3)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = [tuple(r) for r in spelling.variants(docs, cell_words=cell).collect()]
        want = plain(rows)
        assert any(w[1] and w[2] != w[1] for w in want)
        assert len(found) == len(want) and set(found) == want


def test_anagrams_and_long_words():
    draw = random.Random(8)
    words = set()
    while len(words) < 1200:
        words.add("".join(draw.sample("aabbccd", 7)))
        if len(words) > 400:
            break
    words |= {w[:p] + c + w[p:] for w in list(words)[:100] for p in (0, 3, 7) for c in "ae"}
    words |= {w[:2] + "e" + w[3:] for w in list(words)[:100]}
    words |= {"a" * n + "b" for n in (40_000, 40_001)}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for length, stored in by_length.items():
        asking = stored + by_length.get(length - 1, [])
        got = list(spelling.cell_pairs(asking, stored))
        want = {frozenset((a, b)) for a in asking for b in stored if len(a) < 100 and one_edit(a, b)}
        if length > 100:
            want = {frozenset(words) for words in [stored + by_length.get(length - 1, [])] if len(words) == 2}
        assert {frozenset(p) for p in got} == want and len(got) == len(want)


def test_a_chain_is_followed_to_its_end(spark):
    chain = ["aaaaaaa" + "b" * k for k in range(4)]
    forms = spark.createDataFrame(
        [(a, b) for a, b in zip(chain, chain[1:])] + [("zzzzzzz", "yyyyyyy")], "word string, form string"
    )
    assert {tuple(r) for r in spelling._roots(forms).collect()} == {
        *((w, chain[-1]) for w in chain[:-1]),
        ("zzzzzzz", "yyyyyyy"),
    }


def test_nulls_clashes_and_an_empty_table(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.variants(docs).collect()} == plain(rows)
    assert spelling.variants(docs.limit(0)).collect() == []
