import math
import zlib
from collections import Counter, defaultdict

import pytest
from edges import ROWS, documents, words

from kermesse.llm import katz


def by_hand(rows):
    """(held out, tokens, known, N, base, score) of each row from plain dictionaries; and the sums
    of probabilities over all words after some contexts, which must be one."""
    tokens = [(text or "").encode().lower().split() + ["end"] for _, text, _ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _, _ in rows]
    train = [t for t, h in zip(tokens, held) if not h]
    one = Counter(w for t in train for w in t)
    two = Counter(pair for t in train for pair in zip(["begin", *t], t))
    total, distinct = sum(one.values()), len(one)
    kept1, kept2 = katz.discounts(Counter(one.values())), katz.discounts(Counter(two.values()))
    kept = lambda d, n: d[n] if n <= katz.DISCOUNTED else 1 - katz.TAIL
    unknown = sum((1 - kept(kept1, n)) * n for n in one.values()) / total
    types = max(1, sum(n == 1 for n in one.values()))
    word = lambda w: kept(kept1, one[w]) * one[w] / total if one[w] else unknown / types
    after = defaultdict(dict)
    for (a, w), n in two.items():
        after[a][w] = n
    weight = {
        a: sum((1 - kept(kept2, n)) * n for n in s.values()) / sum(s.values()) / (1 - sum(map(word, s)))
        for a, s in after.items()
    }

    def chance(a, w):
        if w in after[a]:
            return kept(kept2, after[a][w]) * after[a][w] / sum(after[a].values())
        return weight.get(a, 1.0) * word(w)

    out = []
    for t, h in zip(tokens, held):
        base = sum(math.log10((one[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)
        score = sum(math.log10(chance(a, w)) for a, w in zip(["begin", *t], t))
        out.append((h, len(t), sum(one[w] > 0 for w in t), total, base, score))
    sums = [sum(chance(a, w) for w in one) + weight[a] * unknown for a in list(weight)[:30]]
    return out, sums


# With 3000 bytes there are many blocks and parts, with two buckets many blocks in each.
@pytest.mark.parametrize("block_bytes, buckets", [(katz.BLOCK_BYTES, 50_000), (3000, 50_000), (3000, 2)])
def test_scores_agree_with_dictionaries(spark, monkeypatch, block_bytes, buckets):
    monkeypatch.setattr(katz, "MAX_BUCKETS", buckets)
    rows = [(i, f"{words(i, 30 + i % 50, 60)} {words(i, 5, 10**6)}", "s") for i in range(150)] + ROWS
    want, sums = by_hand(rows)
    assert sums == pytest.approx([1.0] * len(sums))
    found = katz.score(documents(spark, rows), block_bytes=block_bytes).collect()
    key = lambda r: (r[0], *r[1:5], round(r[5], 5), round(r[6], 5))
    assert sorted(map(repr, map(key, found))) == sorted(
        repr(key((i, *w))) for (i, _, _), w in zip(rows, want)
    )


def test_discounts_fall_back_and_lie_between_zero_and_one():
    for counts in ({}, {1: 3}, {1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6}, {1: 1, 2: 50, 3: 1}):
        kept = katz.discounts(counts)
        assert all(0 < share < 1 for share in kept[1:])


def test_edges(spark):
    docs = documents(spark)
    assert katz.score(docs.limit(0)).count() == 0
    held = [(i, "a b", "s") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    out = katz.score(documents(spark, held)).collect()  # nothing to learn from
    assert len(out) == len(held) and {r.train_tokens for r in out} == {0}


def by_hand_triples(rows):
    """Score of each row from plain dictionaries, by words, pairs and triples; and the sums of
    probabilities over all words after some contexts of two words, which must be one."""
    tokens = [(text or "").encode().lower().split() + ["end"] for _, text, _ in rows]
    train = [
        t for t, (i, _, _) in zip(tokens, rows) if zlib.crc32(b"" if i is None else str(i).encode()) % 10
    ]
    one = Counter(w for t in train for w in t)
    total, types = sum(one.values()), max(1, sum(n == 1 for n in one.values()))
    seen = [{}, defaultdict(dict), defaultdict(dict)]  # by length of the context
    for t in train:
        padded = ["begin", "begin", *t]
        for a, b, w in zip(padded, padded[1:], t):
            seen[1][(b,)][w] = seen[1][(b,)].get(w, 0) + 1
            seen[2][(a, b)][w] = seen[2][(a, b)].get(w, 0) + 1
    levels = [Counter(one.values())]
    levels += [Counter(n for after in seen[i].values() for n in after.values()) for i in (1, 2)]
    shares = [katz.discounts(counts) for counts in levels]
    kept = lambda i, n: shares[i][n] if n <= katz.DISCOUNTED else 1 - katz.TAIL
    unknown = sum((1 - kept(0, n)) * n for n in one.values()) / total

    def chance(context, w):
        if not context:
            return kept(0, one[w]) * one[w] / total if one[w] else unknown / types
        after = seen[len(context)].get(context, {})
        if w in after:
            return kept(len(context), after[w]) * after[w] / sum(after.values())
        return (weight(context) if after else 1.0) * chance(context[1:], w)

    known = {}

    def weight(context):
        if context not in known:
            after = seen[len(context)][context]
            freed = sum((1 - kept(len(context), n)) * n for n in after.values()) / sum(after.values())
            known[context] = freed / (1 - sum(chance(context[1:], w) for w in after))
        return known[context]

    scores = []
    for t in tokens:
        padded = ["begin", "begin", *t]
        scores.append(sum(math.log10(chance((a, b), w)) for a, b, w in zip(padded, padded[1:], t)))
    some = sorted(seen[2], key=repr)[::40]
    return scores, [sum(chance(c, w) for w in one) + types * chance(c, "not a word") for c in some]


# With 4000 bytes many words, and some pairs, are dealt over several parts.
@pytest.mark.parametrize("block_bytes, buckets", [(katz.BLOCK_BYTES, 50_000), (4000, 2)])
def test_triples_agree_with_dictionaries(spark, monkeypatch, block_bytes, buckets):
    monkeypatch.setattr(katz, "MAX_BUCKETS", buckets)
    rows = [(i, f"{words(i, 30 + i % 50, 60)} {words(i, 5, 10**6)}", "s") for i in range(150)] + ROWS
    rows += [(1000 + i, f"{words(i % 4, 40, 60)} x x x x x", "s") for i in range(60)]
    want, sums = by_hand_triples(rows)
    assert sums == pytest.approx([1.0] * len(sums))
    found = katz.score(documents(spark, rows), block_bytes=block_bytes, order=3).collect()
    assert sorted((repr(r.doc_id), round(r.score, 5)) for r in found) == sorted(
        (repr(i), round(score, 5)) for (i, _, _), score in zip(rows, want)
    )


def test_order_is_of_pairs_or_triples(spark):
    with pytest.raises(ValueError):
        katz.score(documents(spark), order=4)
