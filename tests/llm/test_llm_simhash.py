import random

import pytest
from edges import documents, unchanged, words

from kermesse.llm import simhash
from kermesse.llm.simhash import fingerprint, near_duplicates, one_of_each_group


def by_every_pair(rows):
    prints = [fingerprint(text) for _, text, _ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    ids = {}
    for (id, _, _), at in zip(rows, label):
        ids.setdefault(at, []).append(id)
    smallest = {at: min((i for i in own if i is not None), default=None) for at, own in ids.items()}
    return sorted(
        [(id, f"{p:016x}", smallest[at]) for (id, _, _), p, at in zip(rows, prints, label)], key=repr
    )


def copies(seed):
    """Texts and copies with a few words changed, some of copies of copies."""
    draw = random.Random(seed)
    texts = [words(seed + i, 200, 3000).split() for i in range(30)]
    for _ in range(170):
        text = list(draw.choice(texts))
        for _ in range(draw.randint(0, 3)):
            text[draw.randrange(len(text))] = f"new{draw.randrange(100)}"
        texts.append(text)
    return [(i, " ".join(t), "s") for i, t in enumerate(texts)]


def test_a_bit_is_set_in_over_half_of_the_hashes(spark):
    from pyspark.sql import functions as F

    grams = ["a b c d", "b c d e"]
    hashes = [r[0] % 2**64 for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect()]
    assert fingerprint("A b\tC d e") == hashes[0] & hashes[1]
    assert fingerprint(" Ab  c ") == spark.sql("select xxhash64('ab c')").first()[0] % 2**64
    assert fingerprint(None) == fingerprint(" ") == 0


@pytest.mark.parametrize("block", [4096, 8])  # with 8, frequent keys are compared block by block
def test_groups_agree_with_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = copies(11)
    found = sorted(map(tuple, near_duplicates(documents(spark, rows, clash=False)).collect()), key=repr)
    assert found == by_every_pair(rows)


def test_edges(spark):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    found = sorted(map(tuple, near_duplicates(docs).collect()), key=repr)
    assert found == by_every_pair(rows)
    kept = one_of_each_group(docs)
    assert unchanged(docs, kept)
    assert kept.count() == len({(c, f) if c is None else c for _, f, c in found})
    assert near_duplicates(docs.limit(0)).count() == one_of_each_group(docs.limit(0)).count() == 0


def test_a_shared_null_id_does_not_join_groups(spark):
    rows = [(None, words(21, 50), "a"), (None, words(22, 50), "a"), (None, words(22, 50), "a")]
    assert one_of_each_group(documents(spark, rows)).count() == 2
