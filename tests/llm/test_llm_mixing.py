from math import comb

import pytest
from edges import documents, unchanged, words
from pyspark.sql import functions as F

from kermesse.llm.mixing import hypergeometric, mix, mix_rows, sized, splitting_tree


def test_draws_follow_the_distribution(spark):
    long = lambda v: F.lit(v).cast("long")
    draws = spark.range(20_000).select(hypergeometric(long(50), long(20), long(15), F.rand(1)).alias("x"))
    for x, n in draws.groupBy("x").count().collect():
        want = 20_000 * comb(20, x) * comb(30, 15 - x) / comb(50, 15)
        assert abs(n - want) < 5 * want**0.5 + 5


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_the_tree_keeps_every_quota(spark, shards):
    counts = [1000, 20, 0, 7, 3_000_000_000]
    root = spark.createDataFrame([(counts,)], "counts array<long>")
    leaves = sorted(splitting_tree(root, shards).collect())
    assert [r.shard for r in leaves] == list(range(shards))
    assert [sum(r["counts"][i] for r in leaves) for i in range(5)] == counts
    totals = [sum(r["counts"]) for r in leaves]
    assert max(totals) - min(totals) <= shards
    assert splitting_tree(root, shards).collect() == splitting_tree(root, shards).collect()


def by_hand(sizes, weights=(5, 2, 1)):
    """Targets as the rule says them: share, stop at three times, share the excess again."""
    names = sorted(n for n in sizes if n is not None) + [n for n in sizes if n is None]
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if weight[n] * share > 3 * sizes[n]}
        target |= {n: 3 * sizes[n] for n in full} | ({n: weight[n] * share for n in open_} if not full else {})
        left -= sum(3 * sizes[n] for n in full)
        open_ = open_ - full if full else set()
    return target


def many():
    return [(i, words(i, 5 + i % 37), [None, "a", "b", "c", "é", "tiny"][min(i % 7, 5) if i < 400 else 1]) for i in range(600)]


def test_targets_and_taken_words(spark):
    rows = many()
    docs = documents(spark, rows, clash=False)
    out = mix_rows(sized(docs, "doc_id", id="doc_id", text="text", source="source"), block_words=500).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = by_hand(sizes)
    taken = {}
    for r in out:
        name = None if r.source_key == "n" else r.source_key[1:]
        assert r.source_size == sizes[name] and r.target == pytest.approx(want[name])
        assert 0 <= r.copies <= 3 and len(r.shards) == r.copies and None not in r.shards
        taken[name] = taken.get(name, 0) + r["size"] * r.copies
    assert all(abs(taken[n] - want[n]) <= 21 for n in want)  # half of the longest text
    assert {s for r in out for s in r.shards} <= set(range(64))


def test_edges(spark):
    docs = documents(spark)
    mixed = mix(docs, block_words=100)
    assert unchanged(docs, mixed)
    key = lambda df: sorted(map(repr, df.select("doc_id", "text").collect()))
    assert key(mixed) == key(mix(docs.repartition(7), block_words=100))
    assert mix(docs.limit(0)).count() == 0
    assert mix(documents(spark, [(1, None, "a"), (2, "", None)])).count() == 0
