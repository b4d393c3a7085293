import bisect
import random
from collections import Counter

from edges import documents, words
from pyspark.sql import functions as F

from kermesse.llm.sharding import Ring, _arc, fill, with_shards


def one_by_one(ring, arcs, shards):
    """Rows put on the ring one at a time: home rows first, then the overflow, arc by arc."""
    total = len(arcs)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    load, over = Counter(), []
    for arc in sorted(arcs):
        home = ring.shards[arc]
        if load[home] < room[home]:
            load[home] += 1
        else:
            over.append(arc)
    placed = Counter(load)
    for arc in over:
        at = arc
        while load[ring.shards[at]] >= room[ring.shards[at]]:
            at = (at + 1) % len(ring.shards)
        load[ring.shards[at]] += 1
    return load, placed


def test_runs_place_rows_as_one_by_one():
    draw = random.Random(4)
    for shards in (1, 3, 24):
        ring = Ring.of(shards, 8)
        arcs = [draw.randrange(len(ring.places)) for _ in range(draw.randint(0, 400))]
        arcs += [0] * 50  # a hot arc
        runs = fill(ring, dict(Counter(arcs)), shards)
        got = Counter()
        for arc, first, end, shard, _ in runs:
            got[shard] += end - first
        assert got == one_by_one(ring, arcs, shards)[0]
        assert max(got.values()) - min(got[s] for s in range(shards)) <= 1


def test_most_rows_stay_at_home():
    """A row moves only from a full shard, so what moves is the overflow of a ring without bounds."""
    ring, draw = Ring.of(24), random.Random(5)
    loads = Counter(bisect.bisect_left(ring.places, draw.randrange(2**32)) % len(ring.places) for _ in range(50_000))
    home = sum(e - f for arc, f, e, shard, _ in fill(ring, loads, 24) if ring.shards[arc] == shard)
    unbounded = Counter()
    for arc, n in loads.items():
        unbounded[ring.shards[arc]] += n
    assert home == sum(min(n, 50_000 // 24 + (s < 50_000 % 24)) for s, n in unbounded.items())


def test_arcs(spark):
    ring = Ring.of(24)
    places = [p + d for p in ring.places[::7] for d in (0, 1)] + [0, 2**32 - 1]
    df = spark.createDataFrame([(p,) for p in places], "p long")
    assert all(ring.arc_of(r.p) == r.a for r in df.select("p", _arc(F.col("p"), ring).alias("a")).collect())


def check(rows, shards=24):
    counts = Counter(r.shard for r in rows)
    assert not rows or max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))


def test_counts_and_slots(spark):
    docs = documents(spark, [(i, words(i % 90, 20), "s") for i in range(1000)], clash=False)
    first, again = with_shards(docs), with_shards(docs.repartition(5))
    check(first.collect())
    assert sorted(first.collect()) == sorted(again.collect())


def test_edges(spark):
    docs = documents(spark)
    out = with_shards(docs)
    assert out.count() == docs.count()
    check(out.collect())
    check(with_shards(documents(spark, [(None, "same", "s")] * 100)).collect())
    assert with_shards(docs.limit(0)).count() == 0
    assert with_shards(docs.withColumn("shard", F.lit("x"))).schema["shard"].dataType.simpleString() == "int"
