"""Mixing sources to target weights: exact block quotas, split among shards by a tree of draws.

Everything is DataFrame functions. Documents of a source are permuted by a hash and cut into blocks
of about BLOCK_WORDS words. A source's target says how often each block is drawn; a splitting tree
deals the draws to output shards: every node halves its shards and draws, source by source, how
many of its block draws go left, from the multivariate hypergeometric distribution. A leaf's share
of a source is a run of that source's permuted draws, so shards are disjoint and quotas exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kermesse.llm.common import WORD, materialise

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 1 << 20
SHARDS = 64
SEED = "mix"

c, lit = F.col, F.lit


def _steps(count: Column) -> Column:
    return F.when(count > 0, F.sequence(lit(1), count.cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items are marked, at the quantile `u` in [0, 1).

    The inverse of the distribution function, summed outwards from the mode to where what is left
    is below the precision of a double (14 standard deviations and 60 steps).
    """
    given = F.struct(
        population.cast("double").alias("n"),
        marked.cast("double").alias("k"),
        drawn.cast("double").alias("d"),
        u.alias("u"),
    )
    return _let(given, lambda g: _let(_bounds(g), lambda b: _let(_masses(g, b), lambda m: _at(g, b, m))))


def _bounds(g: Column) -> Column:
    """The mode, and how many steps are summed above and below it."""
    n, k, d = g["n"], g["k"], g["d"]
    low, high = F.greatest(lit(0.0), d + k - n), F.least(d, k)
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2)).cast("double")))
    share = k / F.greatest(n, lit(1.0))
    width = F.ceil(14 * F.sqrt(d * share * F.greatest(1 - share, lit(0.0)))).cast("double") + 60
    first = F.struct(mode.alias("mode"), low.alias("low"), high.alias("high"), width.alias("width"))
    return _let(
        first,
        lambda f: F.struct(
            f["mode"].alias("mode"),
            F.least(f["high"] - f["mode"], f["width"]).alias("up"),
            F.least(f["mode"] - f["low"], f["width"]).alias("down"),
        ),
    )


def _rise(g: Column, b: Column, j: Column) -> Column:
    """The weight of mode + j over that of mode + j - 1."""
    x = b["mode"] + j - 1
    return (g["k"] - x) * (g["d"] - x) / ((x + 1) * (g["n"] - g["k"] - g["d"] + x + 1))


def _fall(g: Column, b: Column, j: Column) -> Column:
    x = b["mode"] - j + 1
    return x * (g["n"] - g["k"] - g["d"] + x) / ((g["k"] - x + 1) * (g["d"] - x + 1))


def _masses(g: Column, b: Column) -> Column:
    """Summed weights above and below the mode, whose own weight is 1."""

    def mass(ratio, count: Column) -> Column:
        start = F.struct(lit(1.0).alias("w"), lit(0.0).alias("sum"))
        step = lambda acc, j: _let(
            acc["w"] * ratio(g, b, j),
            lambda w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum")),
        )
        return F.aggregate(_steps(count), start, step, lambda acc: acc["sum"])

    return F.struct(mass(_rise, b["up"]).alias("above"), mass(_fall, b["down"]).alias("below"))


def _at(g: Column, b: Column, m: Column) -> Column:
    """The value at the quantile: the mode, or as many steps as bring the sum past it."""

    def walk(ratio, count: Column, beyond: Column) -> Column:
        start = F.struct(lit(1.0).alias("w"), lit(0.0).alias("sum"), lit(0).alias("at"))
        step = lambda acc, j: _let(
            acc["w"] * ratio(g, b, j),
            lambda w: F.struct(
                w.alias("w"),
                (acc["sum"] + w).alias("sum"),
                F.when(acc["sum"] <= beyond, j).otherwise(acc["at"]).cast("int").alias("at"),
            ),
        )
        return F.aggregate(_steps(count), start, step, lambda acc: acc["at"])

    point = g["u"] * (1 + m["above"] + m["below"])
    return (
        F.when(point < 1, b["mode"])
        .when(point < 1 + m["above"], b["mode"] + walk(_rise, b["up"], point - 1))
        .otherwise(b["mode"] - walk(_fall, b["down"], point - 1 - m["above"]))
        .cast("long")
    )


def split_node(counts: Column, drawn: Column, label: Column) -> Column:
    """Array of how many of each source's `counts` are among `drawn` draws without replacement."""
    total = F.aggregate(counts, lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(
        total.alias("pool"), drawn.alias("need"), F.array().cast("array<bigint>").alias("out")
    )

    def step(acc: Column, count: Column) -> Column:
        digits = F.substring(F.md5(F.concat_ws(":", lit(SEED), label, F.size(acc["out"]))), 1, 13)
        u = F.conv(digits, 16, 10).cast("double") / lit(float(1 << 52))
        return _let(
            hypergeometric(acc["pool"], count, acc["need"], u),
            lambda x: F.struct(
                (acc["pool"] - count).alias("pool"),
                (acc["need"] - x).alias("need"),
                F.array_append(acc["out"], x).alias("out"),
            ),
        )

    return F.aggregate(counts, start, step, lambda acc: acc["out"])


def splitting_tree(root: DataFrame, shards: int) -> DataFrame:
    """(shard, counts) from one row (counts): each source's block draws in each shard."""
    nodes = root.select(lit(0).alias("low"), lit(shards).alias("high"), "counts")
    total = F.aggregate("counts", lit(0).cast("long"), lambda a, x: a + x)
    middle = F.floor((c("low") + c("high")) / 2).cast("int")
    drawn = F.floor(total * (middle - c("low")) / (c("high") - c("low"))).cast("long")
    left = split_node(c("counts"), drawn, F.concat_ws("-", "low", "high"))
    right = F.zip_with("counts", "left", lambda a, b: a - b)
    halves = F.array(
        F.struct("low", c("middle").alias("high"), c("left").alias("counts")),
        F.struct(c("middle").alias("low"), "high", right.alias("counts")),
    )
    whole = F.array(F.struct("low", "high", "counts"))
    children = F.explode(F.when(c("high") - c("low") > 1, halves).otherwise(whole)).alias("node")
    for _ in range(max(shards - 1, 0).bit_length()):
        parts = nodes.select("low", "high", "counts", middle.alias("middle"), left.alias("left"))
        nodes = parts.select(children).select("node.*")
    return nodes.select(c("low").alias("shard"), "counts")


def sized(docs: DataFrame, *kept: Column | str, id: str, text: str, source: str) -> DataFrame:
    """`kept`, and what a mix needs: size in words, source, its non-null key, permutation key."""
    named = F.concat(lit("s"), c(source).cast("string"))
    permuted = F.md5(
        F.concat(
            lit(SEED + ":"),
            F.coalesce(c(id).cast("string"), lit("-")),
            lit(":"),
            F.coalesce(text, lit("-")),
        )
    )
    return docs.select(
        *kept,
        F.coalesce(F.regexp_count(text, lit(WORD)), lit(0)).cast("long").alias("size"),
        F.coalesce(named, lit("n")).alias("source_key"),
        permuted.alias("place"),
    )


def targets(rows: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """One row per source: its size, target, whole passes and words of a last, partial pass.

    Weights repeat over the sources by code point, null last. Targets share all sizes by weight and
    stop at `max_repeats` times a size, the excess reshared. In order of the weight at which a
    source is full, the level of the others after i full ones is what is left over their weights;
    it rises while sources fill and falls after, so the level reached is the largest.
    """
    sums = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(c("source_key") == "n", "source_key")
    weight = F.element_at(
        F.array(*[lit(float(w)) for w in weights]), c("rank") % len(weights) + 1
    )
    full = (lit(max_repeats) * c("source_size")).cast("double")
    by_fill = Window.orderBy(full / c("weight"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - max_repeats * F.coalesce(
        F.sum("source_size").over(before), lit(0)
    )
    target = F.least(full, c("weight") * F.max("level").over(Window.partitionBy()))
    passes = F.when(c("source_size") > 0, F.floor(c("target") / c("source_size"))).otherwise(0)
    return (
        sums.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("level", left.cast("double") / F.sum("weight").over(onwards))
        .withColumn("target", target)
        .withColumn("passes", passes.cast("long"))
        .withColumn("partial", c("target") - c("passes") * c("source_size"))
        .select("source_key", "rank", "source_size", "target", "passes", "partial")
    )


def blocks(rows: DataFrame, plan: DataFrame, block_words: int, shards: int) -> DataFrame:
    """One row per block of a source: where it starts in the source's permuted words, and the shard
    of each of its draws, whole passes first."""
    sums = rows.groupBy("source_key", "block").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source_key").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = materialise(
        sums.withColumn("block_start", F.coalesce(F.sum("words").over(up_to), lit(0)))
        .join(plan, "source_key")
        .select(
            "source_key", "block", "block_start", "rank", "passes", "partial",
            (c("block_start") < c("partial")).alias("in_partial"),
            _block_count(block_words).alias("count"),
        )
    )
    # A pass draws blocks 0 to count - 1, empty ones too; the partial pass stops after the last
    # block that starts within it.
    quotas = placed.groupBy("rank").agg(
        (
            F.first("passes") * F.first("count")
            + F.coalesce(F.max(F.when(c("in_partial"), c("block") + 1)), lit(0))
        ).alias("draws")
    )
    root = quotas.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "draws"))), lambda x: x["draws"]
        ).alias("counts")
    )
    leaves = splitting_tree(root, shards).select("shard", F.posexplode("counts").alias("rank", "draws"))
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        leaves.withColumn("first", F.coalesce(F.sum("draws").over(earlier), lit(0)))
        .where("draws > 0")
        .groupBy("rank")
        .agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("leaves"))
    )
    draws = F.transform(
        _steps(c("passes") + c("in_partial").cast("long")),
        lambda turn: (turn - 1) * c("count") + c("block"),
    )
    shard_of = lambda draw: F.element_at(
        F.filter("leaves", lambda leaf: leaf["first"] <= draw), -1
    )["shard"]
    return placed.join(starts, "rank", "left").select(
        "source_key", "block", "block_start", F.transform(draws, shard_of).alias("shards")
    )


def _block_count(block_words: int) -> Column:
    return F.greatest(lit(1), F.ceil(c("source_size") / block_words)).cast("long")


def mix_rows(
    rows: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
) -> DataFrame:
    """`rows` of `sized`, with source_size, target, copies and the shard of each copy.

    A document is taken once per whole pass, and once more if it lies in its source's partial pass;
    the document across that pass's end is in if that is nearer. Prefix sums are taken within
    blocks and over the small table of blocks, so no task sees a whole source. Zero-word texts have
    no part in a partial pass. Ties can only be repeated rows, which are alike.
    """
    plan = materialise(targets(rows, weights, max_repeats))
    first_digits = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    block = F.shiftright(first_digits * _block_count(block_words), 32)
    dealt = rows.join(plan, "source_key").withColumn("block", block)
    table = materialise(blocks(dealt.select("source_key", "block", "size"), plan, block_words, shards))
    inside = Window.partitionBy("source_key", "block").orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1
    )
    start = c("block_start") + F.coalesce(F.sum("size").over(inside), lit(0))
    extra = (c("size") > 0) & (2 * c("start") + c("size") <= 2 * c("partial"))
    copies = F.least(lit(max_repeats), c("passes") + extra.cast("long"))
    return (
        dealt.join(table, ["source_key", "block"])
        .withColumn("start", start)
        .withColumn("copies", copies)
        .withColumn("shards", F.slice("shards", lit(1), c("copies").cast("int")))
        .drop("start", "block", "block_start", "passes", "partial", "rank")
    )


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The documents of a mix, each as often as it is taken, with their columns.

    Rows come shard by shard as a file order would: `mix_rows` holds the shard of every copy and
    this deals the copies to partitions by it and shuffles each shard by a hash of its copies.
    """
    rows = sized(docs, F.struct("*").alias("row"), id=id, text=text, source=source)
    taken = mix_rows(rows, **options).select("row", "place", F.posexplode("shards").alias("copy", "shard"))
    return (
        taken.repartition("shard", F.xxhash64("place", "copy") % 16)
        .sortWithinPartitions("shard", F.xxhash64("place", "copy"))
        .select("row.*")
    )


ORACLE = """
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '-')) AS place
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sums
), weighed AS (
  SELECT *, (CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight FROM ranked
), levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
      ORDER BY (3 * source_size)::DOUBLE / weight, rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, rank
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), aims AS (
  SELECT source, source_size,
    least((3 * source_size)::DOUBLE, weight * max(level) OVER ()) AS target
  FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes
  FROM aims
), placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.passes,
    p.target - p.passes * p.source_size AS partial,
    coalesce(sum(s.size) OVER (PARTITION BY p.source ORDER BY s.place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  (size * least(3, passes + CASE WHEN size > 0 AND 2 * start + size <= 2 * partial
    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
