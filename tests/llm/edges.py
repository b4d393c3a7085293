"""Rows that every operator must take: nulls, blanks, long texts, ties, repeats, clashing names."""

import random

CLASHES = (
    "row_key arc piece runs rank place print kept n_words n_spans labels score size shards block "
    "removed fingerprint n_removed held copies target mark"
).split()


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


PROSE = words(1, 60, 5000)
ROWS = [
    (1, None, "b"),
    (2, "", None),
    (3, " \t\n  ", "a"),
    (4, PROSE, "a"),
    (5, PROSE, "a"),
    (5, PROSE, "a"),
    (6, PROSE, None),
    (7, words(2, 30_000), "b"),
    (8, "É ß İ K 日本語 text", "b"),
    (None, words(3, 40), "c"),
    (None, None, None),
]


def documents(spark, rows=ROWS, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({name: F.lit("mine") for name in CLASHES})
    return df


def unchanged(before, after):
    """Whether the clashing columns came through with what they held."""
    assert after.columns[: len(before.columns)] == before.columns
    return all(row[name] == "mine" for row in after.select(*CLASHES).collect() for name in CLASHES)
