import random

import pytest
from pyspark.sql import functions as F

from kermesse.constants import CHUNK_COLUMNS, CLEAN_COLUMNS
from kermesse.operators import chunks


def by_hand(text, size, overlap):
    """Windows of `size` every size - overlap characters until one reaches the end."""
    out, start = [], 0
    while start < len(text):
        out.append(text[start : start + size].strip())
        if start + size >= len(text):
            break
        start += size - overlap
    return [piece for piece in out if piece]


def split(spark, texts, *args):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.c for r in df.select("i", chunks.split_text(F.col("t"), *args).alias("c")).orderBy("i").collect()]


def test_lengths_around_the_boundaries(spark):
    texts = ["".join(chr(97 + i % 26) for i in range(n)) for n in (1, 999, 1000, 1001, 1850, 1851, 2700, 2701)]
    got = split(spark, texts)
    assert got == [by_hand(t, 1000, 150) for t in texts]
    assert [len(x) for x in got] == [1, 1, 1, 2, 2, 3, 3, 4]


@pytest.mark.parametrize("size, overlap", [(10, 0), (10, 9), (7, 3), (1, 0), (50, 20)])
def test_random_texts(spark, size, overlap):
    rng = random.Random(size * 100 + overlap)
    alphabet = "ab é\n\t😀 　"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120))) for _ in range(60)]
    texts += ["", "   ", "a" * size + " " * size * 2 + "b" * size]
    assert split(spark, texts, size, overlap) == [by_hand(t, size, overlap) for t in texts]


def test_chunks_cover_a_long_text(spark):
    text = "".join(chr(0x4E00 + i % 5000) for i in range(300_000))
    got = split(spark, [text])[0]
    assert got[0] + "".join(c[150:] for c in got[1:]) == text


@pytest.mark.parametrize("size, overlap", [(0, 0), (-1, 0), (5, -1), (5, 5), (5, 6)])
def test_bad_sizes(size, overlap):
    with pytest.raises(ValueError):
        chunks.split_text(F.lit("x"), size, overlap)


def test_chunk_rows(spark):
    df = spark.createDataFrame(
        [("u", "T", "a" * 4 + " " * 8 + "b" * 4, "kept", "not carried"), ("v", "T", " ", "kept", "x")],
        "uid string, title string, embedding_text string, age string, location_city string",
    )
    rows = chunks.explode_chunks(df, size=4, overlap=0).collect()
    assert [(r.chunk_id, r.chunk_index, r.chunk_text) for r in rows] == [("u_0", 0, "aaaa"), ("u_1", 1, "bbbb")]
    assert rows[0].__fields__ == list(CHUNK_COLUMNS)
    assert rows[0].age == "kept" and rows[0].status is None and rows[0].agenda_uids is None
    every = chunks.explode_chunks(df, size=4, overlap=0, carry=None)
    assert every.columns == ["uid", "title", "age", "location_city", "chunk_id", "chunk_index", "chunk_text"]


def test_document_text(spark):
    cells = {n: None for n in CLEAN_COLUMNS} | {
        "uid": "1", "title": " T ", "description": "D", "longDescription": "L", "keywords": "K", "dateRange": "DR",
        "timings": "H", "location_name": "N", "location_address": "A", "age": "P", "accessibility_text": "X",
        "conditions": " ", "mode_participation": "M", "status": "S",
    }
    df = spark.createDataFrame([tuple(cells.values())], ",".join(f"{n} string" for n in cells))
    row = chunks.with_document_text(df).first()
    assert row.embedding_text.split("\n") == [
        "Titre : T", "Description : D", "Description détaillée : L", "Mots-clés : K", "Date : DR", "Horaires : H",
        "Lieu : N", "Adresse : A", "Public : P", "Accessibilité : X", "Mode de participation : M", "Statut : S",
    ]
    assert chunks.explode_chunks(chunks.with_document_text(df)).columns == list(CHUNK_COLUMNS)


def test_documents_without_text(spark):
    df = spark.createDataFrame([("1", " "), ("2", "x")], "uid string, title string")
    loose = chunks.with_document_text(df, strict=False)
    assert chunks.count_empty_documents(loose).first()[0] == 1
    with pytest.raises(Exception, match="no text to embed for uid 1"):
        chunks.with_document_text(df).collect()
    with pytest.raises(ValueError):
        chunks.with_document_text(df.drop("title"))
