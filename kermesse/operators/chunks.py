"""Event documents and their overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kermesse.constants import CHUNK_COLUMNS, CHUNK_OVERLAP, CHUNK_SIZE, DOCUMENT_LABELS
from kermesse.functions.text import empty_to_null, labelled_text, strip
from kermesse.operators.columns import require_columns

# Types of the chunk columns that are no text.
NOT_TEXT = {
    "agenda_uids": "array<string>",
    "location_latitude": "double",
    "location_longitude": "double",
}


def with_document_text(
    df: DataFrame,
    *,
    labels: Iterable[tuple[str, str]] = DOCUMENT_LABELS,
    strict: bool = True,
) -> DataFrame:
    """Add `embedding_text`, one "Label : value" line per column present.

    `strict` makes the run fail at the first row that has no text at all.
    """
    require_columns(df, ("uid", "title"))
    have = set(df.columns)
    pairs = [(label, F.col(f"`{n}`")) for label, n in labels if n in have]
    text = labelled_text(pairs, "\n", strip_values=True)
    if strict:
        failure = F.raise_error(
            F.concat(F.lit("no text to embed for uid "), F.coalesce(F.col("uid"), F.lit("null")))
        ).cast("string")
        text = F.when(text != "", text).otherwise(failure)
    return df.withColumn("embedding_text", text)


def count_empty_documents(df: DataFrame) -> DataFrame:
    """One row: how many documents have no text."""
    empty = empty_to_null(strip(F.col("embedding_text"))).isNull()
    return df.agg(F.count_if(empty).alias("empty_documents"))


def split_text(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of stripped chunks of `size` characters, each `overlap` into the next.

    One regular-expression sweep: each match consumes the step and looks ahead a whole chunk, so
    the work is linear in the text however long it is. Chunks after the first one that reaches
    the end are cut off, blank ones dropped.
    """
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap < 0:
        raise ValueError("chunk overlap must not be negative")
    if overlap >= size:
        raise ValueError("chunk overlap must be smaller than the chunk size")
    step = size - overlap
    windows = F.regexp_extract_all(
        text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1)
    )
    last = F.greatest(F.ceil((F.length(text) - size) / F.lit(step)), F.lit(0)) + 1
    stripped = F.transform(F.slice(windows, F.lit(1), last.cast("int")), strip)
    return F.filter(stripped, lambda x: x != "")


def explode_chunks(
    df: DataFrame,
    *,
    text: str = "embedding_text",
    key: str = "uid",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    carry: Sequence[str] | None = CHUNK_COLUMNS,
) -> DataFrame:
    """One row per chunk: `chunk_id` = key_index, `chunk_index`, `chunk_text`, carried columns. A
    null key is written "None".

    `carry` names the output columns, so the schema is the same whichever columns the cleaning
    dropped: one that does not exist is null. None carries those that exist.
    """
    require_columns(df, (key, text))
    keep = [n for n in df.columns if n != text]
    chunks = df.select(
        *[F.col(f"`{n}`") for n in keep],
        F.posexplode(split_text(F.col(text), size, overlap)).alias("chunk_index", "chunk_text"),
    )
    chunks = chunks.withColumn(
        "chunk_id",
        F.concat_ws("_", F.coalesce(F.col(key).cast("string"), F.lit("None")), F.col("chunk_index")),
    )
    if carry is None:
        return chunks.select(*keep, "chunk_id", "chunk_index", "chunk_text")
    have = set(chunks.columns)
    absent = [n for n in carry if n not in have]
    nulls = {n: F.lit(None).cast(NOT_TEXT.get(n, "string")) for n in absent}
    return chunks.withColumns(nulls).select(*carry)
