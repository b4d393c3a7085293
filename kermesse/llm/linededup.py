"""Line dedup: content-defined chunks of lines; chunks found again anywhere are removed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kermesse.llm.common import free_name, materialise, slices

WINDOW_LINES = 2
CUT_ONE_IN = 4  # a boundary after one line in four, on average
LONG_LINE = 50  # words; such a line is a chunk by itself
HOT_CHUNK = 1000  # a chunk found more often meets its first occurrence in SALTS tasks
SALTS = 16


def chunks(text: str | None) -> list[tuple[int, int]]:
    """(first line, end) of the chunks of a text's lines.

    A rolling hash of the last WINDOW_LINES line hashes ends a chunk after one line in CUT_ONE_IN.
    A boundary depends on the lines right before it alone, so lines put in elsewhere shift nothing.
    """
    lines = (text or "").split("\n")
    found, start, window = [], 0, []
    for i, line in enumerate(lines):
        if len(line) >= 2 * LONG_LINE - 1 and len(line.split()) >= LONG_LINE:
            if start < i:
                found.append((start, i))
            found.append((i, i + 1))
            start, window = i + 1, []
            continue
        window = [*window[1 - WINDOW_LINES :], xxhash.xxh64_intdigest(line)]
        rolled = 0
        for value in window:
            rolled = (rolled * 0x9E3779B97F4A7C15 + value) & 0xFFFFFFFFFFFFFFFF
        if (rolled >> 32) % CUT_ONE_IN == 0:
            found.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        found.append((start, len(lines)))
    return found


def removable(lines: list[str]) -> bool:
    """Whether a chunk goes when repeated: two lines with words, or one long line."""
    full = sum(bool(line.strip()) for line in lines)
    return full >= 2 or full == 1 and sum(len(line.split()) for line in lines) >= LONG_LINE


def _chunk_rows(docs: DataFrame, row: str, order: str, text: str, with_text: bool) -> DataFrame:
    kinds = "chunk int, hash long" + ", chunk_text string" * with_text
    schema = StructType(
        [*docs.select(row, order).schema.fields, *StructType.fromDDL(kinds).fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows, numbers, hashes, texts = [], [], [], []
                for at, value in enumerate(part.column(text).to_pylist()):
                    lines = (value or "").split("\n")
                    for number, (start, end) in enumerate(chunks(value)):
                        if removable(lines[start:end]):
                            joined = "\n".join(lines[start:end])
                            rows.append(at)
                            numbers.append(number)
                            hashes.append(xxhash.xxh64_intdigest(joined) - (1 << 63))
                            texts.append(joined)
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(row).take(taken),
                        part.column(order).take(taken),
                        pa.array(numbers, pa.int32()),
                        pa.array(hashes, pa.int64()),
                        *([pa.array(texts, pa.string())] if with_text else []),
                    ],
                    names=schema.names,
                )

    return docs.select(row, order, text).mapInArrow(run, schema)


def repeated_chunks(docs: DataFrame, row: str, order: str, text: str) -> DataFrame:
    """(`row`, numbers): the chunks of a row that stand earlier in the same or another row.

    Chunks meet by hash first, without their text. Only those whose hash is found twice are read
    with their text, and are equal only if their bytes are. The first by `order` (nulls last), row
    and place stays. A chunk that millions of rows share is summed up before it is shuffled, and its
    rows are dealt to several tasks.
    """
    narrow = _chunk_rows(docs, row, order, text, with_text=False)
    again = materialise(narrow.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    # Merge joins at every size: texts meet in the same way on a small and on a large input.
    found = _chunk_rows(docs, row, order, text, with_text=True).join(again.hint("merge"), "hash")
    salt = F.when(F.col("n") > HOT_CHUNK, F.pmod(F.xxhash64(row, "chunk"), F.lit(SALTS))).otherwise(0)
    full = materialise(found.withColumn("salt", salt))
    place = F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("o"), F.col(row).alias("r"), "chunk")
    first = (
        full.groupBy("hash", "chunk_text")
        .agg(F.count("*").alias("times"), F.min(place).alias("first"), F.max("n").alias("n"))
        .where("times > 1")
        .select(
            F.col("hash").alias("hash_"),
            F.col("chunk_text").alias("chunk_text_"),
            "first",
            F.explode(
                F.sequence(F.lit(0), F.when(F.col("n") > HOT_CHUNK, SALTS - 1).otherwise(0))
            ).alias("salt_"),
        )
    )
    same = (F.col("hash") == F.col("hash_")) & (F.col("salt") == F.col("salt_"))
    later = full.join(
        first.hint("merge"), same & (F.col("chunk_text") == F.col("chunk_text_"))
    ).where((F.col(row) != F.col("first.r")) | (F.col("chunk") != F.col("first.chunk")))
    return later.groupBy(row).agg(F.collect_set("chunk").alias("numbers"))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with its repeated chunks cut out of `text`, and with n_lines, n_removed (lines).

    Columns n_lines and n_removed are replaced. The first occurrence, by id, of each chunk stays. A
    null text stays null, with one empty line. Rows equal in id and text count as one and are
    treated alike.
    """
    row, removed = free_name(docs, "row_key"), free_name(docs, "removed")
    key = F.md5(
        F.concat(F.coalesce(F.col(id).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("-")))
    )
    keyed = docs.drop("n_lines", "n_removed").withColumn(row, key)
    distinct = keyed.select(row, id, text)
    numbers = materialise(
        repeated_chunks(distinct, row, id, text).withColumnRenamed("numbers", removed)
    )
    joined = keyed.join(numbers.hint("merge"), row, "left")
    names = [name for name in keyed.columns if name != row]
    counts = StructType.fromDDL("n_lines long, n_removed long")
    out = StructType([*keyed.select(*names).schema.fields, *counts.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts, lines_of, gone_of = [], [], []
                cut = part.column(removed).to_pylist()
                for value, gone in zip(part.column(text).to_pylist(), cut):
                    lines, gone = (value or "").split("\n"), set(gone or ())
                    left, dropped = [], 0
                    for number, (start, end) in enumerate(chunks(value)) if gone else ():
                        if number in gone:
                            dropped += end - start
                        else:
                            left += lines[start:end]
                    texts.append("\n".join(left) if gone else value)
                    lines_of.append(len(lines))
                    gone_of.append(dropped)
                columns = [
                    pa.array(texts, part.schema.field(text).type) if n == text else part.column(n)
                    for n in names
                ]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(lines_of, pa.int64()), pa.array(gone_of, pa.int64())],
                    names=out.names,
                )

    return joined.mapInArrow(run, out)
