"""What the operators share: tables, intermediate results, bounded slices of a batch, text rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WHITE_SPACE = r"\x20\x09-\x0D"
WORD = f"[^{WHITE_SPACE}]+"
SLICE_BYTES = 4 << 20
GROUP_BYTES = 8 << 20

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. A session without one gets its own, but only in local
    mode, where driver and tasks share the disk; elsewhere this raises."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kermesse-llm-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame, *partition_by: str, rows_per_file: int = 0) -> DataFrame:
    """Write to the shared folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def opened(uri: str):
    """(file system, path) of a URI, or of a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder."""
    folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    return folder


def drop_shuffles(spark: SparkSession) -> None:
    """Remove the shuffle files of frames that nobody holds any more. Spark does so when the driver's
    JVM collects its garbage, which may be after all steps of a job."""
    spark._jvm.System.gc()


def written(
    df: DataFrame, run: Callable[[Batches], Batches] | None = None, schema: str = "", rows_per_file: int = 0
) -> DataFrame:
    """`materialise` of `df`, or of `df.mapInArrow(run, schema)`, by files that the Python workers write.

    What `run` makes does not pass through the executors' JVM, and for Spark's own files the JVM starts
    processes that set their permissions, each as large as the JVM until it has begun. A file is read
    only if the task that wrote it came to its end.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    drop_shuffles(spark)
    shape = StructType.fromDDL(schema) if schema else df.schema
    folder, kinds = new_folder(spark), to_arrow_schema(shape)

    def save(batches: Batches) -> Batches:
        from pyarrow import parquet

        system, path = opened(folder)
        held: list[pa.RecordBatch] = []
        writer, name, rows = None, "", 0

        def flush() -> None:
            if held:
                writer.write_table(pa.Table.from_batches(held).cast(kinds))
                held.clear()

        def close() -> pa.RecordBatch:
            nonlocal writer, rows
            flush()
            writer.close()
            writer, rows = None, 0
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

        for batch in run(batches) if run else batches:
            step = rows_per_file or max(batch.num_rows, 1)
            for start in range(0, batch.num_rows, step):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.parquet"
                    writer = parquet.ParquetWriter(f"{path}/{name}", kinds, filesystem=system, compression="zstd")
                held.append(batch.slice(start, step))
                rows += held[-1].num_rows
                if sum(b.nbytes for b in held) >= GROUP_BYTES:
                    flush()
                if rows_per_file and rows >= rows_per_file:
                    yield close()
        if writer is not None:
            yield close()

    paths = [row["path"] for row in df.mapInArrow(save, "path string").collect()]
    return spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` is called so."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """Lower case such that exactly A-Z become ASCII letters: the two other characters whose lower
    case holds an ASCII letter, the Kelvin sign and the dotted capital I, are replaced first."""
    for sign, stand_in in (("K", "Ω"), ("İ", "Î")):
        text = F.replace(text, F.lit(sign), F.lit(stand_in))
    return F.lower(text)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs whose text is about `limit` bytes; a longer text is alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // limit
    start = 0
    while start < len(group):
        stop = max(start + 1, int(np.searchsorted(group, group[start], side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text in them); null is empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    filled = pa.concat_arrays([filled])
    _, offsets, data = filled.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]
