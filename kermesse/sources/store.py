"""The vector store: one versioned folder of Parquet tables per rebuild, and its manifest."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kermesse.constants import CHUNK_COLUMNS
from kermesse.operators.columns import existing

MANIFEST = (
    "version long, clean_events long, chunks long, embedding_dimension int, indexed_vectors long"
)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write as Parquet, replacing what was there, and read it back: lineage ends here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write to the checkpoint folder and read back, so later steps neither recompute `df` nor
    depend on the executors that made it.

    The folder is the session's `spark.checkpoint.dir`, which a cluster points at shared storage, or
    where that is unset the context's checkpoint folder; this raises where there is neither. Who
    sets the folder also clears it.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return write_table(df, f"{folder.rstrip('/')}/kermesse-{uuid.uuid4().hex}")


def save_documents(chunks: DataFrame, path: str, key: str = "chunk_id") -> DataFrame:
    """Write the metadata columns that exist, sorted by key over all files and with a Bloom filter of
    the keys, so that a look-up of some keys reads the row groups that hold them."""
    kept = existing(chunks, CHUNK_COLUMNS)
    writer = kept.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite")
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
    return chunks.sparkSession.read.schema(kept.schema).parquet(path)


def put_if_absent(spark: SparkSession, uri: str, content: str) -> bool:
    """Create a small file with its whole content, unless it exists; whether it was created.

    Readers see it whole or not at all, and of many writers at once one succeeds: a local file is
    linked to its name, another is renamed without overwriting, which the store does atomically.
    """
    hadoop = spark._jvm.org.apache.hadoop
    path = hadoop.fs.Path(uri)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    target = files.makeQualified(path)
    files.mkdirs(target.getParent())
    draft = hadoop.fs.Path(target.getParent(), f".draft-{uuid.uuid4().hex}")
    if files.getScheme() == "file":
        place, draft = target.toUri().getPath(), draft.toUri().getPath()
        with open(draft, "x", encoding="utf-8") as out:
            out.write(content)
        try:
            os.link(draft, place)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    out = files.create(draft, False)
    out.write(content.encode())
    out.close()
    context = hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    options[0] = hadoop.fs.Options.Rename.NONE
    try:
        context.rename(draft, target, options)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" not in error.java_exception.toString():
            raise
        return False
    return True


def claim_version(spark: SparkSession, root: str, version: int | None = None) -> int:
    """A version number that no other rebuild has or will get: its folder is the caller's alone.

    Without a number, the next free one. Raises FileExistsError where the number asked for is taken.
    """
    mark = lambda number: f"{root.rstrip('/')}/claims/version-{number}"
    if version is not None:
        if not put_if_absent(spark, mark(version), ""):
            raise FileExistsError(f"version {version} is taken")
        return version
    version = (latest_version(spark, root) or 0) + 1
    while not put_if_absent(spark, mark(version), ""):
        version += 1
    return version


def version_path(root: str, version: int, table: str) -> str:
    return f"{root.rstrip('/')}/version={version}/{table}"


def published(spark: SparkSession, root: str) -> DataFrame | None:
    """The manifest: one row per finished rebuild; None before the first."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root.rstrip('/')}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_version(spark: SparkSession, root: str) -> int | None:
    manifest = published(spark, root)
    return None if manifest is None else manifest.agg(F.max("version")).first()[0]


def publish(spark: SparkSession, root: str, row: dict) -> None:
    """Add one manifest row, in one step. Readers see a version only once this is done; a version is
    published once. Nothing is shared with other writers, so any number may publish at a time."""
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    line = json.dumps({n: row[n] for n in names})
    if not put_if_absent(spark, f"{root.rstrip('/')}/manifest/version-{row['version']}.json", line + "\n"):
        raise FileExistsError(f"version {row['version']} is published already")


def load_tables(spark: SparkSession, out: Callable[[str], str], *names: str) -> list[DataFrame]:
    """Tables of one version; raises when one is absent, empty, or they differ in rows.

    Rows are counted from the Parquet footers. That keys match is checked once, at build time.
    """
    tables = []
    for name in names:
        try:
            tables.append(spark.read.parquet(out(name)))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise FileNotFoundError(f"table {name!r} not found at {out(name)}") from None
    counts = {name: df.count() for name, df in zip(names, tables)}
    if len(set(counts.values())) > 1:
        raise ValueError(f"tables differ in rows: {counts}")
    if not all(counts.values()):
        raise ValueError(f"tables are empty: {counts}")
    return tables


class VectorStore:
    """Index and documents of the newest finished version, loaded once until `reload`."""

    def __init__(self, spark: SparkSession, root: str, *, cache: bool = False):
        self._spark, self._root, self._cache = spark, root, cache
        self._loaded: tuple[DataFrame, DataFrame] | None = None

    def load(self) -> tuple[DataFrame, DataFrame]:
        """(index, documents); raises when there is no version or the two do not match."""
        if self._loaded is None:
            version = latest_version(self._spark, self._root)
            if version is None:
                raise FileNotFoundError(f"no finished version under {self._root}")
            out = lambda table: version_path(self._root, version, table)
            index, documents = load_tables(self._spark, out, "index", "documents")
            if self._cache:
                index, documents = index.cache(), documents.cache()
            self._loaded = index, documents
        return self._loaded

    def reload(self) -> tuple[DataFrame, DataFrame]:
        if self._loaded is not None and self._cache:
            for table in self._loaded:
                table.unpersist()
        self._loaded = None
        return self.load()
