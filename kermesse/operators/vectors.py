"""Exact cosine search: unit vectors, block products inside tasks, top-n per query.

Every vector meets every query, as an exact search must, but no pair is ever a row: a task
multiplies Arrow batches of vectors with the query matrix and keeps the best n per query.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kermesse.constants import DEFAULT_K, OVERFETCH
from kermesse.operators.columns import require_columns
from kermesse.sources.store import materialise

# A query matrix up to this size is handed to every task whole; a larger one block by block.
MAX_LOCAL_QUERIES = 4096
MAX_LOCAL_CELLS = 1 << 22
# Result rows up to this many may be broadcast to look up their documents.
MAX_BROADCAST_ROWS = 200_000
# Queries of a block where they are more.
QUERY_BLOCK = 4096
# Vector cells a task gathers before it streams many blocks of queries past them: 128 MB.
BUFFER_CELLS = 1 << 24
# Beyond so many tasks one vector in SAMPLE_OF bounds the scores first.
MANY_SPLITS = 64
SAMPLE_OF = 16
SAMPLE_SEED = 7
# Results up to this many look their documents up by pushed ids.
LOOKUP_ROWS = 512
# Partial winners of a query are cut in this many groups before the last cut.
FAN_IN = 64


def unit_vector(v: Column) -> Column:
    """Vector over its Euclidean length, as array<float>; a zero vector stays as it is."""
    wide = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))

    def scaled(n: Column) -> Column:
        return F.when(n > 0, F.transform(wide, lambda x: (x / n).cast("float"))).otherwise(
            v.cast("array<float>")
        )

    # Through a one-item array the norm is a bound variable. Named directly inside the lambda, it
    # would be computed again for every element.
    return F.get(F.transform(F.array(norm), scaled), F.lit(0))


def normalise_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, unit_vector(F.col(column)))


def index_profile(df: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: vectors, smallest and largest dimension, vectors that are null or hold a null, a
    NaN or an infinity."""
    size = F.size(column)
    infinite = F.lit(float("inf"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite)
    broken = F.col(column).isNull() | F.exists(column, bad)
    return df.agg(
        F.count("*").alias("vectors"),
        F.min(size).alias("min_dimension"),
        F.max(size).alias("max_dimension"),
        F.count_if(broken).alias("broken"),
    )


def check_index(df: DataFrame, column: str = "embedding") -> int:
    """Dimension of a sound index; raises when it is empty or its vectors do not form a matrix."""
    row = index_profile(df, column).first()
    if row.vectors == 0:
        raise ValueError("no vector to index")
    if row.broken or row.min_dimension != row.max_dimension or row.min_dimension < 1:
        raise ValueError(f"vectors do not form a matrix: {row.asDict()}")
    return row.max_dimension


def alignment_profile(
    vectors: DataFrame, documents: DataFrame, key: str = "chunk_id", documents_key: str | None = None
) -> DataFrame:
    """One row: rows and orphans of either side, and keys found more than once on one side.

    A union with one aggregation in place of an outer join: repeated keys cannot multiply.
    """
    sides = vectors.select(F.col(key).alias("k"), F.lit(1).alias("v"), F.lit(0).alias("d")).union(
        documents.select(F.col(documents_key or key).alias("k"), F.lit(0), F.lit(1))
    )
    per_key = sides.groupBy("k").agg(F.sum("v").alias("v"), F.sum("d").alias("d"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_key.agg(
        total("v").alias("vectors"),
        total("d").alias("documents"),
        F.count_if(F.col("d") == 0).alias("vectors_without_document"),
        F.count_if(F.col("v") == 0).alias("documents_without_vector"),
        F.count_if((F.col("v") > 1) | (F.col("d") > 1)).alias("repeated_keys"),
    )


def check_alignment(vectors: DataFrame, documents: DataFrame, key: str = "chunk_id") -> int:
    """Number of vectors; raises unless there are some and each has exactly one document."""
    row = alignment_profile(vectors, documents, key).first()
    if row.vectors == 0:
        raise ValueError("the index is empty")
    if row.vectors_without_document or row.documents_without_vector or row.repeated_keys:
        raise ValueError(f"vectors and documents do not match: {row.asDict()}")
    return row.vectors


class QuerySet(NamedTuple):
    """Query vectors, and the same as an Arrow table where they are proven small."""

    df: DataFrame
    local: pa.Table | None

    def max_rows(self, k: int) -> int | None:
        """Bound of the result rows at k per query; None when there is none."""
        return None if self.local is None else self.local.num_rows * k


def query_set(queries: DataFrame, *, max_local: int = MAX_LOCAL_QUERIES) -> QuerySet:
    """Checks the size of (query_id, embedding): at most `max_local` + 1 rows reach the driver."""
    require_columns(queries, ("query_id", "embedding"))
    local = queries.select("query_id", "embedding").limit(max_local + 1).toArrow()
    cells = pc.sum(pc.list_value_length(local.column("embedding"))).as_py() or 0
    small = local.num_rows <= max_local and cells <= MAX_LOCAL_CELLS
    return QuerySet(queries, local if small else None)


def _search_task(n: int, id_column: str, carry: Sequence[str], names: Sequence[str], asked):
    """The function a task runs over its batches of vectors: rows of the best n per query.

    `asked` is an Arrow table of queries, or the files of a written one. With a table, the best n are
    kept over the whole task. With files, a task gathers BUFFER_CELLS of vectors and streams the
    queries past them block by block, so the vectors are read once however many queries there are,
    and a task holds one block of them. A query's `bound` is a score its n-th best cannot be below.
    Kept free of references to this package, so workers need only numpy and pyarrow.
    """
    carry, names = list(carry), list(names)
    buffer_cells, block_rows, tile, width = BUFFER_CELLS, QUERY_BLOCK, 256, 8192

    def matrix(column, np):
        if hasattr(column, "combine_chunks"):
            column = column.combine_chunks()
            if hasattr(column, "num_chunks"):
                column = column.chunk(0)
        if column.null_count:
            raise ValueError("a vector is null")
        flat = column.flatten()
        if flat.null_count or len(flat) % max(len(column), 1):
            raise ValueError("vectors differ in dimension or hold nulls")
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        dims = len(flat) // max(len(column), 1)
        offsets = np.diff(column.offsets.to_numpy())
        if not (offsets == dims).all():
            raise ValueError("vectors differ in dimension")
        return values.reshape(len(column), dims)

    def best(table, np, pa):
        """Rows of the best n per query, ties by id."""
        order = table.sort_by(
            [("_q", "ascending"), ("score", "descending"), (id_column, "ascending")]
        )
        q = order.column("_q").to_numpy()
        first = np.searchsorted(q, q, side="left")
        return order.filter(pa.array(np.arange(len(q)) - first < n))

    def search(values, extra, queries, cut, kept, np, pa):
        """`kept` with the candidates among some vectors, and `cut` raised to what they prove: the
        n-th best score so far of each query, which later candidates must reach."""
        if values.shape[1] != queries.shape[1]:
            raise ValueError("queries and vectors differ in dimension")
        limit = max(4 * n * len(queries), 1 << 16)
        rows = sum(k.num_rows for k in kept)
        for q0 in range(0, len(queries), tile):
            for v0 in range(0, len(values), width):
                # Scores are single precision, as the stored vectors are.
                scores = (queries[q0 : q0 + tile] @ values[v0 : v0 + width].T).astype(np.float32)
                if not np.isfinite(scores).all():
                    raise ValueError("a vector or a query is not finite")
                low = cut[q0 : q0 + tile]
                reach = scores >= low[:, None]
                if scores.shape[1] > n and reach.sum() > 2 * n * len(low):
                    nth = np.partition(scores, scores.shape[1] - n, axis=1)[:, -n]
                    np.maximum(low, nth, out=low)
                    reach = scores >= low[:, None]
                q, v = np.nonzero(reach)
                found = extra.take(pa.array(v + v0))
                found = found.append_column("_q", pa.array(q + q0, pa.int64()))
                found = found.append_column("score", pa.array(scores[q, v], pa.float32()))
                kept.append(found)
                rows += len(q)
                if rows > limit:
                    kept[:] = [best(pa.concat_tables(kept), np, pa)]
                    rows = kept[0].num_rows

    def blocks(np):
        """(ids, matrix, bounds) of each block of queries."""
        if hasattr(asked, "num_rows"):
            tables = [asked]
        else:
            import re

            import pyarrow.parquet as pq
            from pyarrow import fs

            opened = (fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", f)) for f in asked)
            tables = (pq.read_table(path, filesystem=system) for system, path in opened)
        for table in tables:
            for start in range(0, table.num_rows, block_rows):
                part = table.slice(start, block_rows)
                bounds = np.full(part.num_rows, -np.inf, np.float32)
                if "bound" in part.column_names:
                    given = part.column("bound").to_numpy(zero_copy_only=False).astype(np.float32)
                    bounds = np.where(np.isnan(given), bounds, given)
                yield part.column("query_id"), matrix(part.column("embedding"), np), bounds

    def task(batches):
        import numpy as np
        import pyarrow as pa

        def rows(kept, ids):
            if kept:
                out = best(pa.concat_tables(kept), np, pa)
                out = out.append_column("query_id", ids.take(out.column("_q"))).select(names)
                yield from out.combine_chunks().to_batches()

        whole = list(blocks(np)) if hasattr(asked, "num_rows") else None
        held = [[] for _ in whole or ()]
        parts, cells = [], 0

        def flush():
            values = np.concatenate([matrix(b.column("embedding"), np) for b in parts])
            extra = pa.concat_tables([pa.table({c: b.column(c) for c in carry}) for b in parts])
            if whole is not None:
                for kept, (_, queries, cut) in zip(held, whole):
                    search(values, extra, queries, cut, kept, np, pa)
                return
            for ids, queries, cut in blocks(np):
                kept = []
                search(values, extra, queries, cut, kept, np, pa)
                yield from rows(kept, ids)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts.append(batch)
            cells += len(batch.column("embedding").flatten())
            if cells >= (buffer_cells if whole is None else 0):
                yield from flush()
                parts, cells = [], 0
        if parts:
            yield from flush()
        for kept, (ids, _, _) in zip(held, whole or ()):
            yield from rows(kept, ids)

    return task


def _result_type(vectors: DataFrame, queries: DataFrame, carry: Sequence[str]) -> T.StructType:
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType)]
    fields += [T.StructField(c, vectors.schema[c].dataType) for c in carry]
    return T.StructType([*fields, T.StructField("score", T.FloatType())])


def _candidates(vectors: DataFrame, asked: QuerySet, n: int, carry: Sequence[str]) -> DataFrame:
    """At most n rows per query and task (and, for queries that are not local, per buffer), at or
    above the query's bound: one pass over the vectors, which are not shuffled."""
    schema = _result_type(vectors, asked.df, carry)
    if asked.local is not None and asked.local.num_rows == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    source = asked.local if asked.local is not None else sorted(asked.df.inputFiles())
    task = _search_task(n, carry[0], carry, schema.names, source)
    return vectors.select(*carry, "embedding").mapInArrow(task, schema)


def _written(asked: QuerySet) -> QuerySet:
    """Queries that are too many for a task, as a written table with a file per block."""
    if asked.local is not None:
        return asked
    table = materialise(asked.df.select("query_id", "embedding"))
    width = table.agg(F.max(F.size("embedding"))).first()[0] or 1
    files = math.ceil(table.count() / max(1, min(QUERY_BLOCK, MAX_LOCAL_CELLS // width))) or 1
    return QuerySet(materialise(table.repartition(files)), None)


def _with_bounds(
    vectors: DataFrame, asked: QuerySet, n: int, id_column: str, sample_of: int
) -> QuerySet:
    """The queries with the n-th best score each has among one in `sample_of` vectors: no row below
    it can be among the best n of all. Some n * sample_of rows per query reach it, however many
    tasks there are."""
    sample = vectors.where(F.pmod(F.xxhash64(F.lit(SAMPLE_SEED), id_column), F.lit(sample_of)) == 0)
    top = _best(_candidates(sample, asked, n, [id_column]), n, id_column)
    full = top.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s"))
    # Sums may round otherwise in another block, so the bound is put a little lower.
    lower = (F.col("s") - F.abs("s") * F.lit(1e-5) - F.lit(1e-30)).cast("float")
    bounds = full.where(F.col("c") == n).select("query_id", lower.alias("bound"))
    if asked.local is None:
        joined = asked.df.join(bounds, "query_id", "left")
        return QuerySet(materialise(joined.repartition(len(asked.df.inputFiles()))), None)
    known = dict(bounds.collect())  # a number per local query
    column = pa.array([known.get(i) for i in asked.local.column("query_id").to_pylist()], pa.float32())
    return QuerySet(asked.df, asked.local.append_column("bound", column))


def _splits(df: DataFrame) -> int:
    """About how many tasks read `df`, by the planner's estimate of its size."""
    query, state = df._jdf.queryExecution(), df.sparkSession._jsparkSession.sessionState()
    size = int(str(query.optimizedPlan().stats().sizeInBytes()))
    return size // int(state.conf().filesMaxPartitionBytes())


def _best(found: DataFrame, n: int, id_column: str) -> DataFrame:
    """The best n rows of each query with their rank. A query's rows are cut in FAN_IN groups
    first, so that no task sees all of them."""
    best = [F.desc("score"), F.asc(id_column)]
    group = F.pmod(F.xxhash64(id_column), F.lit(FAN_IN))
    cut = found.withColumn("_g", group)
    cut = cut.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_g").orderBy(*best)))
    cut = cut.filter(F.col("_r") <= n).drop("_g", "_r")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return cut.withColumn("rank", rank).filter(F.col("rank") <= n)


def top_chunks(
    vectors: DataFrame,
    queries: DataFrame | QuerySet,
    n: int,
    *,
    id_column: str = "chunk_id",
    carry: Sequence[str] = (),
    two_phase: bool | None = None,
) -> DataFrame:
    """Best `n` vectors of each query by inner product: query_id, id, carried columns, score, rank.

    `vectors` (id_column, embedding) and `queries` (query_id, embedding) hold unit vectors.
    Scores are single precision; equal scores go by id. Fewer than n vectors give fewer rows.

    In two phases, one in SAMPLE_OF vectors first bounds each query's n-th score from below, and
    the pass over all vectors only gives rows that reach the bound. By default that is done where
    more than MANY_SPLITS tasks would give n rows per query each. The result is the same.
    """
    require_columns(vectors, (id_column, "embedding", *carry))
    asked = _written(queries if isinstance(queries, QuerySet) else query_set(queries))
    if two_phase if two_phase is not None else _splits(vectors) > MANY_SPLITS:
        asked = _with_bounds(vectors, asked, n, id_column, SAMPLE_OF)
    carry = [id_column, *[c for c in carry if c != id_column]]
    return _best(_candidates(vectors, asked, n, carry), n, id_column)


def first_per_key(
    df: DataFrame, group: Sequence[str], key: Sequence[str], order: Sequence[Column], k: int | Column
) -> DataFrame:
    """Best row of each key within a group, then the first `k` of them; adds `rank`."""
    once = F.row_number().over(Window.partitionBy(*group, *key).orderBy(*order))
    kept = df.withColumn("_n", once).filter(F.col("_n") == 1).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_events(
    vectors: DataFrame,
    queries: DataFrame | QuerySet,
    k: int = DEFAULT_K,
    *,
    overfetch: int = OVERFETCH,
    id_column: str = "chunk_id",
    event_column: str = "uid",
) -> DataFrame:
    """Best chunk of each of the `k` best events among the overfetch * k best chunks.

    A `k` column in `queries` sets each query's own k; where it is null the `k` given here counts.
    May return fewer than k events when few events fill the chunks fetched.
    """
    require_columns(vectors, (event_column,))
    asked = queries if isinstance(queries, QuerySet) else query_set(queries)
    most, limit = k, F.lit(k)
    if "k" in asked.df.columns:
        most = max(k, asked.df.agg(F.max("k")).first()[0] or 0)
    chunks = top_chunks(
        vectors, asked, overfetch * most, id_column=id_column, carry=[event_column]
    ).withColumnRenamed("rank", "chunk_rank")
    if "k" in asked.df.columns:
        own = asked.df.select("query_id", F.coalesce("k", F.lit(k)).alias("_k"))
        chunks = chunks.join(own, "query_id").filter(F.col("chunk_rank") <= overfetch * F.col("_k"))
        limit = F.col("_k")
    events = first_per_key(chunks, ["query_id"], [event_column], [F.asc("chunk_rank")], limit)
    return events.drop("_k", "chunk_rank")


def _any_of(column: Column, values: list) -> Column:
    """Equal to one of some values, as a balanced tree of comparisons: other than a long `isin`, it
    reaches the Parquet reader value by value."""
    if len(values) == 1:
        return column == F.lit(values[0])
    middle = len(values) // 2
    return _any_of(column, values[:middle]) | _any_of(column, values[middle:])


def with_documents(
    results: DataFrame, documents: DataFrame, *, id_column: str = "chunk_id", max_rows: int | None = None
) -> DataFrame:
    """Results with their document columns, joined by id only now that few rows are left.

    `max_rows` is a proven bound of the result rows. Up to LOOKUP_ROWS they are fetched now, and
    their ids go to the scan of the documents as a filter: of a table sorted by id, as
    `save_documents` writes it, only the row groups that may hold one are read. Up to
    MAX_BROADCAST_ROWS they are broadcast so the documents are not shuffled. Without a bound the
    planner decides by measured size.
    """
    extra = [n for n in documents.columns if n == id_column or n not in results.columns]
    wanted = documents.select(*extra)
    if max_rows is not None and max_rows <= LOOKUP_ROWS:
        rows = results.limit(LOOKUP_ROWS + 1).toArrow()
        if rows.num_rows > LOOKUP_ROWS:
            raise ValueError("more results than their bound")
        ids = sorted(set(rows.column(id_column).to_pylist()) - {None})
        results = results.sparkSession.createDataFrame(rows, results.schema)
        wanted = wanted.where(_any_of(F.col(id_column), ids) if ids else F.lit(False))
    if max_rows is not None and max_rows <= MAX_BROADCAST_ROWS:
        results = F.broadcast(results)
    return wanted.join(results, id_column)
