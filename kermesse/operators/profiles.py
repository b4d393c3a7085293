"""Data-quality profiles. Each is one pass with partial aggregation, however skewed the keys."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kermesse.functions.missing import comparison_key
from kermesse.functions.text import empty_to_null


def _key(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"`{k}`") for k in keys]


def duplicate_profile(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys (null not counted), rows in duplicated keys, keys duplicated."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    named = F.lit(True)
    for k in _key(keys):
        named = named & k.isNotNull()
    per_key = df.groupBy(*_key(keys)).agg(F.count("*").alias("_n"), F.first(named).alias("_named"))
    many = F.col("_n") > 1
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count_if("_named").alias("distinct_keys"),
        F.coalesce(F.sum(F.when(many, F.col("_n"))), F.lit(0)).alias("rows_in_duplicated_keys"),
        F.count_if(many & F.col("_named")).alias("duplicated_keys"),
    )


def _comparable(c: Column, dtype: T.DataType) -> Column:
    """A value in a type that orders, equal where comparison keys are; null where it is blank."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    if isinstance(dtype, (T.NumericType, T.DatetimeType, T.BooleanType)):
        return c
    return empty_to_null(comparison_key(c, dtype))


def _same_hash_other_text(cells: DataFrame, suspects: DataFrame, keys: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """(keys, _bits): the text columns, by place in `texts`, in which a suspected key holds several
    texts after all. Only rows of suspected keys are looked at."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(n).alias("t")) for i, n in enumerate(texts)])
    rows = cells.join(suspects, list(keys), "left_semi").select(*_key(keys), F.explode(pairs).alias("p"))
    distinct = rows.where("p.t is not null").select(*_key(keys), "p.i", "p.t").distinct()
    several = distinct.groupBy(*_key(keys), "i").agg(F.count("*").alias("n")).where("n > 1")
    bit = F.expr("shiftleft(cast(1 as bigint), i)")
    return several.groupBy(*_key(keys)).agg(F.bit_or(bit).alias("_bits"))


def conflict_profile(
    df: DataFrame, keys: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Per column, how many duplicated keys hold more than one distinct value, most first.

    A key conflicts when the smallest and largest of its values differ, so no distinct set is built.
    Text enters as a hash of 64 bits: two hashes prove a conflict, and keys whose several texts have
    one hash are compared by the texts themselves. Null and blank text are no values here; an empty
    list is one. Null keys do not count.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in (columns or df.columns) if c not in keys]
    # A projection each: nested, every use of a value would compute it again.
    values = {f"_v{i}": _comparable(F.col(f"`{n}`"), types[n]) for i, n in enumerate(columns)}
    cells = df.dropna(subset=keys).select(*_key(keys), *[v.alias(n) for n, v in values.items()])
    texts = [n for n in values if isinstance(cells.schema[n].dataType, T.StringType)]
    hashed = {n: F.when(F.col(n).isNotNull(), F.xxhash64(n)) if n in texts else F.col(n) for n in values}
    narrow = cells.select(*_key(keys), *[x.alias(n) for n, x in hashed.items()])
    differ = [(F.min(n) < F.max(n)).alias(f"_c{i}") for i, n in enumerate(values)]
    alike = F.lit(False)
    for n in texts:
        alike = alike | ((F.count(n) > 1) & (F.min(n) == F.max(n)))
    per_key = (
        narrow.groupBy(*_key(keys))
        .agg(F.count("*").alias("_n"), *differ, alike.alias("_alike"))
        .filter(F.col("_n") > 1)
    )
    # 63 text columns to a round, as many as there are bits.
    for start in range(0, len(texts), 63):
        some = texts[start : start + 63]
        suspects = per_key.where("_alike").select(*_key(keys))
        found = _same_hash_other_text(cells, suspects, keys, some)
        proven = {
            f"_c{n[2:]}": F.col(f"_c{n[2:]}") | (F.coalesce(F.getbit("_bits", F.lit(i)), F.lit(0)) == 1)
            for i, n in enumerate(some)
        }
        per_key = per_key.join(found, keys, "left").withColumns(proven).drop("_bits")
    counts = per_key.agg(
        F.count("*").alias("_keys"),
        *[F.count_if(F.col(f"_c{i}")).alias(f"_c{i}") for i in range(len(columns))],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("column"), F.col(f"_c{i}").alias("conflicting_keys"))
            for i, n in enumerate(columns)
        ]
    )
    share = F.try_divide(F.col("p.conflicting_keys") * 100.0, F.col("_keys"))
    return (
        counts.select("_keys", F.explode(pairs).alias("p"))
        .select("p.column", "p.conflicting_keys", F.round(share, 2).alias("conflicting_pct"))
        .orderBy(F.desc("conflicting_keys"), "column")
    )


def _one_row_to_columns(row: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("column"), F.col(f"_v{i}").alias(value))
            for i, n in enumerate(names)
        ]
    )
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def null_profile(df: DataFrame) -> DataFrame:
    """Share of nulls (and NaN) per column, largest first."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        null = c.isNull()
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            null = null | F.isnan(c)
        aggs.append(F.avg(null.cast("int")).alias(f"_v{i}"))
    return _one_row_to_columns(df.agg(*aggs), df.columns, "null_share").orderBy(
        F.desc("null_share"), "column"
    )


def column_summary(df: DataFrame) -> DataFrame:
    """Non-null count and type of each column, in column order."""
    counts = df.agg(*[F.count(F.col(f"`{n}`")).alias(f"_v{i}") for i, n in enumerate(df.columns)])
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.col(f"_v{i}").alias("non_null"),
                F.lit(f.dataType.simpleString()).alias("type"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counts.select(F.explode(cells).alias("p")).select("p.*")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How often each value of each column occurs, nulls included; values as comparison keys."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(
        *[
            F.struct(
                F.lit(n).alias("column"),
                comparison_key(F.col(f"`{n}`"), types[n]).alias("value"),
            )
            for n in (columns or df.columns)
        ]
    )
    return (
        df.select(F.explode(cells).alias("p"))
        .groupBy("p.column", "p.value")
        .agg(F.count("*").alias("n"))
    )
