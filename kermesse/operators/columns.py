"""Choosing columns: known ones in order, constant or sparse ones dropped."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kermesse.constants import NEVER_CONSTANT_COLUMNS, SPARSE_SHARE
from kermesse.functions.missing import comparison_key


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"required columns missing: {sorted(missing)}")


def existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that exist, in the order named."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") for n in names if n in have])


def constant_columns(
    df: DataFrame, protected: Sequence[str] = NEVER_CONSTANT_COLUMNS
) -> list[str]:
    """Columns with at most one distinct non-null value; one job whose result is one row.

    A column is constant when its smallest and largest comparison keys are equal, so no distinct
    set is built.
    """
    fields = [f for f in df.schema.fields if f.name not in protected]
    if not fields:
        return []
    keys = [comparison_key(F.col(f"`{f.name}`"), f.dataType) for f in fields]
    row = df.agg(
        *[
            F.coalesce(F.min(k) == F.max(k), F.lit(True)).alias(str(i))
            for i, k in enumerate(keys)
        ]
    ).first()
    return [f.name for f, constant in zip(fields, row) if constant]


def drop_constant(
    df: DataFrame, protected: Sequence[str] = NEVER_CONSTANT_COLUMNS
) -> DataFrame:
    """Without the constant columns. Runs a job over `df`, so hand it a written table."""
    return df.drop(*constant_columns(df, protected))


def sparse_columns(df: DataFrame, share: float = SPARSE_SHARE) -> list[str]:
    """Columns whose share of nulls reaches `share`; one job whose result is one row."""
    row = df.agg(
        *[F.avg(F.col(f"`{n}`").isNull().cast("int")).alias(str(i)) for i, n in enumerate(df.columns)]
    ).first()
    return [n for n, nulls in zip(df.columns, row) if nulls is not None and nulls >= share]


def drop_sparse(df: DataFrame, share: float = SPARSE_SHARE) -> DataFrame:
    return df.drop(*sparse_columns(df, share))
