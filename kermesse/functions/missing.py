"""What counts as missing, and how two values are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kermesse.constants import MISSING_WORDS
from kermesse.functions.text import strip


JSON_START = r'^\s*([\[{"\d-]|true|false|null)'


def is_missing(c: Column, dtype: T.DataType) -> Column:
    """Null, NaN, blank text, the words "missing value", or an empty container.

    Zero and false are values. A struct is missing when none of its fields is set.
    """
    if isinstance(dtype, T.StringType):
        return c.isNull() | F.lower(strip(c)).isin(*MISSING_WORDS)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(dtype, T.StructType) and dtype.names:
        empty = c.isNull()
        unset = F.lit(True)
        for name in dtype.names:
            unset = unset & c.getField(name).isNull()
        return empty | unset
    return c.isNull()


def present(c: Column, dtype: T.DataType) -> Column:
    """The value, or null where it is missing."""
    return F.when(~is_missing(c, dtype), c)


def normalise_missing(df: DataFrame, *, containers_only: bool = False) -> DataFrame:
    """Turn missing values of every column into null (or only empty lists and objects)."""
    containers = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            present(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
            if not containers_only or isinstance(f.dataType, containers)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def holds_map(dtype: T.DataType) -> bool:
    """Whether values of the type hold keys in an order of their own."""
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(holds_map(f.dataType) for f in dtype.fields)
    return False


def comparison_key(c: Column, dtype: T.DataType) -> Column:
    """Text two values share exactly when they count as equal.

    Containers become JSON with nulls kept and object keys sorted; a struct's field order is
    fixed by its type, so only types holding a map pay for the sort (a trip through VARIANT).
    """
    if isinstance(dtype, T.VariantType):
        return F.to_json(c)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c, {"ignoreNullFields": "false"})
        return F.to_json(F.parse_json(text)) if holds_map(dtype) else text
    return strip(c.cast("string"))


def json_key(c: Column) -> Column:
    """`comparison_key` of an object held as JSON text; text that is not JSON is only stripped.

    Text that begins as no JSON does is not handed to the parser, which is slow to fail.
    """
    parsed = F.when(F.regexp_like(c, F.lit(JSON_START)), F.try_parse_json(c))
    return F.coalesce(F.to_json(parsed), strip(c))
