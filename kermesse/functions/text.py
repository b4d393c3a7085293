"""Text columns: stripping, cleaning, joining, labelling, date rendering."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kermesse.constants import (
    DATETIME_PATTERN,
    DATETIME_SHOWN,
    MISSING_WORDS,
    RULE_PATTERN,
    TAG_PATTERN,
    WHITESPACE,
    WHITESPACE_RUN,
)


def strip(c: Column) -> Column:
    """Remove white space, as Unicode defines it, from both ends."""
    return F.trim(c, F.lit(WHITESPACE))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def valid_text(c: Column) -> Column:
    """Stripped text, or null when nothing is left."""
    return empty_to_null(strip(c.cast("string")))


def clean_text(c: Column) -> Column:
    """Drop tags and drawn rules, squeeze white space; Markdown and emoji stay."""
    # No tag ends after the last ">". Leaving that rest out keeps the search linear: there, every
    # "<" would be followed to the end of the text in vain.
    rest = F.substring_index(c, ">", -1)
    tagged = F.left(c, F.length(c) - F.length(rest))
    bare = F.concat(F.regexp_replace(tagged, TAG_PATTERN, " "), rest)
    bare = F.regexp_replace(bare, RULE_PATTERN, " ")
    return empty_to_null(strip(F.regexp_replace(bare, WHITESPACE_RUN, " ")))


def join_list(c: Column, separator: str = ", ", *, distinct: bool = True) -> Column:
    """Join a list of texts: stripped, missing dropped, first sight of each kept."""
    items = F.filter(
        F.transform(c, strip),
        lambda x: x.isNotNull() & ~F.lower(x).isin(*MISSING_WORDS),
    )
    return empty_to_null(F.array_join(F.array_distinct(items) if distinct else items, separator))


def join_present(items: Column, separator: str = " | ") -> Column:
    """Join the non-null texts of an array; null when there are none."""
    return empty_to_null(F.array_join(items, separator))


def labelled_text(
    pairs: Iterable[tuple[str, Column]],
    separator: str,
    *,
    strip_values: bool = False,
    blank_is_value: bool = False,
) -> Column:
    """"Label : value" parts of the values present, joined; "" when none is.

    A blank value is left out unless `blank_is_value`; then only null and "" are.
    """
    parts = []
    for label, value in pairs:
        text = value.cast("string")
        if strip_values:
            cell = valid_text(text)
        elif blank_is_value:
            cell = empty_to_null(text)
        else:
            cell = F.when(valid_text(text).isNotNull(), text)
        # A null cell makes its whole part null, and concat_ws skips it.
        parts.append(F.concat(F.lit(f"{label} : "), cell))
    return F.concat_ws(separator, *parts)


def format_datetime(c: Column) -> Column:
    """ISO text as "31/12/2024 à 20h30" in the wall time it was written in; bad text gives null."""
    # Not date_format: it goes through the session's zone, where this wall time may not exist.
    wall = c.try_cast("timestamp_ntz").cast("string")
    return F.regexp_replace(wall, DATETIME_PATTERN, DATETIME_SHOWN)


def wall_micros(c: Column) -> Column:
    """Microseconds from 1970-01-01 to a timestamp without zone, whatever the session zone is.

    Built from its fields: differences and casts would go through the session's zone.
    """
    day = F.unix_date(c.cast("date")).cast("long")
    whole = (day * 24 + F.hour(c)) * 60 + F.minute(c)
    return whole * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def utc_timestamp(c: Column) -> Column:
    """ISO text as an instant; text without an offset is UTC whatever the session zone is."""
    has_zone = F.rlike(strip(c), F.lit(r"[T ]\d.*(?:[Zz]|[+-]\d{1,2}:?\d{0,2}|[A-Za-z])$"))
    as_utc = F.timestamp_micros(wall_micros(c.try_cast("timestamp_ntz")))
    return F.when(has_zone, c.try_cast("timestamp")).otherwise(as_utc)
