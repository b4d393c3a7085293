"""Nested event fields rendered as readable text or flat columns."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from kermesse.constants import (
    ACCESSIBILITY_LABELS,
    LINK_LABELS,
    LINK_THUMBNAIL_LABEL,
    LINK_URL_LABEL,
    LOCATION_FIELDS,
    LOCATION_LABELS,
    MISSING_WORDS,
    NO_ACCESSIBILITY,
    REGISTRATION_DEFAULT,
    REGISTRATION_LABELS,
)
from kermesse.functions.text import (
    empty_to_null,
    format_datetime,
    join_present,
    labelled_text,
    strip,
    valid_text,
)


def literal_map(table: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def map_codes(c: Column, table: Mapping) -> Column:
    """Label of a code; null for a code the table lacks."""
    return F.try_element_at(literal_map(table), c)


def canonicalise(c: Column, aliases: Mapping[str, str]) -> Column:
    """Stripped lower-case text, replaced by its canonical form where an alias is known."""
    key = F.lower(strip(c))
    return F.coalesce(F.try_element_at(literal_map(aliases), key), key)


def format_timing(timing: Column) -> Column:
    begin = format_datetime(timing.getField("begin"))
    end = format_datetime(timing.getField("end"))
    # A null part makes its whole sentence null, so each time is mostly computed once only.
    return F.coalesce(
        F.concat(F.lit("Du "), begin, F.lit(" au "), end),
        F.concat(F.lit("À partir du "), begin),
        F.concat(F.lit("Jusqu'au "), end),
    )


def format_all_timings(timings: Column) -> Column:
    return join_present(F.transform(timings, format_timing))


def format_accessibility(flags: Column) -> Column:
    """Labels of the known codes set to true, in map order; a fixed sentence when there are none."""
    labels = literal_map(ACCESSIBILITY_LABELS)
    codes = F.map_keys(F.map_filter(flags, lambda _, on: on))
    text = join_present(F.transform(codes, lambda code: F.try_element_at(labels, code)), ", ")
    return F.when(flags.isNotNull(), F.coalesce(text, F.lit(NO_ACCESSIBILITY)))


def format_image(image: Column) -> Column:
    """URL of the first "full" variant that has a file, else of the image itself."""
    full = F.get(
        F.filter(
            image.getField("variants"),
            lambda v: (v.getField("type") == "full")
            & empty_to_null(v.getField("filename")).isNotNull(),
        ),
        F.lit(0),
    ).getField("filename")
    name = F.coalesce(full, empty_to_null(image.getField("filename")))
    return F.concat(F.coalesce(image.getField("base"), F.lit("")), name)


def format_registration(items: Column) -> Column:
    known = literal_map(REGISTRATION_LABELS)

    def render(item: Column) -> Column:
        value = item.getField("value").cast("string")
        kind = empty_to_null(F.lower(strip(item.getField("type"))))
        label = F.coalesce(
            F.try_element_at(known, kind),
            F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 2**31 - 1)),
            F.lit(REGISTRATION_DEFAULT),
        )
        return F.when(
            ~F.lower(strip(value)).isin(*MISSING_WORDS), F.concat(label, F.lit(" : "), value)
        )

    return join_present(F.transform(items, render))


def localised_text(texts: Column, language: str = "fr") -> Column:
    """The language's text of a language map, else the map's first text that is not blank."""
    stripped = F.transform(F.map_values(texts), valid_text)
    first = F.get(F.filter(stripped, lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(valid_text(F.try_element_at(texts, F.lit(language))), first)


def localised_json(c: Column, language: str = "fr") -> Column:
    """`localised_text` of a cell that is either plain text or a language map as JSON text."""
    # The parser is slow to fail: it gets no text that does not close what it opens.
    is_object = F.startswith(c, F.lit("{")) & F.contains(c, F.lit("}"))
    texts = F.when(is_object, F.from_json(c, "map<string,string>"))
    return F.when(texts.isNull(), valid_text(c)).otherwise(localised_text(texts, language))


def location_text(location: Column) -> Column:
    localised = {"description", "access"}
    pairs = [
        (label, localised_json(location.getField(f)) if f in localised else location.getField(f))
        for label, f in LOCATION_LABELS
    ]
    return empty_to_null(labelled_text(pairs, " | ", blank_is_value=True))


def location_columns(location: Column) -> dict[str, Column]:
    return {f"location_{name}": location.getField(field) for name, field in LOCATION_FIELDS}


def format_age(age: Column) -> Column:
    low, high = (age.getField(f).cast("string") for f in ("min", "max"))
    return F.coalesce(
        F.concat(F.lit("De "), low, F.lit(" à "), high, F.lit(" ans")),
        F.concat(F.lit("À partir de "), low, F.lit(" ans")),
        F.concat(F.lit("Jusqu'à "), high, F.lit(" ans")),
    )


def format_links(links: Column, *, thumbnail: bool = False) -> Column:
    """Each link's URL and the labelled parts of its `data` struct, all in one line."""
    labels = LINK_LABELS + ((LINK_THUMBNAIL_LABEL,) if thumbnail else ())

    def render(item: Column) -> Column:
        data = item.getField("data")
        pairs = [(LINK_URL_LABEL, item.getField("link"))]
        pairs += [(label, data.getField(field)) for label, field in labels]
        return empty_to_null(labelled_text(pairs, " | ", blank_is_value=True))

    return join_present(F.transform(links, render))
