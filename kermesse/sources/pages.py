"""Landed pages of agendas and events, read as one distributed table.

Landing layout: JSON text, one page per line (or one per file), each page an object
`{"agenda_uid", "page", "events": [...], "after"}`, preferably under `agenda_uid=<id>/` folders
so that a page that cannot be read still tells whose it is. A folder costs a file to write, list and
open for each agenda; `land_pages` packs the pages of many agendas in a file, each with its owner.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kermesse.constants import DEFAULT_AGENDA_TITLE, LANGUAGE, RECENT_MONTHS
from kermesse.sources.schemas import AGENDA_PAGE, EVENT_PAGE, text_cells, truthy

INGEST_ORDER = ("ingest_agenda", "ingest_page", "ingest_pos")
# What a row of `explode_landed` knows of its page, beside the event.
CHAIN = ("is_event", "next_page", "open_end")


UNREADABLE = "a page cannot be read"
INCOMPLETE = "a page that a cursor points to is missing"


class EventImport(NamedTuple):
    events: DataFrame
    rejects: DataFrame


def land_pages(raw: DataFrame, path: str) -> None:
    """Write page text (`value`) packed with its owner (`folder_agenda`), in as many files as `raw`
    has partitions, however many agendas there are; `read_pages` reads it with `packed`."""
    line = F.to_json(F.struct("folder_agenda", F.col("value").alias("page")))
    raw.select(line.alias("value")).write.text(path)


def read_pages(
    spark: SparkSession, path: str, *, page_per_file: bool = False, packed: bool = False
) -> DataFrame:
    """Raw page text with the agenda named by its folder, or where `packed` by its line, if any."""
    if packed:
        line = F.from_json("value", "folder_agenda string, page string")
        lines = spark.read.option("recursiveFileLookup", "true").text(path).select(line.alias("line"))
        return lines.select(F.col("line.page").alias("value"), "line.folder_agenda")
    decode = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    # The path is a URI, and the folder's value is escaped once more, as partition values are.
    folder = decode(decode(F.regexp_extract("_metadata.file_path", "agenda_uid=([^/]+)/", 1)))
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=page_per_file)
        .select("value", F.nullif(folder, F.lit("")).alias("folder_agenda"))
    )


def parse_pages(raw: DataFrame, schema: str, items: str) -> DataFrame:
    """Pages as columns, with `unreadable` set where the page or its list cannot be parsed.

    A field of the wrong type inside an item is null and leaves the page readable.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    page = F.from_json("value", f"{schema}, _bad string", options)
    # Stands in for a page number where a page has none: any order will do, if always the same.
    stand_in = F.pmod(F.xxhash64("value"), F.lit(1 << 40))
    # A page cut short still tells its number, if that came first.
    lost = F.regexp_extract(F.col("p._bad"), r'"page"\s*:\s*(\d{1,18})\b', 1).try_cast("long")
    known = F.coalesce("p.page", lost)
    cursor = truthy(F.col("p.after"))
    others = [c for c in raw.columns if c != "value"]
    return raw.select(*others, stand_in.alias("stand_in"), page.alias("p")).select(
        *others,
        "p",
        F.coalesce(known, "stand_in").alias("number"),
        (F.col("p._bad").isNotNull() & F.col(f"p.{items}").isNull()).alias("unreadable"),
        F.when(cursor, known + 1).alias("next_page"),
        F.when(known.isNull(), cursor).alias("open_end"),
    )


def agendas(raw: DataFrame) -> DataFrame:
    """One row per listed agenda in listing order; an unreadable listing page is an error."""
    pages = parse_pages(raw, AGENDA_PAGE, "agendas")
    checked = pages.filter(
        F.when(F.col("unreadable"), F.raise_error(F.lit("unreadable agenda page"))).otherwise(
            F.lit(True)
        )
    )
    return checked.select("number", F.posexplode("p.agendas").alias("pos", "a")).select(
        F.col("a.uid").alias("agenda_uid"),
        F.col("a.title").alias("agenda_title"),
        (F.shiftleft("number", 20) + F.col("pos")).alias("ingest_agenda"),
    )


def first_agendas(listed: DataFrame, max_agendas: int | None) -> DataFrame:
    """The first agendas in listing order; all of them for None."""
    if max_agendas is None:
        return listed
    return listed.orderBy("ingest_agenda").limit(max_agendas)


def listing_gaps(raw: DataFrame) -> DataFrame:
    """Numbers of the listing pages that a landed page's cursor points to and that did not land;
    null where no page of an unnumbered listing ends it."""
    pages = parse_pages(raw, AGENDA_PAGE, "agendas").select("number", "next_page", "open_end")
    chain = pages.select(
        F.lit("").alias("agenda_uid"), F.col("number").alias("ingest_page"), "next_page", "open_end"
    )
    return _missing_pages(chain).select("missing_page")


def explode_landed(raw: DataFrame, *, language: str = LANGUAGE) -> DataFrame:
    """One row per event, and one per page that has none or cannot be read (`is_event` false).

    Text columns that hold a language map become their text in `language`. `next_page` is the page
    that a cursor points to; `open_end` tells, for a page without a number, whether it has a cursor.
    """
    pages = parse_pages(raw, EVENT_PAGE, "events")
    owner = F.col("p.agenda_uid")
    if "folder_agenda" in raw.columns:
        owner = F.coalesce(F.col("folder_agenda"), owner)
    lost = F.regexp_extract(F.col("p._bad"), r'"agenda_uid"\s*:\s*"?([^",}\s]+)', 1)
    flat = pages.select(
        F.coalesce(owner, F.nullif(lost, F.lit(""))).alias("agenda_uid"),
        F.col("number").alias("ingest_page"),
        "unreadable",
        "next_page",
        "open_end",
        F.posexplode_outer("p.events").alias("ingest_pos", "e"),
    )
    known = ("agenda_uid", "ingest_page", "ingest_pos", "unreadable", "next_page", "open_end")
    rows = flat.select(*known, F.col("e").isNotNull().alias("is_event"), "e.*")
    return text_cells(rows, language)


def explode_events(raw: DataFrame, *, language: str = LANGUAGE) -> DataFrame:
    """One row per event, and one row with `unreadable` set per page that cannot be read."""
    rows = explode_landed(raw, language=language)
    return rows.filter(F.col("unreadable") | F.col("is_event")).drop(*CHAIN)


def tag_events(
    events: DataFrame, listed: DataFrame, *, default_title: str = DEFAULT_AGENDA_TITLE
) -> DataFrame:
    """Events of the listed agendas with their agenda's title and place in the listing.

    No broadcast hint: the planner broadcasts a side only when it measures small, and adaptive
    execution splits an agenda that holds much of the data.
    """
    return events.join(_tags(listed, default_title), "agenda_uid")


def _tags(listed: DataFrame, default_title: str) -> DataFrame:
    return listed.withColumn("agenda_title", F.coalesce("agenda_title", F.lit(default_title)))


def tag_pages(
    exploded: DataFrame, listed: DataFrame, *, default_title: str = DEFAULT_AGENDA_TITLE
) -> DataFrame:
    """`tag_events` for exploded pages; an unreadable page without a known owner is kept too."""
    unowned = F.col("unreadable") & F.col("agenda_uid").isNull()
    return exploded.join(_tags(listed, default_title), "agenda_uid", "left").filter(
        F.col("ingest_agenda").isNotNull() | unowned
    )


def _missing_pages(chain: DataFrame) -> DataFrame:
    """(agenda_uid, missing_page) of each cursor without its page.

    Pages meet by (agenda, number), so an agenda of very many pages is spread over all tasks. Pages
    without a number have no order: of an agenda that has such pages, one must end without a cursor.
    """
    landed = chain.select("agenda_uid", F.col("ingest_page").alias("missing_page")).distinct()
    wanted = chain.where(F.col("next_page").isNotNull()).select(
        "agenda_uid", F.col("next_page").alias("missing_page")
    )
    gaps = wanted.distinct().join(landed, ["agenda_uid", "missing_page"], "left_anti")
    ends = chain.where(F.col("open_end").isNotNull()).groupBy("agenda_uid")
    endless = ends.agg(F.min("open_end").alias("endless")).where("endless")
    return gaps.union(endless.select("agenda_uid", F.lit(None).cast("long")))


def accept_events(tagged: DataFrame) -> EventImport:
    """Events of the agendas that landed whole, and the other agendas.

    An agenda with an unreadable page is left out as a whole and reported in `rejects`, and so is,
    where `tagged` comes from `explode_landed`, one that lacks a page which a cursor points to. Both
    results read `tagged`: hand in a written table and the pages are parsed only once.
    """
    none = F.lit(None).cast("long")
    faults = tagged.filter("unreadable").select("agenda_uid", F.lit(1).alias("bad"), none.alias("gap"))
    events = tagged.filter(~F.col("unreadable"))
    if "next_page" in tagged.columns:
        chain = tagged.select("agenda_uid", "ingest_page", "next_page", "open_end")
        missing = _missing_pages(chain.where(F.col("agenda_uid").isNotNull()))
        faults = faults.union(missing.select("agenda_uid", F.lit(0), "missing_page"))
        events = events.filter("is_event").drop(*CHAIN)
    bad = F.sum("bad")
    missing_pages = F.count_if(F.col("bad") == 0)
    rejects = faults.groupBy("agenda_uid").agg(
        bad.alias("bad_pages"),
        missing_pages.alias("missing_pages"),
        F.min("gap").alias("first_missing_page"),
        F.when(bad > 0, F.lit(UNREADABLE)).otherwise(F.lit(INCOMPLETE)).alias("reason"),
    )
    events = events.join(rejects.select("agenda_uid"), "agenda_uid", "left_anti")
    return EventImport(events.drop("unreadable"), rejects)


def _cutoff(as_of: dt.date, months: int) -> Column:
    return F.add_months(F.lit(as_of), -months)


def recent_only(df: DataFrame, as_of: dt.date, *, months: int = RECENT_MONTHS) -> DataFrame:
    """Events with any timing that begins on or after `as_of` less some months."""
    begins = lambda t: t.getField("begin").try_cast("timestamp_ntz").cast("date")
    return df.filter(F.exists("timings", lambda t: begins(t) >= _cutoff(as_of, months)))


def in_city(df: DataFrame, city: str) -> DataFrame:
    return df.filter(F.col("location.city") == city)


def stale_events(df: DataFrame, as_of: dt.date, *, months: int = RECENT_MONTHS) -> DataFrame:
    """Events whose last timing ended before `as_of` less some months."""
    end = F.col("lastTiming.end").try_cast("timestamp_ntz").cast("date")
    wanted = ("uid", "title", "firstTiming", "lastTiming", "agenda_title")
    return df.filter(end < _cutoff(as_of, months)).select(*[c for c in wanted if c in df.columns])
