"""The cleaning plan: raw event rows to one readable row per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kermesse.constants import (
    ATTENDANCE_LABELS,
    CLEAN_COLUMNS,
    DEPARTMENT_ALIASES,
    REGION_ALIASES,
    STATUS_LABELS,
)
from kermesse.functions import formats
from kermesse.functions.missing import normalise_missing
from kermesse.functions.text import clean_text, join_list, utc_timestamp, valid_text
from kermesse.operators.columns import drop_constant, existing
from kermesse.operators.merge import merge_by_key
from kermesse.sources.pages import INGEST_ORDER
from kermesse.sources.schemas import LINK_DATA, conform_raw
from kermesse.sources.store import materialise


def _image(image: Column) -> Column:
    return F.when(image["object"], formats.format_image(image)).otherwise(
        valid_text(image["text"])
    )


def _links(links: Column) -> Column:
    def data(x: Column) -> Column:
        # Other text has no fields, and the parser is slow to find that out.
        return F.when(F.regexp_like(x, F.lit(r"^\s*[\[{]")), F.from_json(x, LINK_DATA))

    parsed = F.transform(
        links, lambda x: F.struct(x["link"].alias("link"), data(x["data"]).alias("data"))
    )
    return formats.format_links(parsed)


def merge_events(raw: DataFrame, *, null_keys: str = "group") -> DataFrame:
    """Conformed, missing values nulled, one row per `uid`; `null_keys` as in `merge_by_key`."""
    work = conform_raw(raw)
    types = {f.name: f.dataType for f in work.schema.fields}
    if isinstance(types.get("updatedAt"), T.StringType):
        work = work.withColumn("updatedAt", utc_timestamp(F.col("updatedAt")))
    work = normalise_missing(work)
    ties = [n for n in INGEST_ORDER if n in work.columns]
    known = [n for n in work.columns if n in types and n not in INGEST_ORDER]
    has_agenda = {"agenda_uid", "agenda_title"} & set(known)
    return merge_by_key(
        work.select(*known, *ties),
        "uid",
        order_by="updatedAt" if "updatedAt" in known else None,
        tie_break=ties,
        base_only=sorted(has_agenda),
        gather={"agenda_uids": "agenda_uid"} if "agenda_uid" in has_agenda else None,
        gather_text={"agenda_titles": "agenda_title"} if "agenda_title" in has_agenda else None,
        normalised=True,
        null_keys=null_keys,
        count_first=True,
    )


def clean_events(
    raw: DataFrame, *, drop_constants: bool = False, null_keys: str = "group"
) -> DataFrame:
    """Clean rows, known columns in fixed order. `null_keys` as in `merge_by_key`.

    `drop_constants` also removes columns with a single value. Finding them takes a job, so the
    clean rows are written to the checkpoint folder first rather than computed twice.
    """
    merged = merge_events(raw, null_keys=null_keys)
    have = set(merged.columns)
    c = F.col
    out: dict[str, Column] = {n: c(n) for n in merged.columns if n in CLEAN_COLUMNS}
    for n in ("description", "longDescription", "conditions"):
        if n in have:
            out[n] = clean_text(c(n))
    if "keywords" in have:
        text = c("keywords_text") if "keywords_text" in have else F.lit(None).cast("string")
        out["keywords"] = F.when(c("keywords").isNotNull(), join_list(c("keywords"))).otherwise(text)
    if "agenda_titles" in have:
        out["agenda_titles"] = join_list(c("agenda_titles"))
    if "accessibility" in have:
        out["accessibility_text"] = formats.format_accessibility(c("accessibility"))
    if "attendanceMode" in have:
        out["mode_participation"] = formats.map_codes(c("attendanceMode"), ATTENDANCE_LABELS)
    if "status" in have:
        out["status"] = formats.map_codes(c("status"), STATUS_LABELS)
    if "timings" in have:
        out["timings"] = formats.format_all_timings(c("timings"))
    for n in ("firstTiming", "lastTiming", "nextTiming"):
        if n in have:
            out[n] = formats.format_timing(c(n))
    if "image" in have:
        out["image"] = _image(c("image"))
    if "registration" in have:
        out["registration"] = formats.format_registration(c("registration"))
    if "location" in have:
        out.update(formats.location_columns(c("location")))
        out["location_region"] = formats.canonicalise(out["location_region"], REGION_ALIASES)
        out["location_department"] = formats.canonicalise(
            out["location_department"], DEPARTMENT_ALIASES
        )
        out["location_text"] = formats.location_text(c("location"))
    if "age" in have:
        out["age"] = formats.format_age(c("age"))
    if "links" in have:
        out["links"] = _links(c("links"))
    clean = existing(merged.select(*[v.alias(n) for n, v in out.items()]), CLEAN_COLUMNS)
    return drop_constant(materialise(clean)) if drop_constants else clean
