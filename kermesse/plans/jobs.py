"""Batch jobs: import and clean, embed, index, and the whole rebuild.

Every step writes its table before the next one reads it, so a lost executor costs a stage and
a failed job costs a step; counts come from the written tables, which retries cannot inflate.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kermesse.constants import CHUNK_OVERLAP, CHUNK_SIZE, EMBED_BATCH, LANGUAGE
from kermesse.operators.chunks import explode_chunks, with_document_text
from kermesse.operators.columns import drop_constant
from kermesse.operators.merge import keyless_rows
from kermesse.operators.models import Embedder, embed_table
from kermesse.operators.vectors import check_alignment, check_index, normalise_vectors
from kermesse.plans.clean import clean_events
from kermesse.sources import pages
from kermesse.sources.store import (
    claim_version,
    publish,
    save_documents,
    version_path,
    write_table,
)


def import_and_clean(
    spark: SparkSession,
    agenda_path: str,
    event_path: str,
    out: Callable[[str], str],
    *,
    max_agendas: int | None = None,
    city: str | None = None,
    as_of: dt.date | None = None,
    page_per_file: bool = False,
    packed_events: bool = False,
    language: str = LANGUAGE,
    null_keys: str = "group",
) -> DataFrame:
    """Landed pages to the clean events table; `out` gives the path of each table by name.

    Writes `pages` (parsed once), `rejects`, `merged` and `events`. `city`, `as_of` and `language`
    apply what the source would have applied to a request. A listing that lacks a page is an error;
    an agenda that does goes to `rejects`. With `null_keys="apart"` events without a `uid` are not
    merged into one but written to `keyless`. `packed_events`: event pages are as `land_pages` writes
    them.
    """
    listing = pages.read_pages(spark, agenda_path, page_per_file=page_per_file)
    listed = write_table(pages.first_agendas(pages.agendas(listing), max_agendas), out("agendas"))
    if gap := pages.listing_gaps(listing).first():
        raise ValueError(f"the listing lacks page {gap.missing_page}")
    landed = pages.read_pages(
        spark, event_path, page_per_file=page_per_file, packed=packed_events
    )
    parsed = pages.explode_landed(landed, language=language)
    tagged = write_table(pages.tag_pages(parsed, listed), out("pages"))
    events, rejects = pages.accept_events(tagged)
    write_table(rejects, out("rejects"))
    if city is not None:
        events = pages.in_city(events, city)
    if as_of is not None:
        events = pages.recent_only(events, as_of)
    if null_keys == "apart":
        write_table(keyless_rows(events, "uid"), out("keyless"))
    merged = write_table(clean_events(events, null_keys=null_keys), out("merged"))
    return write_table(drop_constant(merged), out("events"))


def embed_events(
    events: DataFrame,
    embedder: Callable[[], Embedder],
    out: Callable[[str], str],
    *,
    batch_size: int = EMBED_BATCH,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> tuple[DataFrame, DataFrame]:
    """Clean events to `documents` (one row per chunk) and `vectors`, both keyed by chunk id."""
    chunks = explode_chunks(with_document_text(events), size=size, overlap=overlap)
    documents = save_documents(chunks, out("documents"))
    rows = documents.count()  # from the footers of the written table
    if not rows:
        raise ValueError("no text to embed")
    vectors = embed_table(
        documents, embedder, batch_size=batch_size, spread_by="chunk_id", rows=rows
    )
    vectors = write_table(vectors, out("vectors"))
    return documents, vectors


def build_index(vectors: DataFrame, documents: DataFrame, out: Callable[[str], str]) -> DataFrame:
    """Vectors to the `index` of unit vectors; raises when they do not fit the documents."""
    check_alignment(vectors, documents)
    check_index(vectors)
    return write_table(normalise_vectors(vectors), out("index"))


def rebuild(
    spark: SparkSession,
    agenda_path: str,
    event_path: str,
    root: str,
    embedder: Callable[[], Embedder],
    *,
    version: int | None = None,
    max_agendas: int | None = None,
    city: str | None = None,
    as_of: dt.date | None = None,
    batch_size: int = EMBED_BATCH,
    page_per_file: bool = False,
    packed_events: bool = False,
    language: str = LANGUAGE,
) -> dict[str, int]:
    """All steps into a new version folder, then publish it. Returns the counts published.

    The version is claimed first, so rebuilds that run at once write apart, and each is published
    whole; the newest is the one claimed last. Until the manifest row is written readers keep the
    previous version; a failed rebuild leaves an unpublished folder, whose number is not used again.
    """
    version = claim_version(spark, root, version)
    out = lambda table: version_path(root, version, table)
    events = import_and_clean(
        spark,
        agenda_path,
        event_path,
        out,
        max_agendas=max_agendas,
        city=city,
        as_of=as_of,
        page_per_file=page_per_file,
        packed_events=packed_events,
        language=language,
    )
    documents, vectors = embed_events(events, embedder, out, batch_size=batch_size)
    index = build_index(vectors, documents, out)
    counts = {
        "clean_events": events.count(),
        "chunks": documents.count(),
        "embedding_dimension": index.select(F.size("embedding")).first()[0],
        "indexed_vectors": index.count(),
    }
    publish(spark, root, {"version": version, **counts})
    return counts


def stage_counts(stages: Mapping[str, DataFrame]) -> DataFrame:
    """One row per stage: its rows and, where it has vectors, their dimension. One job in all."""
    union = None
    for name, df in stages.items():
        vectors = "embedding" in df.columns
        size = F.max(F.size("embedding")) if vectors else F.lit(None).cast("int")
        part = df.agg(
            F.lit(name).alias("stage"), F.count("*").alias("rows"), size.alias("dimension")
        )
        union = part if union is None else union.union(part)
    return union
