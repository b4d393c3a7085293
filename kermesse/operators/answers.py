"""From questions to answers: guards, context, chat messages, generated text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kermesse.constants import (
    CONTEXT_LABELS,
    CONTEXT_SEPARATOR,
    DEFAULT_K,
    EMBED_BATCH,
    HUMAN_PROMPT,
    MAX_K,
    MIN_K,
    SYSTEM_PROMPT,
)
from kermesse.functions.text import labelled_text, valid_text
from kermesse.operators.models import Embedder, Generator, embed, generate
from kermesse.operators.vectors import (
    normalise_vectors,
    query_set,
    top_events,
    with_documents,
)


class Guarded(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def guard_questions(questions: DataFrame) -> Guarded:
    """Questions with text and a k within bounds, stripped; the others with their reason."""
    if "k" not in questions.columns:
        questions = questions.withColumn("k", F.lit(DEFAULT_K))
    k = F.coalesce("k", F.lit(DEFAULT_K))
    text = valid_text(F.col("question"))
    reason = F.when(text.isNull(), F.lit("empty question")).when(
        ~k.between(MIN_K, MAX_K), F.lit("k out of range")
    )
    judged = questions.withColumn("k", k.cast("int")).withColumn("reason", reason)
    accepted = judged.filter(F.col("reason").isNull()).drop("reason")
    return Guarded(
        accepted.withColumn("question", valid_text(F.col("question"))),
        judged.filter(F.col("reason").isNotNull()),
    )


def embed_questions(
    questions: DataFrame, factory: Callable[[], Embedder], *, batch_size: int = EMBED_BATCH
) -> DataFrame:
    """Add the unit vector of each question as `embedding`."""
    vectors = questions.withColumn(
        "embedding", embed(F.col("question"), factory, batch_size=batch_size)
    )
    return normalise_vectors(vectors)


def context_block(columns: Iterable[str], labels=CONTEXT_LABELS) -> Column:
    """Labelled lines of one result; values are shown as they are, blank ones left out."""
    have = set(columns)
    return labelled_text([(label, F.col(f"`{n}`")) for label, n in labels if n in have], "\n")


def build_context(results: DataFrame, labels=CONTEXT_LABELS) -> DataFrame:
    """One row per query: its blocks in rank order as `context`, its rows as `events`.

    A query has at most k results, so the lists gathered are short by construction.
    """
    cells = [F.col(f"`{n}`") for n in results.columns if n not in ("query_id", "rank")]
    ranked = F.struct(
        "rank", context_block(results.columns, labels).alias("text"), F.struct(*cells).alias("event")
    )
    gathered = results.groupBy("query_id").agg(F.collect_list(ranked).alias("_r"))
    by_rank = F.array_sort("_r", lambda a, b: a["rank"] - b["rank"])
    return gathered.select(
        "query_id",
        F.array_join(F.transform(by_rank, lambda x: x["text"]), CONTEXT_SEPARATOR).alias("context"),
        F.transform(by_rank, lambda x: x["event"]).alias("events"),
    )


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """The template with its {name} places filled; braces inside the values stay as they are."""
    parts = re.split(r"\{(%s)\}" % "|".join(map(re.escape, values)), template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def chat_messages(
    question: Column, context: Column, *, system: str = SYSTEM_PROMPT, human: str = HUMAN_PROMPT
) -> Column:
    """array<struct<role, content>> of the system rules and the question with its context."""
    filled = fill_template(human, {"question": question, "context": context})
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("human").alias("role"), filled.alias("content")),
    )


def echo_generator() -> Callable[[], Generator]:
    """Offline stand-in for a chat model: answers with the last message it was given."""

    def factory() -> Generator:
        import json

        return lambda prompts: [json.loads(p)[-1]["content"] for p in prompts]

    return factory


def retrieve(
    questions: DataFrame,
    index: DataFrame,
    documents: DataFrame,
    embedder: Callable[[], Embedder],
    *,
    batch_size: int = EMBED_BATCH,
) -> DataFrame:
    """Best events of each accepted question (query_id, question, k) with their documents.

    `index`: chunk_id, uid, unit `embedding`; `documents`: chunk_id and the columns to show.
    """
    asked = query_set(embed_questions(questions, embedder, batch_size=batch_size))
    found = top_events(index, asked, MAX_K)
    return with_documents(found, documents, max_rows=asked.max_rows(MAX_K))


def answer_questions(
    questions: DataFrame,
    index: DataFrame,
    documents: DataFrame,
    embedder: Callable[[], Embedder],
    generator: Callable[[], Generator],
    *,
    batch_size: int = EMBED_BATCH,
    system: str = SYSTEM_PROMPT,
    human: str = HUMAN_PROMPT,
) -> DataFrame:
    """query_id, question, answer and `events`, for every question that passes the guards."""
    accepted = guard_questions(questions).accepted
    results = retrieve(accepted, index, documents, embedder, batch_size=batch_size)
    return generate_answers(
        accepted, results, generator, batch_size=batch_size, system=system, human=human
    )


def generate_answers(
    questions: DataFrame,
    results: DataFrame,
    generator: Callable[[], Generator],
    *,
    batch_size: int = EMBED_BATCH,
    system: str = SYSTEM_PROMPT,
    human: str = HUMAN_PROMPT,
) -> DataFrame:
    """Answer of each question from its retrieved results."""
    asked = questions.select("query_id", "question").join(build_context(results), "query_id", "left")
    context = F.coalesce("context", F.lit(""))
    messages = chat_messages(F.col("question"), context, system=system, human=human)
    return asked.select(
        "query_id",
        "question",
        generate(F.to_json(messages), generator, batch_size=batch_size).alias("answer"),
        F.coalesce("events", F.array()).alias("events"),
    )


def json_records(df: DataFrame) -> DataFrame:
    """Rows as JSON objects in a `value` column: nulls kept, dates in ISO form."""
    cells = F.struct(*[F.col(f"`{n}`") for n in df.columns])
    return df.select(F.to_json(cells, {"ignoreNullFields": "false"}).alias("value"))
