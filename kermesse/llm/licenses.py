"""License scans by a positional index of rare licence words, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kermesse.llm.common import ascii_lower

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_SCORE = 0.6


@dataclass(frozen=True)
class Template:
    """A licence notice: its words, and the phrase among them that must stand word for word."""

    label: str
    words: str
    phrase: str
    base: bool = False


# Wordings of notices.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("mit", "released under the mit license", "mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge",
    ),
    Template(
        "gpl-3.0",
        "licensed under the gnu general public license version 3",
        "general public license version 3",
    ),
    Template(
        "lgpl", "licensed under the gnu lesser general public license", "lesser general public license"
    ),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "mpl-2.0",
        "subject to the terms of the mozilla public license v 2 0",
        "mozilla public license",
    ),
)


def license_words(text: Column) -> Column:
    """The words of a whole text, A-Z in lower case; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def rarity(words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """The inverse document frequency of each template word, over all rows of `words` (words)."""
    known = sorted({word for t in templates for word in t.words.split()})
    present = F.array_intersect("words", F.array(*map(F.lit, known)))
    rows = words.select(F.explode(F.array_append(present, F.lit(""))).alias("word"))  # "": the row
    counts = dict(rows.groupBy("word").agg(F.count("*")).collect())  # a row a template word
    total = counts.get("", 0)
    return {word: math.log((total + 1) / (counts.get(word, 0) + 1)) + 1 for word in known}


def _all(items: list[Column], join) -> Column:
    return reduce(join, items)


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """`docs` without its text, with n_words, n_base, first_word, last_word, base_labels, labels and
    score; columns of these names are replaced.

    The index has, for each template, the word of its mandatory phrase that is rarest in the
    corpus, and where in the phrase it stands. A file's occurrences of these words give the places
    where a template may begin; there the phrase is verified word by word, and the other words of
    the template are counted at their relative positions, by rarity. A base phrase is its own
    template. Other labels need `min_score`. A null or empty text has no words, empty labels, score
    0. The text is read twice, once for the frequencies; rows never meet and nothing is shuffled
    but one count a template word.
    """
    out = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rest = docs.drop(text, *out).columns
    weight = rarity(docs.select(license_words(F.col(text)).alias("words")), templates)

    def rare(template: Template) -> tuple[str, int]:
        phrase = template.phrase.split()
        at = max(range(len(phrase)), key=lambda i: (weight[phrase[i]], -i))
        return phrase[at], at

    looked_up = sorted({rare(t)[0] for t in templates})
    words, hits = F.col("words"), F.col("hits")

    def begins(template: Template) -> Column:
        """Places where the mandatory phrase stands."""
        word, at = rare(template)
        phrase = F.array(*map(F.lit, template.phrase.split()))
        places = F.filter(hits, lambda h: (h["word"] == word) & (h["place"] >= at))
        return F.filter(
            F.transform(places, lambda h: h["place"] - at),
            lambda begin: F.slice(words, begin + 1, len(template.phrase.split())) == phrase,
        )

    def score(template: Template, number: int) -> Column:
        """The largest share of the template's rarity found where the phrase stands, 0 if nowhere."""
        listed, phrase = template.words.split(), template.phrase.split()
        lead = next(i for i in range(len(listed)) if listed[i : i + len(phrase)] == phrase)
        share = lambda begin: _all(
            [
                F.when(F.get(words, begin + (i - lead)) == word, weight[word]).otherwise(0.0)
                for i, word in enumerate(listed)
            ],
            lambda a, b: a + b,
        ) / sum(weight[word] for word in listed)
        return F.coalesce(F.array_max(F.transform(F.col("begins")[number], share)), F.lit(0.0))

    marked = F.filter(
        F.transform(
            words,
            lambda word, place: F.when(
                word.isin(looked_up), F.struct(word.alias("word"), place.alias("place"))
            ),
        ),
        lambda hit: hit.isNotNull(),
    )
    base = [i for i, t in enumerate(templates) if t.base]
    places = F.flatten(F.array(*[F.col("begins")[i] for i in base]))
    named = lambda numbers: F.array_join(
        F.array_sort(
            F.array_distinct(
                F.filter(
                    F.array(
                        *[
                            F.when(F.col("scores")[i] >= (0 if templates[i].base else min_score), templates[i].label)
                            for i in numbers
                        ]
                    ),
                    lambda label: label.isNotNull(),
                )
            )
        ),
        ",",
    )
    shown = [
        F.when(F.size(F.col("begins")[i]) > 0, score(t, i)).otherwise(-1.0)
        for i, t in enumerate(templates)
    ]
    kept = [F.col("row")[name].alias(name) for name in rest]
    return (
        docs.select(F.struct(*rest).alias("row"), license_words(F.col(text)).alias("words"))
        .select("row", "words", marked.alias("hits"))
        .select("row", "words", F.array(*[begins(t) for t in templates]).alias("begins"))
        .select("row", F.size("words").alias("n"), "begins", F.array(*shown).alias("scores"))
        .select(
            *kept,
            F.col("n").cast("long").alias("n_words"),
            F.size(places).cast("long").alias("n_base"),
            F.array_min(places).cast("long").alias("first_word"),
            F.array_max(places).cast("long").alias("last_word"),
            named(base).alias("base_labels"),
            named(range(len(templates))).alias("labels"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.array_max("scores"))).alias("score"),
        )
    )
