import json

import pytest
from pyspark.sql import functions as F

from kermesse.operators import answers, models
from kermesse.operators.vectors import normalise_vectors

TEN_PHRASES = [
    "Une exposition de peinture", "Une sortie pour les petits", "Du jazz ce soir", "Une pièce de théâtre",
    "Quoi faire avec les enfants", "Une visite en plein air", "De la photographie", "Une activité gratuite",
    "Un lieu accessible en fauteuil", "Un atelier pour adolescents",
]


def questions(spark, rows):
    return spark.createDataFrame(rows, "query_id int, question string, k int")


def test_guards(spark):
    rows = [(1, " Un concert ", 5), (2, "", 5), (3, " \n", 5), (4, "x", 50), (5, "x", 0), (6, "x", 1), (7, "x", 10), (8, "x", None), (9, None, 5)]
    accepted, rejected = answers.guard_questions(questions(spark, rows))
    assert [tuple(r) for r in accepted.orderBy("query_id").collect()] == [
        (1, "Un concert", 5), (6, "x", 1), (7, "x", 10), (8, "x", 5),
    ]
    assert {r.query_id: r.reason for r in rejected.collect()} == {
        2: "empty question", 3: "empty question", 4: "k out of range", 5: "k out of range", 9: "empty question",
    }


def test_context(spark):
    rows = [(1, 2, "B", " d ", None), (1, 1, "A", " ", "v"), (2, 1, "C", None, None)]
    results = spark.createDataFrame(rows, "query_id int, rank int, title string, description string, location_city string")
    got = {r.query_id: r for r in answers.build_context(results).collect()}
    assert got[1].context == "Titre : A\nVille : v\n\n---\n\nTitre : B\nDescription :  d "
    assert [e.title for e in got[1].events] == ["A", "B"] and got[2].context == "Titre : C"


def test_template_leaves_braces_in_values(spark):
    filled = answers.fill_template("Q {question} C {context} {other}", {"question": F.lit("{context}"), "context": F.lit("{question}")})
    assert spark.range(1).select(filled).first()[0] == "Q {context} C {question} {other}"


def test_embedding_in_batches(spark):
    def sizes():
        return lambda texts: [[float(len(t)), float(len(texts))] for t in texts]

    df = spark.createDataFrame([("x" * i,) for i in range(70)], "t string").coalesce(1)
    rows = df.select("t", models.embed(F.col("t"), sizes, batch_size=32).alias("v")).collect()
    assert all(r.v[0] == len(r.t) for r in rows)
    assert max(r.v[1] for r in rows) == 32


def test_wrong_batch_count_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    with pytest.raises(Exception, match="2 texts sent, 1 vectors received"):
        df.select(models.embed(F.col("t"), lambda: lambda texts: [[1.0]])).collect()
    with pytest.raises(Exception, match="2 prompts sent, 3 answers received"):
        df.select(models.generate(F.col("t"), lambda: lambda texts: ["a"] * 3)).collect()
    for make in (models.embed, models.generate):
        with pytest.raises(ValueError):
            make(F.col("t"), lambda: None, batch_size=0)


def test_answers_end_to_end(spark):
    embedder = models.hashed_token_embedder(256)
    docs = spark.createDataFrame(
        [(f"{i}_0", str(i), p, f"Sortie : {p}") for i, p in enumerate(TEN_PHRASES)],
        "chunk_id string, uid string, title string, chunk_text string",
    )
    index = normalise_vectors(models.embed_table(docs, embedder))
    asked = questions(spark, [(i, f" {p} ", 3) for i, p in enumerate(TEN_PHRASES)] + [(10, " ", 3), (11, "x", 99)])
    out = answers.answer_questions(asked, index, docs, embedder, answers.echo_generator())
    rows = {r.query_id: r for r in out.collect()}
    assert set(rows) == set(range(10))
    for i, phrase in enumerate(TEN_PHRASES):
        assert rows[i].question == phrase and rows[i].answer.strip()
        assert 1 <= len(rows[i].events) <= 3 and rows[i].events[0].title == phrase
        assert phrase in rows[i].answer and "Titre : " in rows[i].answer


def test_question_without_results_is_answered(spark):
    results = spark.createDataFrame([], "query_id int, rank int, title string")
    out = answers.generate_answers(questions(spark, [(1, "q", 5)]), results, answers.echo_generator())
    row = out.first()
    assert row.events == [] and row.answer.startswith("Demande : q")


def test_messages(spark):
    row = spark.range(1).select(answers.chat_messages(F.lit("q"), F.lit("c")).alias("m")).first()
    assert [m.role for m in row.m] == ["system", "human"] and "q" in row.m[1].content and "c" in row.m[1].content


def test_json_records(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string").withColumn("t", F.lit("2024-01-02").cast("timestamp"))
    assert json.loads(answers.json_records(df).first().value) == {"a": 1, "b": None, "t": "2024-01-02T00:00:00.000Z"}
