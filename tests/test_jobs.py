import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from threading import Event

import pytest
from pyspark.sql import functions as F

from kermesse.operators import answers, models
from kermesse.plans import jobs
from kermesse.sources.store import (
    VectorStore,
    claim_version,
    latest_version,
    load_tables,
    publish,
    published,
    put_if_absent,
    version_path,
)
from landing import write_landing

EMBEDDER = models.hashed_token_embedder(32)


def test_rebuild_publish_and_reload(spark, tmp_path):
    listing, events = write_landing(tmp_path / "landing")
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        VectorStore(spark, root).load()

    counts = jobs.rebuild(spark, listing, events, root, EMBEDDER)
    assert counts == {"clean_events": 3, "chunks": 3, "embedding_dimension": 32, "indexed_vectors": 3}
    store = VectorStore(spark, root, cache=True)
    index, documents = store.load()
    assert index.columns == ["chunk_id", "uid", "embedding"] and documents.count() == 3
    assert store.load()[0] is index
    rejects = spark.read.parquet(version_path(root, 1, "rejects")).collect()
    assert [tuple(r)[:2] for r in rejects] == [("3", 1)]

    # The next version is invisible until it is published, and then only to who reloads.
    second = jobs.rebuild(spark, listing, events, root, EMBEDDER, city="Albi", max_agendas=2)
    assert second["clean_events"] == 1 and latest_version(spark, root) == 2
    assert published(spark, root).count() == 2
    assert store.load()[0].count() == 3
    assert store.reload()[0].count() == 1

    asked = spark.createDataFrame([(1, "une expo", 5)], "query_id int, question string, k int")
    row = answers.answer_questions(asked, *store.load(), EMBEDDER, answers.echo_generator()).first()
    assert [e.title for e in row.events] == ["Expo"]


def test_failed_rebuild_publishes_nothing(spark, tmp_path):
    listing, events = write_landing(tmp_path / "landing")
    root = str(tmp_path / "store")

    def broken():
        return lambda texts: []

    with pytest.raises(Exception, match="vectors received"):
        jobs.rebuild(spark, listing, events, root, broken)
    assert latest_version(spark, root) is None
    assert jobs.rebuild(spark, listing, events, root, EMBEDDER)["indexed_vectors"] == 3


def test_a_file_is_put_once(spark, tmp_path):
    uri = str(tmp_path / "a" / "mark")
    with ThreadPoolExecutor(16) as pool:
        done = list(pool.map(lambda i: put_if_absent(spark, uri, str(i)), range(64)))
    assert sum(done) == 1 and open(uri).read() == str(done.index(True))
    assert [p.name for p in (tmp_path / "a").iterdir() if p.suffix != ".crc"] == ["mark"]


def test_interleaved_rebuilds_are_both_readable(spark, tmp_path):
    """The first rebuild is held before its vectors are made until the second one is published."""
    listing, events = write_landing(tmp_path / "landing")
    root = str(tmp_path / "store")
    waiting, published_second = Event(), Event()
    real = jobs.embed_events

    def held(*args, **kwargs):
        waiting.set()
        assert published_second.wait(300)
        return real(*args, **kwargs)

    with pytest.MonkeyPatch.context() as patch, ThreadPoolExecutor(1) as pool:
        patch.setattr(jobs, "embed_events", held)
        first = pool.submit(jobs.rebuild, spark, listing, events, root, EMBEDDER)
        assert waiting.wait(300)
        patch.setattr(jobs, "embed_events", real)
        second = jobs.rebuild(spark, listing, events, root, EMBEDDER, city="Albi", max_agendas=2)
        assert latest_version(spark, root) == 2
        published_second.set()
        counts = first.result(300)
    assert (counts["clean_events"], second["clean_events"]) == (3, 1)
    rows = {r.version: r.clean_events for r in published(spark, root).collect()}
    assert rows == {1: 3, 2: 1} and latest_version(spark, root) == 2
    for version, n in rows.items():
        out = lambda t: version_path(root, version, t)
        assert [t.count() for t in load_tables(spark, out, "index", "documents")] == [n, n]
    assert VectorStore(spark, root).load()[0].count() == 1


def test_a_version_is_claimed_and_published_once(spark, tmp_path):
    root = str(tmp_path)
    assert [claim_version(spark, root) for _ in range(3)] == [1, 2, 3]
    with pytest.raises(FileExistsError, match="taken"):
        claim_version(spark, root, 2)
    assert claim_version(spark, root, 9) == 9
    row = {"version": 2, "clean_events": 1, "chunks": 1, "embedding_dimension": 1, "indexed_vectors": 1}
    publish(spark, root, row)
    with pytest.raises(FileExistsError, match="published"):
        publish(spark, root, row)
    assert published(spark, root).count() == 1


def test_listing_with_a_gap_stops_the_import(spark, tmp_path):
    listing, events = write_landing(tmp_path / "landing")
    (tmp_path / "landing" / "agendas" / "part-1.json").write_text('{"page": 7, "agendas": [], "after": "x"}')
    with pytest.raises(ValueError, match="lacks page 8"):
        jobs.import_and_clean(spark, listing, events, lambda t: str(tmp_path / "out" / t))


def test_recent_events_only(spark, tmp_path):
    listing, events = write_landing(tmp_path / "landing")
    out = lambda t: str(tmp_path / "out" / t)
    clean = jobs.import_and_clean(spark, listing, events, out, as_of=dt.date(2024, 12, 1))
    assert [r.uid for r in clean.collect()] == ["10"]
    # One event: every column but the protected ones is constant.
    assert clean.columns == ["uid", "title", "description", "longDescription", "keywords"]


def test_misaligned_vectors_are_not_indexed(spark, tmp_path):
    vectors = spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<float>")
    docs = spark.createDataFrame([("b",)], "chunk_id string")
    with pytest.raises(ValueError):
        jobs.build_index(vectors, docs, lambda t: str(tmp_path / t))


def test_loading_checks_tables(spark, tmp_path):
    out = lambda t: str(tmp_path / t)
    with pytest.raises(FileNotFoundError):
        load_tables(spark, out, "vectors", "documents")
    spark.range(2).write.parquet(out("vectors"))
    spark.range(3).write.parquet(out("documents"))
    spark.range(0).write.parquet(out("index"))
    with pytest.raises(ValueError, match="differ"):
        load_tables(spark, out, "vectors", "documents")
    with pytest.raises(ValueError, match="empty"):
        load_tables(spark, out, "index")
    assert len(load_tables(spark, out, "vectors")) == 1


def test_no_events_no_embedding(spark, tmp_path):
    none = spark.createDataFrame([], "uid string, title string")
    with pytest.raises(ValueError, match="no text to embed"):
        jobs.embed_events(none, EMBEDDER, lambda t: str(tmp_path / t))


def test_stage_counts(spark):
    vectors = spark.range(3).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    rows = jobs.stage_counts({"raw": spark.range(5), "vectors": vectors}).collect()
    assert {tuple(r) for r in rows} == {("raw", 5, None), ("vectors", 3, 2)}
