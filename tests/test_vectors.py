import numpy as np
import pytest
from pyspark.sql import functions as F

from kermesse.operators import vectors
from kermesse.sources import store

INDEX = "chunk_id string, uid string, embedding array<float>"
QUERIES = "query_id int, embedding array<float>"


def unit(m):
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return (m / np.where(norms > 0, norms, 1)).astype(np.float32)


def data(seed, n, nq, dims=16, copies=0.34, uids=30):
    """Unit vectors of which a third are copies of one, under shuffled ids."""
    rng = np.random.default_rng(seed)
    v = unit(rng.normal(size=(n, dims)))
    v[rng.random(n) < copies] = v[0]
    q = unit(rng.normal(size=(nq, dims)))
    q[0] = v[0]
    ids = [f"c{i}" for i in rng.permutation(n)]
    return v, q, ids, [f"u{i}" for i in rng.integers(0, uids, n)]


def frames(spark, v, q, ids, uids, parts=5):
    index = spark.createDataFrame([(i, u, x.tolist()) for i, u, x in zip(ids, uids, v)], INDEX)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], QUERIES)
    return index.repartition(parts, "chunk_id"), queries


def brute(v, q, ids, n):
    """(query, id) of the best n by single-precision score, ties by id."""
    scores = (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.float32)
    return {
        i: [j for _, j in sorted((-s, j) for s, j in zip(row, ids))[:n]] for i, row in enumerate(scores)
    }


def by_rank(df, column="chunk_id"):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r[column])
    return out


@pytest.mark.parametrize("n", [1, 5, 30])
@pytest.mark.parametrize("max_local", [vectors.MAX_LOCAL_QUERIES, 3])
def test_top_chunks_equal_brute_force(spark, monkeypatch, n, max_local):
    """Same result with queries in every task and, beyond the bound, streamed from a table."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    v, q, ids, uids = data(n, 400, 9)
    index, queries = frames(spark, v, q, ids, uids)
    asked = vectors.query_set(queries, max_local=max_local)
    assert asked.max_rows(n) == (9 * n if max_local > 9 else None)
    got = vectors.top_chunks(index, asked, n)
    assert by_rank(got) == brute(v, q, ids, n)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 0


@pytest.mark.parametrize("nq", [4095, 4096, 4097])
def test_both_sides_of_the_local_bound(spark, nq):
    v, q, ids, uids = data(nq, 150, nq, dims=4)
    index, queries = frames(spark, v, q, ids, uids, 3)
    asked = vectors.query_set(queries)
    assert (asked.local is None) == (nq > vectors.MAX_LOCAL_QUERIES)
    assert by_rank(vectors.top_chunks(index, asked, 3)) == brute(v, q, ids, 3)


def written(spark, tmp_path, n=3000, nq=40, dims=8, files=6):
    v, q, ids, uids = data(5, n, nq, dims=dims)
    index, queries = frames(spark, v, q, ids, uids, files)
    path = str(tmp_path / "index")
    index.write.parquet(path)
    return v, q, ids, path, queries


def test_one_scan_of_the_vectors_for_many_blocks_of_queries(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "BUFFER_CELLS", 1000)
    v, q, ids, path, queries = written(spark, tmp_path)
    asked = vectors.query_set(queries, max_local=2)
    found = vectors.top_chunks(spark.read.parquet(path), asked, 5)
    assert by_rank(found) == brute(v, q, ids, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


@pytest.mark.parametrize("max_local", [vectors.MAX_LOCAL_QUERIES, 3])
def test_two_phases_give_the_same_rows(spark, monkeypatch, tmp_path, max_local):
    """A third of the vectors are equal, so bounds are met by many ties."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 16)
    v, q, ids, path, queries = written(spark, tmp_path)
    asked = vectors.query_set(queries, max_local=max_local)
    index = spark.read.parquet(path)
    for n in (1, 7, 400):
        assert by_rank(vectors.top_chunks(index, asked, n, two_phase=True)) == brute(v, q, ids, n)


def test_bounded_rows_do_not_grow_with_the_splits(spark, tmp_path):
    v, q, ids, uids = data(6, 8000, 10, copies=0)
    index, queries = frames(spark, v, q, ids, uids, 1)
    path = str(tmp_path / "index")
    index.write.parquet(path)
    asked, rows = vectors.query_set(queries), {}
    for parts in (2, 64):
        split = spark.read.parquet(path).repartition(parts, "chunk_id")
        low = vectors._with_bounds(split, asked, 5, "chunk_id", vectors.SAMPLE_OF)
        rows[parts] = [vectors._candidates(split, x, 5, ["chunk_id"]).count() for x in (asked, low)]
    assert rows[64][0] == 32 * rows[2][0] == 10 * 5 * 64
    # Some n * SAMPLE_OF rows a query reach the bound, cut or not.
    assert rows[64][1] < 10 * 5 * vectors.SAMPLE_OF * 2 and rows[64][0] > 3 * rows[64][1]


def test_two_phases_by_the_planners_size(spark, monkeypatch, tmp_path):
    *_, path, queries = written(spark, tmp_path, n=200)
    calls = []
    real = vectors._with_bounds
    monkeypatch.setattr(vectors, "_with_bounds", lambda *a: calls.append(1) or real(*a))
    index = spark.read.parquet(path)
    vectors.top_chunks(index, queries, 3).count()
    assert not calls
    monkeypatch.setattr(vectors, "MANY_SPLITS", -1)
    vectors.top_chunks(index, queries, 3).count()
    assert calls


def scanned_rows(df):
    """Rows that the scans of the documents gave."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        if "FileScan" in leaves.apply(i).toString():
            found.append(leaves.apply(i).metrics().apply("numOutputRows").value())
    return sum(found)


def test_look_up_reads_only_the_row_groups_that_may_hold_an_id(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("parquet.block.size", "16384")
    spark.conf.set("parquet.page.row.count.limit", "500")
    try:
        read = {}
        for n in (4_000, 40_000):
            rows = spark.range(n).selectExpr("cast(id as string) chunk_id", "sha2(cast(id as string), 512) title")
            docs = store.save_documents(rows.repartition(4), str(tmp_path / f"docs{n}"))
            assert docs.count() == n
            found = spark.createDataFrame([(1, "17", 1), (1, "3999", 2), (2, "gone", 1)], "query_id int, chunk_id string, rank int")
            joined = vectors.with_documents(found, docs, max_rows=3)
            assert {(r.query_id, r.chunk_id) for r in joined.collect()} == {(1, "17"), (1, "3999")}
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "PushedFilters: [Or(EqualTo(chunk_id,17)" in plan.replace("IsNotNull(chunk_id), ", "")
            read[n] = scanned_rows(joined)
        assert read[40_000] < 2 * read[4_000] and read[40_000] < 8_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("parquet.page.row.count.limit")


def test_look_up_without_results_and_beyond_its_bound(spark):
    docs = spark.createDataFrame([("a", "T")], "chunk_id string, title string")
    none = spark.createDataFrame([], "query_id int, chunk_id string, rank int")
    assert vectors.with_documents(none, docs, max_rows=5).collect() == []
    many = spark.range(600).selectExpr("1 query_id", "'a' chunk_id", "1 rank")
    with pytest.raises(ValueError, match="bound"):
        vectors.with_documents(many, docs, max_rows=5)


def test_results_do_not_depend_on_partitions_or_batches(spark):
    v, q, ids, uids = data(7, 300, 4)
    results = []
    for parts, batch in ((1, "10000"), (8, "7")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            index, queries = frames(spark, v, q, ids, uids, parts)
            results.append(by_rank(vectors.top_chunks(index, queries, 10)))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert results[0] == results[1] == brute(v, q, ids, 10)


def test_top_events_keep_the_best_chunk_of_each(spark):
    v, q, ids, uids = data(3, 300, 5, uids=6)
    index, queries = frames(spark, v, q, ids, uids)
    owner = dict(zip(ids, uids))
    expected = {}
    for query, chunks in brute(v, q, ids, 12).items():
        best = {}
        for chunk in chunks:
            best.setdefault(owner[chunk], chunk)
        expected[query] = list(best.values())[:4]
    got = vectors.top_events(index, queries, 4)
    assert by_rank(got) == expected
    assert [f.name for f in got.schema] == ["query_id", "chunk_id", "uid", "score", "rank"]


def test_each_query_may_have_its_own_k(spark):
    v, q, ids, uids = data(4, 200, 4, copies=0, uids=200)
    index, queries = frames(spark, v, q, ids, uids)
    got = vectors.top_events(index, queries.withColumn("k", F.col("query_id") + 1), 5)
    assert {i: len(x) for i, x in by_rank(got).items()} == {0: 1, 1: 2, 2: 3, 3: 4}


def test_few_vectors_few_events_and_zero_vectors(spark):
    index = spark.createDataFrame([("a", "u", [0.0, 0.0]), ("b", "u", [1.0, 0.0])], INDEX)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)
    assert by_rank(vectors.top_chunks(index, queries, 9)) == {1: ["b", "a"]}
    assert by_rank(vectors.top_events(index, queries, 5)) == {1: ["b"]}
    assert vectors.top_chunks(index.filter("uid = 'x'"), queries, 3).count() == 0
    assert vectors.top_chunks(index, queries.filter("query_id = 0"), 3).count() == 0


def test_dimension_mismatch_is_an_error(spark):
    index = spark.createDataFrame([("a", "u", [1.0, 0.0, 0.0])], INDEX)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)
    with pytest.raises(Exception, match="differ in dimension"):
        vectors.top_chunks(index, queries, 3).collect()


def test_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1e-30, 0.0]), (4, None)], QUERIES)
    got = {r.query_id: r.embedding for r in vectors.normalise_vectors(df).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0, 0] and got[3] == [1, 0] and got[4] is None


def test_index_guards(spark):
    good = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], QUERIES)
    assert vectors.check_index(good) == 2
    for bad in ([], [(1, [1.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])], [(1, [1.0, None])]):
        with pytest.raises(ValueError):
            vectors.check_index(spark.createDataFrame(bad, QUERIES))


def test_alignment(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "chunk_id string")
    assert vectors.check_alignment(ids("a", "b"), ids("b", "a")) == 2
    row = vectors.alignment_profile(ids("a", "b", "b"), ids("b", "c")).first()
    assert tuple(row) == (3, 2, 1, 1, 1)
    for left, right in ((ids("a"), ids("b")), (ids("a"), ids("a", "a")), (ids().limit(0), ids().limit(0))):
        with pytest.raises(ValueError):
            vectors.check_alignment(left, right)


def test_documents_are_joined_last(spark):
    docs = spark.createDataFrame([("a", "u", "T"), ("b", "u", "S")], "chunk_id string, uid string, title string")
    found = spark.createDataFrame([(1, "a", "u", 0.5, 1)], "query_id int, chunk_id string, uid string, score float, rank int")
    bound = vectors.with_documents(found, docs, max_rows=1)
    assert [(r.query_id, r.title) for r in bound.collect()] == [(1, "T")]
    hinted = lambda df: "strategy=broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(bound) and not hinted(vectors.with_documents(found, docs))
    assert not hinted(vectors.with_documents(found, docs, max_rows=10**9))
