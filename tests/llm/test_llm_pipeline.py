"""The pipeline beside a plain version of it, on documents made for the purpose."""

import random
from collections import Counter

from edges import documents, words

import __spark_entry__ as driver
import corpus_pipeline
from kermesse.llm.quality import measure
from kermesse.llm.simhash import fingerprint

# Queries whose rows are not one per document.
LISTS = ("op4_html", "op5_decontamination", "op12_collocations", "op13_spelling")
ITEM = words(4321, 30, 10**5)


def made():
    draw, rows = random.Random(12), []
    for i in range(150):
        text = words(7000 + i, 80 + i % 60, 10**5)
        if i % 10 == 1:
            text = rows[-1][1]  # an exact copy
        if i % 10 == 2:
            near = rows[-2][1].split()
            near[draw.randrange(len(near))] = "changed"
            text = " ".join(near)
        if i % 15 == 4:
            text = f"{text} {ITEM}"
        if i % 15 == 7:
            text = "the same eight words here again and again " * 12
        rows.append((i, text, f"s{i % 4}"))
    return [*rows, (None, None, None), (200, "", "s1")]


def test_every_stage_against_a_plain_version(spark, tmp_path):
    import pyarrow as pa

    rows = made()
    sf_dir = str(tmp_path)
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs = documents(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    good = stages["quality"](spark, docs, sf_dir)
    kept = measure(pa.array([t for _, t, _ in rows]), 30, 100)[-1]
    assert ids(good) == [r[0] for r, keep in zip(rows, kept) if keep] and good.columns == docs.columns

    single = stages["near_duplicates"](spark, good, sf_dir)
    left = [r for r, keep in zip(rows, kept) if keep]
    label = {r[0]: r[0] for r in left}
    prints = {r[0]: fingerprint(r[1]) for r in left}
    for _ in range(5):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[a] = min(label[a], label[b])
    assert ids(single) == sorted(set(label.values())) and single.columns == docs.columns

    clean = stages["decontamination"](spark, single, sf_dir)
    leaked = {r[0] for r in left if ITEM in r[1]}
    assert leaked and ids(clean) == sorted(set(label.values()) - leaked) and clean.columns == docs.columns

    mixed = stages["mixing"](spark, clean, sf_dir)
    times = Counter(ids(mixed))
    assert set(times) <= set(ids(clean)) and max(times.values()) <= 3 and mixed.columns == docs.columns

    last = stages["sharding"](spark, mixed, sf_dir).collect()
    counts = Counter(r.shard for r in last)
    assert Counter(r.doc_id for r in last) == times
    assert max(counts.values()) - min(counts[s] for s in range(24)) <= 1


def test_run_and_registration(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents(spark, made(), clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "source", "shard", "slot"] and out.count() > 50
    names = set(driver.queries())
    assert {n.split("_")[0] for n in names if n[:2] == "op" and n[2].isdigit()} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names and "op9_mixing" in driver.oracle_sql()


def test_queries_run_on_the_smallest_tables(spark):
    import os

    import pytest

    from kermesse.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test data")
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, query in QUERIES.items():
        rows = query(spark, sf_dir).count()
        assert rows == n or name in LISTS, name


def test_mixing_agrees_with_its_sql(spark):
    import os

    import pytest

    from kermesse.llm.queries import ORACLES, QUERIES
    from workloads.compare import _rows, duckdb_on

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test data")
    df = QUERIES["op9_mixing"](spark, sf_dir)
    cursor = duckdb_on(sf_dir).execute(ORACLES["op9_mixing"])
    names = [d[0] for d in cursor.description]
    assert _rows(df.columns, df.collect()) == _rows(names, cursor.fetchall())
