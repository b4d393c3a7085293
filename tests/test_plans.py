"""Physical plans: what may and may not be in them, whatever the data."""

import pytest

from kermesse.operators.merge import merge_by_key
from kermesse.sources import pages
from kermesse.operators import vectors
from workloads.queries import QUERIES, table

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    """Plans with neither adaptive execution nor measured broadcasts, which would hide choices."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield {name: plan(make(spark, SF_DIR)) for name, make in QUERIES.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_query_pairs_all_rows(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_only_bounded_results_are_broadcast(plans):
    forced = {name for name, text in plans.items() if "BroadcastHashJoin" in text}
    # One look-up of documents for queries times k results, in four queries.
    assert forced == {"result_context", "generated_answers", "answered_questions", "answer_events"}


def test_no_query_squeezes_rows_into_one_task(plans):
    """Only aggregates without keys, whose input is partial results, and top-level limits may."""
    for name, text in plans.items():
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                above = lines[i + 1]
                assert "Aggregate(" in above, (name, above)


def test_row_formats_need_no_shuffle(plans):
    for name in (
        "json_records", "normalise_missing", "comparison_key", "clean_text", "join_list", "format_datetime",
        "format_timing", "format_all_timings", "format_accessibility", "format_image", "format_registration",
        "format_links", "format_age", "canonical_region", "document_text", "document_chunks", "normalise_vectors",
        "recent_filter", "stale_check", "project_columns", "drop_constants", "drop_sparse",
    ):
        assert "Exchange" not in plans[name], name


def test_scans_read_only_the_columns_used(plans):
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in plans["project_columns"]
    assert "ReadSchema: struct<l_linenumber:int>" in plans["map_codes"]
    assert "ReadSchema: struct<doc_id:bigint>" in plans["alignment_check"]


def test_filters_reach_the_scan(plans):
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,2-HIGH)]" in plans["recent_filter"]


def test_profiles_aggregate_in_hash_tables(plans):
    for name in ("profile_conflicts", "profile_duplicates", "value_counts", "alignment_check"):
        assert "HashAggregate" in plans[name] and "SortAggregate" not in plans[name], name


def test_search_cuts_before_every_shuffle(spark, plans):
    text = plans["topk_chunks"]
    assert "MapInArrow" in text
    # Two cuts, each with a limit on both sides of its shuffle.
    assert text.count("WindowGroupLimit") == 4


def test_index_carries_no_document_columns(spark):
    index = table(spark, SF_DIR, "embeddings").selectExpr("vec_id chunk_id", "label uid", "embedding")
    queries = index.selectExpr("chunk_id query_id", "embedding").limit(3)
    found = vectors.top_events(index, queries, 2)
    assert found.columns == ["query_id", "chunk_id", "uid", "score", "rank"]


def test_items_are_built_once_before_they_are_exploded(spark):
    rows = spark.createDataFrame([("a", ["x"]), ("a", ["y"])], "uid string, tags array<string>")
    merged = merge_by_key(rows.repartition(2), "uid")
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    # Two for the items, one for the merged list.
    assert plan.count("transform(") == 3


def test_a_language_map_is_read_once_per_cell(spark):
    page = spark.createDataFrame([('{"events":[{"uid":1,"title":{"fr":"a"}}]}',)], "value string")
    titles = pages.explode_events(page).select("title")
    shown = titles._jdf.queryExecution().optimizedPlan().expressions().head().sql()
    # One for the map, four for plain text.
    assert shown.count("variant_get(") == 5 and titles.first().title == "a"
