"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kermesse.session import local_session  # noqa: E402
from workloads.queries import QUERIES  # noqa: E402

HEADLINES = (
    "explode_pages",
    "merge_scalar",
    "merge_list",
    "merge_dict",
    "merge_sources",
    "clean_text",
    "join_list",
    "clean_event_rows",
    "profile_duplicates",
    "profile_conflicts",
    "value_counts",
    "document_chunks",
    "normalise_vectors",
    "topk_chunks",
    "topk_events",
    "embed_topk",
    "result_context",
    "generated_answers",
    "build_stages",
)


def timed(spark, name: str, sf_dir: str) -> float:
    """Seconds to run the whole query; every output column is computed, none is collected."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cores, "kermesse-bench")
    timed(spark, "map_codes", sf_dir)  # start the JVM's compilers and the page cache
    times = {}
    for name in names:
        times[name] = round(min(timed(spark, name, sf_dir) for _ in range(2)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
