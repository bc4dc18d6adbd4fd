"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Every query is executed in full through the `noop` sink (no driver collect). Per-query times are
wall-clock seconds of that execution, after one warm-up query that loads the JVM and the scan
metadata.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # E2 sampling and tag counts
    "active_posts", "top_n_sizes", "top_n_large", "random_n", "tag_counts_all", "top_tags_per_type",
    # E1 genre pipeline
    "tag_frequency", "cooccur_pmi", "see_also_links", "merged_graph", "cluster_metrics",
    "distinctive_tags", "example_bundles", "all_clusters", "run_overview", "communities_lp", "communities_louvain",
    # E3 hierarchy
    "page_items", "page_normalised", "nested_items", "catalogue_items", "expanded_items", "hierarchy_consolidated", "items_under_path_list",
    # streaming
    "incremental_ingest", "streaming_tag_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tagflow.plans.registry import all_queries
    from tagflow.session import clear_state, get_session

    spark = get_session(f"local[{cpus}]", int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = all_queries()
    qs["rating_distribution"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        clear_state(spark)
    t0 = time.perf_counter()
    n_items = qs["page_items"](spark, sf_dir).count()
    items_sec = time.perf_counter() - t0
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf, "cpus": int(cpus),
        "hierarchy_items": n_items, "hierarchy_items_per_sec": round(n_items / items_sec, 1) if items_sec else None,
    }))
    clear_state(spark)
    spark.stop()


if __name__ == "__main__":
    main()
