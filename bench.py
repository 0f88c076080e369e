"""Headline queries, median of three runs in one session. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from shelfspark.plans import all_queries
from shelfspark.session import build_session, clear_scratch

HEADLINE = [
    "catalogue_flow",
    "discipline_flow",
    "metric_index",
    "enrich_two_key",
    "resolve_record",
    "dedupe_catalogue",
    "facet_disciplines",
    "latest_per_prefix",
    "explode_paper_blocks",
    "raw_papers_table",
    "drop_md_column",
    "explode_report_sections",
    "patch_blocks",
    "audit_partition",
    "link_mentions",
    "report_flow",
    "section_title_merge",
    "page_text",
    "literature_search",
    "clean_corpus",
    "cluster_labels",
    "out_of_scope_flag",
    "papers_per_cluster_batches",
    "sort_base_insensitive",
    "job_rollup",
    "retention_archive",
    "session_blocks",
    "job_status_stream",
    "scan_metric_files",
    "scan_registry",
    "sort_stage_files",
    "session_blocks_stream",
    "cluster_topics",
    "cluster_text",
    "k_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        clear_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
