"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reviewlake.queries import QUERIES  # noqa: E402
from reviewlake.session import build_session  # noqa: E402

HEADLINE = (
    "h3_bm25_search", "h1_knn_exact", "c8_knn_join", "h8_find_similar_code", "h11_find_relevant_comments", "h14_enrich_comments",
    "e16_best_feedback_match", "c1_diff_inventory", "d1_comment_stats", "d16_cross_chunk_issues", "d17_merge_chunk_issues",
    "e12_pack_files", "e13_plan_file_context", "e10_merge_line_windows", "g16_parse_diff", "h18_select_key_files", "d12_inventory_hash",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    # Start the JVM's code paths and the Python workers once, outside the timings.
    QUERIES["h5_embed"](spark, sf_dir).limit(1).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
