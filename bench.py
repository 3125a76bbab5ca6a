"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every result is written to the no-op sink, so
all columns are computed and nothing is collected. One warm-up query starts the Python workers and the JIT.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from glossweave.plans import load_catalog  # noqa: E402
from glossweave.session import build_session  # noqa: E402

HEADLINE = [
    "scan_only_summary", "noise_filter", "noise_flags", "html_candidates", "attributes_html", "extract_code_swift", "extract_code_csharp",
    "first_occurrence", "batch_assignment", "scan_order_ids", "classify_rules", "verdict_split", "key_from_text", "keys_greedy",
    "needed_units", "approved_reuse", "translate_rules", "final_values", "merge_counts", "coverage_pivot", "language_outcomes",
    "detect_stack", "setup_findings", "edit_validation", "splice_pages", "bundle_roundtrip_resx", "scope_range_join", "event_cursor",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_catalog()
    names = sys.argv[1:] or HEADLINE
    catalog["html_candidates"].run(spark, root).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog[name].run(spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
