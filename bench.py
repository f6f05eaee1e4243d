"""Headline queries, timed. Prints one JSON line.

Each query runs once untimed (class loading, code generation, file cache) and
then ``BENCH_RUNS`` times; the best time counts. Results go to the no-op sink,
so all rows are produced and none are collected.
"""

from __future__ import annotations

import json
import os
import time

from parcelrules.plans import suite
from parcelrules.session import build_session

HEADLINE = [
    "prompt_performance", "test_results_export", "accuracy_trends", "accuracy_timeline", "field_accuracy_heatmap",
    "zone_extraction_analysis", "test_summary", "ground_truth_overview", "document_stats", "zones_with_locations",
    "upsert_requirements", "dedupe_documents", "apply_status_events", "orphan_jobs", "retry_outcomes",
    "quality_violations", "normalize_requirements", "score_extractions", "bulk_parse", "rule_extract", "build_prompts",
]
# Timed beside the total: each runs its stream inside the query.
STREAMS = ["stream_ingest", "stream_normalize", "stream_stats"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took, plan = {}, {}
    for name in [*HEADLINE, *STREAMS]:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            df = suite.QUERIES[name](spark, folder)
            built = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            times.append((time.perf_counter() - start, built - start))
        best = min(times[1:])
        took[name], plan[name] = round(best[0], 3), round(best[1], 3)
    streams = {name: took.pop(name) for name in STREAMS}
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "plan_building": plan, "streams": streams, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus), "spark": spark.version,
        "state": "warm, best of %d" % runs}))
    spark.stop()


if __name__ == "__main__":
    main()
