"""Benchmark: headline analyses over the lens of ``events`` at $BENCH_SF_DIR.

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries": {name: sec}, "sf", ...}.
Each query runs fully through Spark's ``noop`` sink (no driver collect); the
best of $BENCH_REPEATS (default 3) runs is kept after one warm-up run. Landing is timed once.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from logarbor.plans.analyzer import LogAnalyzer  # noqa: E402
from logarbor.plans.catalog import CHECK_OPTS, QUERIES  # noqa: E402
from logarbor.session import build_session  # noqa: E402
from logarbor.sources.lens import lens  # noqa: E402

HEADLINE = ("entries", "service_counts", "summary", "level_distribution", "hourly_distribution",
            "tree_rows", "tree_nodes", "error_clusters", "error_clusters_by_service", "find_errors",
            "filter_combined", "tail_errors", "year_sequential", "year_transition",
            "parse_quality", "csv_frame", "doc_entries", "doc_tree_rows", "summary_lines")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(f"local[{cpus}]", int(cpus), driver_memory=os.environ.get("BENCH_MEM", "16g"))
    for kv in filter(None, os.environ.get("BENCH_CONF", "").split(",")):
        k, v = kv.split("=", 1)
        spark.conf.set(k, v)
    names = [n for n in HEADLINE if n in QUERIES]
    QUERIES["service_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        best = float("inf")
        for _ in range(repeats):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        times[name] = round(best, 3)
    # the same reports on entries landed once
    folder = tempfile.mkdtemp(prefix="bench-landed-")
    t0 = time.perf_counter()
    LogAnalyzer(lens(spark, sf_dir, partitions=int(cpus)), CHECK_OPTS).land(folder)
    times["land"] = round(time.perf_counter() - t0, 3)
    landed = LogAnalyzer.from_landed(spark, folder, CHECK_OPTS)
    for name, report in (("landed_tree_rows", landed.tree_rows), ("landed_find_errors", landed.find_errors)):
        best = float("inf")
        for _ in range(repeats):
            t0 = time.perf_counter()
            report().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        times[name] = round(best, 3)
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_sec_headline_queries",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "lines": lines,
        "parse_lines_per_sec": round(lines / times["entries"]) if times.get("entries") else None,
        "cpus": int(cpus),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
