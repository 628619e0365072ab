"""Scaling probe: the lens over ``events`` replicated k times (new event ids), timed per analysis.

usage: python tools/scale_probe.py SF_DIR K [CPUS]
Replication keeps every event and renders k copies with distinct ids (event_id * k + copy),
so lines, chunks and nodes grow k-fold. Results go through the noop sink.
"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from logarbor.operators import clusters, search, summary, tree  # noqa: E402
from logarbor.operators.parse import parse  # noqa: E402
from logarbor.plans.catalog import CHECK_OPTS  # noqa: E402
from logarbor.session import build_session  # noqa: E402
from logarbor.sources.lens import lens_lines, read_events  # noqa: E402


def main() -> None:
    sf_dir, k = sys.argv[1], int(sys.argv[2])
    cpus = int(sys.argv[3]) if len(sys.argv) > 3 else 8
    spark = build_session(f"local[{cpus}]", cpus, driver_memory="16g")
    ev = read_events(spark, sf_dir)
    ev = ev.repartition(8, "event_id").select(
        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_c"), *ev.columns)
    ev = ev.withColumn("event_id", F.col("event_id") * k + F.col("_c")).drop("_c")
    lines = lens_lines(ev)
    n = ev.count()
    runs = {
        "parse": lambda: parse(lines, CHECK_OPTS),
        "service_counts": lambda: summary.service_counts(parse(lines, CHECK_OPTS)),
        "tree_rows": lambda: tree.tree_rows(parse(lines, CHECK_OPTS), CHECK_OPTS),
        "error_clusters": lambda: clusters.error_clusters(parse(lines, CHECK_OPTS), 10),
        "find_errors": lambda: search.find_errors(parse(lines, CHECK_OPTS)),
        "year_sequential": lambda: parse(lines, CHECK_OPTS.replace(year_mode="sequential", base_year=2024)),
    }
    out = {}
    for name, fn in runs.items():
        t0 = time.perf_counter()
        fn().write.format("noop").mode("overwrite").save()
        out[name] = round(time.perf_counter() - t0, 2)
    print(json.dumps({"lines": n, "replicas": k, "cpus": cpus, "sec": out,
                      "parse_lines_per_sec": round(n / out["parse"])}))


if __name__ == "__main__":
    main()
