"""Day summaries of landed logs: sketches unite, pattern bounds hold, missing summaries are named."""

from collections import Counter
from datetime import datetime

import pytest
from log_helpers import make_lines
from pyspark.sql import functions as F

from logarbor.operators import sketches
from logarbor.operators.clusters import error_clusters
from logarbor.options import AnalyzerOptions
from logarbor.plans.analyzer import LogAnalyzer
from logarbor.sources.lens import lens

SF = "/root/testdata/sf0.001"
OPTS = AnalyzerOptions(as_of=datetime(2024, 1, 31), max_days=45)


def _landed(spark, path, patterns, opts=OPTS):
    lines = lens(spark, SF)
    for k in range(3):
        LogAnalyzer(lines.filter(F.col("line_seq") % 3 == k), OPTS).land(
            path, "overwrite" if k == 0 else "append", f"b{k}", patterns)
    return LogAnalyzer.from_landed(spark, path, opts)


def test_bounds_hold_and_full_lists_are_exact(spark, tmp_path):
    a = _landed(spark, str(tmp_path / "few"), 4)
    exact = {r.pattern: r.n for r in error_clusters(a.entries, None).collect()}
    pieces = a._summaries("_patterns", sketches.frequent_patterns)
    bounds = sketches.pattern_bounds(pieces).collect()
    assert bounds and all(r.n <= exact[r.pattern] <= r.n_max for r in bounds)
    unseen = sketches._all_cuts(pieces).first()["cuts"]
    assert any(r.n < r.n_max for r in bounds)
    assert all(exact[p] <= unseen for p in set(exact) - {r.pattern for r in bounds})
    full = _landed(spark, str(tmp_path / "full"), 100_000)
    want = [(r.pattern, r.n, r.n, True) for r in full.error_clusters(10).collect()]
    assert sorted(map(tuple, full.top_patterns(10).collect())) == sorted(want)


def test_sure_is_never_wrong(spark):
    """Skewed patterns in many pieces: what is called sure belongs to the exact top k, ties aside."""
    rows = [(d, f"p{i % (1 + i % 40)} x y") for d in range(6) for i in range(d, 900, 2)]
    e = spark.createDataFrame(rows, "d int, message string").select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("log_date"), "message", F.lit(True).alias("is_error"))
    exact = Counter(m for _, m in rows)
    for kept in (1, 3, 10, 100):
        for k in (1, 3, 8):
            top = sketches.top_patterns(sketches.frequent_patterns(e, kept), k).collect()
            names = {r.pattern for r in top}
            best_outside = max((n for p, n in exact.items() if p not in names), default=0)
            assert all(exact[r.pattern] >= best_outside for r in top if r.sure)
            assert all(r.sure and r.n == r.n_max for r in top) or kept < 100


def test_sketches_of_days_unite(spark, tmp_path):
    a = _landed(spark, str(tmp_path / "l"), 10)
    got = {r.what: r.estimate for r in a.distinct_estimates().collect()}
    e = a.entries.agg(F.count_distinct("service"), F.count_distinct("host"), F.count_distinct("message")).first()
    for what, n in zip(("services", "hosts", "messages"), e):
        assert abs(got[what] - n) <= 0.03 * n
    # a window that cuts its first and last day counts those from their entries
    narrow = OPTS.replace(max_days=7, as_of=datetime(2024, 1, 20, 13, 30))
    b = LogAnalyzer.from_landed(spark, str(tmp_path / "l"), narrow)
    n = b.entries.agg(F.count_distinct("message")).first()[0]
    assert 0 < n < e[2] and abs({r.what: r.estimate for r in b.distinct_estimates().collect()}["messages"] - n) <= 0.03 * n
    assert sum(r.n for r in b._summaries("_sketches", sketches.day_sketches).collect()) == b.entries.count()


def test_reads_no_messages(spark, tmp_path):
    a = _landed(spark, str(tmp_path / "l"), 10)
    plan = a.top_patterns(5)._jdf.queryExecution().executedPlan().toString()
    scans = [s for s in plan.split("FileScan")[1:]]
    assert any("_patterns" in s for s in scans)
    assert all("_patterns" in s.split("ReadSchema")[0] or "log_date#" in s.split("PartitionFilters")[1] for s in scans)


def test_missing_summaries_are_named(spark, tmp_path):
    path, lines = str(tmp_path / "l"), lens(spark, SF)
    LogAnalyzer(lines, OPTS).land(path, batch="plain")
    with pytest.raises(ValueError, match="all"):
        LogAnalyzer.from_landed(spark, path, OPTS).top_patterns()
    LogAnalyzer(lines, OPTS).land(path, "append", "more", patterns=5)
    with pytest.raises(ValueError, match="plain"):
        LogAnalyzer.from_landed(spark, path, OPTS).distinct_estimates()
    with pytest.raises(ValueError):
        LogAnalyzer(lines, OPTS).top_patterns()


def test_batch_without_errors(spark, tmp_path):
    path = str(tmp_path / "l")
    LogAnalyzer(make_lines(spark, ["Jan  5 10:00:00 host app: all fine"]), OPTS).land(path, patterns=3)
    a = LogAnalyzer.from_landed(spark, path, OPTS)
    assert a.top_patterns().count() == 0
    assert {r.what: r.estimate for r in a.distinct_estimates().collect()} == {
        "services": 1, "hosts": 1, "messages": 1, "error_patterns": 0}
