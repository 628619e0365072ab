import csv
import glob
import json
from datetime import datetime

import pytest
from log_helpers import make_lines
from pyspark.sql import functions as F

from logarbor.plans.analyzer import LogAnalyzer
from logarbor.options import AnalyzerOptions
from logarbor.sinks.writers import read_landed
from logarbor.sources.lens import lens

SF = "/root/testdata/sf0.001"
OPTS = AnalyzerOptions(as_of=datetime(2024, 1, 31), max_days=45)


def test_csv_export(spark, tmp_path):
    a = LogAnalyzer(lens(spark, SF), OPTS, source="events")
    a.export_csv(str(tmp_path / "out"))
    rows = []
    for f in sorted(glob.glob(str(tmp_path / "out" / "part-*.csv"))):
        with open(f, newline="") as fh:
            r = list(csv.reader(fh))
            assert r[0] == ["Timestamp", "Service", "Level", "Host", "PID", "Message"]
            rows += r[1:]
    assert len(rows) == a.entries.count()
    assert all("T" in r[0] for r in rows)
    assert any(r[2] == "" for r in rows) and any(r[4] == "" for r in rows)


def test_json_report(spark, tmp_path):
    a = LogAnalyzer(lens(spark, SF), OPTS, source="events")
    a.export_json(str(tmp_path / "rep"))
    (doc_file,) = glob.glob(str(tmp_path / "rep" / "report" / "part-*.json"))
    doc = json.loads(open(doc_file).read())
    s = a.summary().first()
    assert doc["summary"]["total_entries"] == s.total_entries
    assert doc["summary"]["unique_services"] == s.unique_services
    assert doc["summary"]["date_range"] == [str(s.date_min), str(s.date_max)]
    services = [json.loads(x) for f in glob.glob(str(tmp_path / "rep" / "service_stats" / "part-*.json"))
                for x in open(f)]
    assert len(services) == s.unique_services and sum(x["n"] for x in services) == s.total_entries
    levels = [x["count"] for x in doc["level_stats"]]
    assert levels == sorted(levels, reverse=True)
    assert sum(x["count"] for x in doc["hourly_distribution"]) == s.total_entries
    assert len(doc["plugin_results"]["ErrorClusterPlugin"]["top_error_patterns"]) <= 10
    assert doc["metadata"]["parser_info"]["patterns_loaded"] == 6
    assert glob.glob(str(tmp_path / "rep" / "plugins" / "ErrorClusterPlugin" / "service_errors" / "part-*.json"))


def test_every_plugin_of_the_analyzer_is_exported(spark, tmp_path):
    def mine(entries):
        return {"hosts": entries.groupBy("host").count()}

    a = LogAnalyzer(lens(spark, SF), OPTS, plugins={"Mine": mine})
    a.export_json(str(tmp_path / "rep"))
    (doc_file,) = glob.glob(str(tmp_path / "rep" / "report" / "part-*.json"))
    doc = json.loads(open(doc_file).read())
    assert list(doc["plugin_results"]) == ["Mine"] and len(doc["plugin_results"]["Mine"]["hosts"]) <= 10
    rows = [json.loads(x) for f in glob.glob(str(tmp_path / "rep" / "plugins" / "Mine" / "hosts" / "part-*.json"))
            for x in open(f)]
    assert sum(x["count"] for x in rows) == a.entries.count()
    text = [r.text for r in a.summary_lines().orderBy("line_no").collect()]
    assert text[0] == "Summary:" and "  Mine hosts:" in text and text.index("  Mine hosts:") > 6
    assert "Mine" not in LogAnalyzer(lens(spark, SF), OPTS).plugins


def test_csv_reads_back_exactly(spark, tmp_path):
    from pyspark.sql import functions as F
    from logarbor.sinks.writers import write_csv

    messages = ["ends in nul\x00", "bell\x07", ' "say ""hi"", ok" ', "", "  blanks  ", "a,b", "back\\slash\\"]
    rows = [(m, i) for i, m in enumerate(messages)]
    entries = spark.createDataFrame(rows, "message string, line_seq bigint").select(
        F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("timestamp"), F.lit("svc").alias("service"),
        F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("pid"), "message", F.lit("f").alias("file_path"),
        F.lit(0).cast("bigint").alias("block_start"), "line_seq")
    write_csv(entries, str(tmp_path / "csv"))
    got = []
    for f in sorted(glob.glob(str(tmp_path / "csv" / "part-*.csv"))):
        with open(f, newline="") as fh:
            got += [r[5] for r in list(csv.reader(fh))[1:]]
    assert got == messages


def test_reports_on_landed_entries(spark, tmp_path):
    a = LogAnalyzer(lens(spark, SF), OPTS)
    a.land(str(tmp_path / "landed"))
    b = LogAnalyzer.from_landed(spark, str(tmp_path / "landed"), OPTS)
    assert b.tree_rows().collect() == a.tree_rows().collect()
    key = ["timestamp", "service", "level", "message", "line_seq"]
    assert b.find_errors().select(key).collect() == a.find_errors().select(key).collect()
    plan = b.find_errors().select("timestamp", "service")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and "raw_line" not in plan
    narrow = b.service_counts()._jdf.queryExecution().executedPlan().toString()
    assert "message" not in narrow
    for report in ("parse_quality", "format_counts", "summary", "service_counts", "level_distribution",
                   "hourly_distribution", "tree_nodes"):
        assert sorted(map(str, getattr(b, report)().collect())) == sorted(map(str, getattr(a, report)().collect())), report
    with pytest.raises(ValueError):
        b.format_profile()  # by host and file: needs the log itself
    with pytest.raises(ValueError):
        b.land(str(tmp_path / "again"))


def test_landed_totals_take_the_place_of_a_scan(spark, tmp_path):
    path = str(tmp_path / "landed")
    LogAnalyzer(lens(spark, SF), OPTS).land(path)
    b = LogAnalyzer.from_landed(spark, path, OPTS)
    plan = b.summary()._jdf.queryExecution().executedPlan().toString()
    assert "_totals" in plan
    for part in plan.split("FileScan")[1:]:  # entries are read only for the day that the window's end cuts
        assert "_totals" in part.split("ReadSchema")[0] or "IN (" in part or "log_date#" in part.split("PartitionFilters")[1]
    narrow = LogAnalyzer.from_landed(spark, path, OPTS.replace(max_days=7, as_of=OPTS.as_of.replace(hour=13, minute=30)))
    fresh = LogAnalyzer(lens(spark, SF), narrow.options)
    assert narrow.summary().collect() == fresh.summary().collect()
    assert narrow.tree_rows().collect() == fresh.tree_rows().collect()


def test_batches_add_up_and_a_rerun_replaces_its_own(spark, tmp_path):
    path, lines = str(tmp_path / "landed"), lens(spark, SF)
    parts = [LogAnalyzer(lines.filter(F.col("line_seq") % 3 == k), OPTS) for k in range(3)]
    for k, part in enumerate(parts):
        part.land(path, "overwrite" if k == 0 else "append", batch=f"b{k}")
    parts[1].land(path, "append", batch="b1")  # the batch failed and ran again
    whole, b = LogAnalyzer(lines, OPTS), LogAnalyzer.from_landed(spark, path, OPTS)
    assert b.parse_quality().collect() == whole.parse_quality().collect()
    assert b.summary().collect() == whole.summary().collect()
    assert b.tree_rows().collect() == whole.tree_rows().collect()
    parts[0].land(path, "overwrite")
    only = LogAnalyzer.from_landed(spark, path, OPTS)
    assert only.summary().collect() == parts[0].summary().collect()
    assert only.parse_quality().collect() == parts[0].parse_quality().collect()


def test_quality_of_a_log_without_entries(spark, tmp_path):
    a = LogAnalyzer(make_lines(spark, ["junk", ""]), OPTS)
    a.land(str(tmp_path / "landed"))
    rows = spark.read.parquet(f"{tmp_path}/landed/_quality").collect()
    assert [(r.format, r.n) for r in rows] == [(None, 2)]


def test_ordered_search_parses_once(spark, tmp_path):
    """What was found is kept before it is sorted, so neither the sort nor its sampling pass parses the log."""
    a = LogAnalyzer(lens(spark, SF), OPTS)
    for found in (a.find_errors(), a.filter_logs(level="ERROR")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "regexp_replace" not in plan and "rangepartitioning" in plan and plan.count("FileScan") == 1
    LogAnalyzer(lens(spark, SF), OPTS).land(str(tmp_path / "landed"))
    b = LogAnalyzer.from_landed(spark, str(tmp_path / "landed"), OPTS)
    assert "landed" in b.find_errors()._jdf.queryExecution().executedPlan().toString()


def test_csv_comes_in_file_order(spark, tmp_path):
    a = LogAnalyzer(lens(spark, SF).repartition(7), OPTS)
    a.export_csv(str(tmp_path / "csv"))
    got = []
    for f in sorted(glob.glob(str(tmp_path / "csv" / "part-*.csv"))):
        with open(f, newline="") as fh:
            got += [(r[0], r[5]) for r in list(csv.reader(fh))[1:]]
    want = [(r.timestamp.isoformat(), r.message) for r in a.entries.orderBy("file_path", "block_start", "line_seq").collect()]
    assert got == want and len(got) > 100


def test_reports_come_in_their_order(spark):
    a = LogAnalyzer(lens(spark, SF), OPTS)
    for dist in (a.service_counts(), a.level_distribution(), a.hourly_distribution()):
        rows = [(r.n, r.key) for r in dist.collect()]
        assert rows == sorted(rows, key=lambda r: (-r[0], r[1])) and len(rows) > 3
    tree = [(str(r.log_date), r.service or "", r.rn, r.part) for r in a.tree_rows().collect()]
    assert tree == sorted(tree) and tree[0][1] == ""
    for found in (a.find_errors(), a.filter_logs(service_pattern="n")):
        rows = [(r.timestamp, r.file_path, r.block_start, r.line_seq) for r in found.collect()]
        assert rows == sorted(rows) and len(rows) > 20


def test_summary_reads_the_entries_once(spark):
    from logarbor.operators import summary
    e = LogAnalyzer(lens(spark, SF), OPTS).entries
    plan = summary.summary_lines(e)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan  # the cell table is already there
    assert "regexp_replace" in summary.cell_counts(e)._jdf.queryExecution().executedPlan().toString()


def test_landing_prunes_partitions(spark, tmp_path):
    a = LogAnalyzer(lens(spark, SF), OPTS)
    a.land(str(tmp_path / "landed"))
    week = read_landed(spark, str(tmp_path / "landed"), OPTS.replace(max_days=7))
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    assert week.count() == LogAnalyzer(lens(spark, SF), OPTS.replace(max_days=7)).entries.count()


def test_metamorphic_sums(spark):
    a = LogAnalyzer(lens(spark, SF), OPTS)
    total = a.summary().first().total_entries
    assert sum(r.n for r in a.service_counts().collect()) == total
    assert sum(r.n for r in a.hourly_distribution().collect()) == total
    nodes = a.tree_nodes().collect()
    assert all(min(r.n, 5) + r.overflow == r.n for r in nodes)
    shown = a.tree_rows().filter("kind = 'entry'").count()
    assert shown == sum(min(r.n, 5) for r in nodes)


def test_search_views(spark):
    a = LogAnalyzer(lens(spark, SF), OPTS)
    errs = a.find_errors().collect()
    last = a.last_errors(k=10).collect()
    assert [r.line_seq for r in last] == [r.line_seq for r in errs[-10:]]
    assert all(r.text.endswith("...") for r in last)
    top = a.top_services_text(3).first().top_services
    assert top.count("(") == 3


def test_summary_approx_services(spark):
    from logarbor.operators.summary import summary
    e = LogAnalyzer(lens(spark, SF), OPTS).entries
    assert summary(e, approx=True).first().unique_services == summary(e).first().unique_services
