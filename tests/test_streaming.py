import time
from datetime import datetime

from logarbor.operators.parse import parse
from logarbor.options import AnalyzerOptions
from logarbor.sources.files import read_lines
from logarbor.streaming.stream import (PARTS, read_daily_counts, running_counts, stream_entries, write_daily_counts,
                                       write_entries, write_entries_in_file_order)

OPTS = AnalyzerOptions(as_of=datetime(2024, 1, 31), max_days=45)
LINES = [f"Jan {i % 28 + 1:2d} 1{i % 10}:00:00 web{i % 3} svc{i % 4}[{i}]: message {'error' if i % 5 == 0 else 'ok'} {i}"
         for i in range(300)] + ["junk line without a timestamp", "2024-01-07T08:00:00.5Z h nginx: iso line"]


def _write_files(folder):
    folder.mkdir()
    for k in range(3):
        (folder / f"part{k}.log").write_text("\n".join(LINES[k::3]) + "\n")


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    _write_files(src)
    batch = parse(read_lines(spark, str(src)), OPTS)
    stream = stream_entries(spark, str(src), OPTS, max_files_per_trigger=1)
    q = write_entries(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), "parquet")
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    cols = ["timestamp", "service", "message", "level", "host", "pid", "format", "is_error"]
    assert sorted(got.select(cols).collect()) == sorted(batch.select(cols).collect())


def test_running_counts_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    _write_files(src)
    stream = stream_entries(spark, str(src), OPTS, max_files_per_trigger=1)
    q = (running_counts(stream, "service").writeStream.outputMode("complete").format("memory")
         .queryName("svc_counts").option("checkpointLocation", str(tmp_path / "ck2"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.key: r.n for r in spark.sql("SELECT * FROM svc_counts").collect()}
    batch = parse(read_lines(spark, str(src)), OPTS).groupBy("service").count().collect()
    assert got == {r.service: r["count"] for r in batch}


def test_daily_clusters_equal_batch(spark, tmp_path):
    from pyspark.sql import functions as F
    from logarbor.operators.clusters import error_pattern
    from logarbor.streaming.stream import daily_clusters

    src = tmp_path / "in"
    _write_files(src)
    stream = stream_entries(spark, str(src), OPTS, max_files_per_trigger=1)
    q = (daily_clusters(stream, OPTS).writeStream.outputMode("update").format("memory")
         .queryName("day_clusters").option("checkpointLocation", str(tmp_path / "ck3"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(str(r.day.start.date()), r.service, r.pattern): r.n
           for r in spark.sql("SELECT * FROM day_clusters").collect()}
    batch = (parse(read_lines(spark, str(src)), OPTS).filter("is_error")
             .groupBy(F.to_date("timestamp").alias("d"), "service", error_pattern(F.col("message")).alias("p"))
             .count().collect())
    assert got == {(str(r.d), r.service, r.p): r["count"] for r in batch}


def test_file_order_year_modes_on_a_stream(spark, tmp_path):
    from logarbor.streaming.stream import write_entries_in_file_order
    src = tmp_path / "in"
    src.mkdir()
    dec_jan = ["Dec 30 10:00:00 h s: a", "Dec 31 11:00:00 h s: b", "2024-01-01T00:00:00Z h s: iso",
               "Jan  1 09:00:00 h s: c", "Jan  2 10:00:00 h s: d"]
    for k in range(3):
        (src / f"f{k}.log").write_text("\n".join(dec_jan[k:] + dec_jan[:k]) + "\n")
    for mode in ("sequential", "transition"):
        opts = OPTS.replace(year_mode=mode, base_year=2023)
        out = tmp_path / f"out_{mode}"
        q = write_entries_in_file_order(spark, str(src), str(out), str(tmp_path / f"ck_{mode}"), opts,
                                        max_files_per_trigger=1)
        q.awaitTermination()
        got = sorted(spark.read.parquet(str(out)).select("file_path", "timestamp", "message").collect())
        batch = sorted(parse(read_lines(spark, str(src)), opts).select("file_path", "timestamp", "message").collect())
        assert got == batch, mode
        assert len(got) > 5
        assert list(out.glob("batch=*/log_date=*"))


def test_no_entry_of_the_day_window_is_late(spark, tmp_path):
    """The newest file comes first; the oldest day of the window still counts."""
    from pyspark.sql import functions as F
    from logarbor.streaming.stream import daily_counts

    src = tmp_path / "in"
    src.mkdir()
    opts = AnalyzerOptions(as_of=datetime(2024, 1, 31, 12), max_days=7)
    for k, line in enumerate(("Feb  1 11:00:00 h s: new", "Jan 30 10:00:00 h s: mid", "Jan 24 13:00:00 h s: old",
                              "Feb  1 11:30:00 h s: last")):
        (src / f"f{k}.log").write_text(line + "\n")
        time.sleep(0.05)
    stream = stream_entries(spark, str(src), opts, max_files_per_trigger=1)
    q = (daily_counts(stream, opts).writeStream.outputMode("update").format("memory").queryName("late_days")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {}
    for r in spark.sql("SELECT * FROM late_days").collect():
        got[str(r.day.start.date())] = max(r.n, got.get(str(r.day.start.date()), 0))
    batch = parse(read_lines(spark, str(src)), opts).groupBy(F.to_date("timestamp").alias("d")).count().collect()
    assert got == {str(r.d): r["count"] for r in batch} and "2024-01-24" in got


def test_running_views_equal_batch(spark, tmp_path):
    from logarbor.operators.clusters import error_clusters_by_service
    from logarbor.streaming.stream import running_clusters, running_errors

    src = tmp_path / "in"
    _write_files(src)
    batch = parse(read_lines(spark, str(src)), OPTS)
    wanted = {
        "level": (lambda e: running_counts(e, "level"), batch.where("level IS NOT NULL").selectExpr("upper(level) AS key")
                  .groupBy("key").count()),
        "hour": (lambda e: running_counts(e, "hour_bucket"), batch.groupBy("hour_bucket").count()),
        "errors": (running_errors, batch.selectExpr("count(*)", "count_if(is_error)")),
        "clusters": (running_clusters, error_clusters_by_service(batch)),
    }
    for name, (view, want) in wanted.items():
        stream = stream_entries(spark, str(src), OPTS, max_files_per_trigger=1)
        q = (view(stream).writeStream.outputMode("complete").format("memory").queryName(f"run_{name}")
             .option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start())
        q.awaitTermination()
        got = sorted(tuple(r) for r in spark.sql(f"SELECT * FROM run_{name}").collect())
        assert got == sorted(tuple(r) for r in want.collect()), name


def test_csv_stream_writes_what_the_batch_writes(spark, tmp_path):
    import glob
    from logarbor.sinks.writers import write_csv

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_text('Jan  5 10:00:00 h s: "say "hi", ok"\nJan  5 10:00:01 h s[1]: a,b\\ c\n')
    q = write_entries(stream_entries(spark, str(src), OPTS), str(tmp_path / "out"), str(tmp_path / "ck"), "csv")
    q.awaitTermination()
    write_csv(parse(read_lines(spark, str(src)), OPTS), str(tmp_path / "batch"))
    text = lambda d: sorted(x for f in glob.glob(str(tmp_path / d / "part-*.csv")) for x in open(f))
    assert text("out") == text("batch") and len(text("out")) == 3


def test_streamed_lines_keep_their_order_and_decoding(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_bytes(b"".join(b"Jan  5 10:00:00 h s: n%d \xff\n" % i for i in range(50)))
    (src / "b.log.xz").write_bytes(b"not text")
    opts = OPTS.replace(decode="ignore")
    assert "line_seq" not in stream_entries(spark, str(src), opts).columns
    q = write_entries_in_file_order(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), opts)
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("file_path", "block_start", "line_seq").collect()
    assert [r.message for r in rows] == [f"n{i}" for i in range(50)]


YEAR_ENDS = [["Dec 30 10:00:00 h s: a0", "Dec 31 11:00:00 h s: a1", "2024-01-01T00:00:00Z h s: iso"],
             ["junk", "Jan  1 09:00:00 h s: b0", "Jan  2 10:00:00 h s: b1", "Dec 31 23:00:00 h s: b2"],
             ["2024-01-03T00:00:00Z h s: iso without a month before it"],
             ["Jan  3 09:00:00 h s: c0", "Dec 29 09:00:00 h s: c1", "Jan  4 09:00:00 h s: c2"]]


def test_a_log_in_parts_over_micro_batches_keeps_its_year(spark, tmp_path):
    """Each part comes in a micro-batch of its own, after a restart, and a second log between them."""
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "app.log").write_text("\n".join(x for part in YEAR_ENDS for x in part) + "\n")
    other = ["Dec 31 08:00:00 h o: x", "Jan  1 08:00:00 h o: y"]
    (whole / "other.log").write_text("\n".join(other) + "\n")
    for mode in ("sequential", "transition"):
        opts = OPTS.replace(year_mode=mode, base_year=2023)
        src, out = tmp_path / f"in_{mode}", tmp_path / f"out_{mode}"
        src.mkdir()
        for k, part in enumerate(YEAR_ENDS):
            (src / f"app.log.part-{k:03d}").write_text("\n".join(part) + "\n")
            if k in (0, 3):
                (src / f"other.log.part{k}").write_text(other[k // 3] + "\n")
            write_entries_in_file_order(spark, str(src), str(out), str(tmp_path / f"ck_{mode}"), opts,
                                        parts=PARTS).awaitTermination()
        columns = ["timestamp", "service", "message"]
        landed = spark.read.parquet(str(out))
        want = parse(read_lines(spark, str(whole)), opts)
        assert sorted(landed.select(columns).collect()) == sorted(want.select(columns).collect()), mode
        assert len({r.file_path for r in landed.select("file_path").collect()}) == 2
        got = [r.message for r in landed.where("service = 's'").orderBy("block_start", "line_seq").collect()]
        assert got == [r.message for r in want.where("service = 's'").orderBy("block_start", "line_seq").collect()]
        state = spark.read.parquet(str(out / "_years" / "batch=3")).collect()
        assert sorted((r.file_path.rsplit("/", 1)[1], r.last_m, r.change) for r in state) == [
            ("app.log", 1, 1), ("other.log", 1, 1)]


def test_parts_in_one_micro_batch_and_files_that_are_no_parts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k, part in enumerate(YEAR_ENDS):
        (src / f"app.log.part{k + 8}").write_text("\n".join(part) + "\n")  # 8, 9, 10, 11: by number, not by name
    (src / "alone.log").write_text("Dec 31 08:00:00 h o: x\nJan  1 08:00:00 h o: y\n")
    opts = OPTS.replace(year_mode="sequential", base_year=2023)
    write_entries_in_file_order(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), opts,
                                parts=PARTS).awaitTermination()
    rows = {r.message: r.timestamp.year for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (rows["a1"], rows["b0"], rows["b2"], rows["c0"], rows["c1"], rows["c2"]) == (2023, 2024, 2023, 2024, 2023, 2024)
    assert (rows["x"], rows["y"]) == (2023, 2024)


def test_late_rows_are_counted_and_kept(spark, tmp_path):
    """Files out of order: counts in time and late ones together are those of a batch."""
    from pyspark.sql import functions as F

    src = tmp_path / "in"
    src.mkdir()
    files = [["Jan 10 10:00:00 h s: a error", "Jan 10 11:00:00 h t: b"],
             ["Jan 12 00:00:00 h s: c", "Jan  9 10:00:00 h s: same batch, no day is closed by it"],
             ["Jan 11 10:00:00 h s: still open", "Jan 10 12:00:00 h s: d error late", "Jan 10 12:00:01 h s: e late"],
             ["no entry"],
             ["Jan  5 10:00:00 h u: f late"]]
    stream = stream_entries(spark, str(src), OPTS)
    for k, lines in enumerate(files):
        (src / f"f{k}.log").write_text("\n".join(lines) + "\n")
        write_daily_counts(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(str(r.log_date), r.service): (r.n, r.errors, r.late_n, r.late_errors, r.closed)
           for r in read_daily_counts(spark, str(tmp_path / "out")).collect()}
    assert got == {("2024-01-10", "s"): (1, 1, 2, 1, True), ("2024-01-10", "t"): (1, 0, 0, 0, True),
                   ("2024-01-12", "s"): (1, 0, 0, 0, False), ("2024-01-09", "s"): (1, 0, 0, 0, True),
                   ("2024-01-11", "s"): (1, 0, 0, 0, False), ("2024-01-05", "u"): (0, 0, 1, 0, True)}
    batch = parse(read_lines(spark, str(src)), OPTS)
    want = batch.groupBy("log_date", "service").agg(F.count("*").alias("n"), F.count_if("is_error").alias("e")).collect()
    assert {k: (v[0] + v[2], v[1] + v[3]) for k, v in got.items()} == {(str(r.log_date), r.service): (r.n, r.e) for r in want}
    late = spark.read.parquet(str(tmp_path / "out" / "late"))
    assert sorted(r.message for r in late.collect()) == ["d error late", "e late", "f late"]
    assert "raw_line" in late.columns
