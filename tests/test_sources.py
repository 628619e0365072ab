import bz2
import gzip
import lzma
import os
import time
from datetime import datetime

import pytest

from logarbor.operators.parse import parse
from logarbor.options import AnalyzerOptions
from logarbor.sources.discovery import candidates, latest_log, rotation_set
from logarbor.sources.files import read_lines

OPTS = AnalyzerOptions(as_of=datetime(2024, 1, 31), max_days=45)
TEN = [f"Jan {i + 1:2d} 10:00:0{i} web{i} svc{i % 3}[{i}]: message number {i}" for i in range(10)]


def _write(path, data: bytes, opener=open):
    with opener(path, "wb") as fh:
        fh.write(data)


def _key(rows):
    return sorted((r.timestamp, r.service, r.message, r.pid) for r in rows)


def test_codecs_give_the_same_entries(spark, tmp_path):
    text = ("\n".join(TEN) + "\n").encode()
    _write(tmp_path / "a.log", text)
    _write(tmp_path / "a.log.1.gz", text, gzip.open)
    _write(tmp_path / "a.log.2.bz2", text, bz2.open)
    _write(tmp_path / "a.log.3.xz", text, lzma.open)
    expected = None
    for name in ("a.log", "a.log.1.gz", "a.log.2.bz2", "a.log.3.xz"):
        rows = parse(read_lines(spark, str(tmp_path / name)), OPTS).collect()
        assert len(rows) == 10, name
        expected = expected or _key(rows)
        assert _key(rows) == expected
    both = parse(read_lines(spark, str(tmp_path)), OPTS)
    assert both.count() == 40


def test_line_endings_and_bad_utf8(spark, tmp_path):
    data = (TEN[0] + "\r\n" + TEN[1] + "\r" + TEN[2] + "\n").encode() + b"Jan  5 10:00:00 h s: bad \xff\xfe bytes\n"
    _write(tmp_path / "x.log", data)
    rows = parse(read_lines(spark, str(tmp_path / "x.log")), OPTS).collect()
    msgs = sorted(r.message for r in rows)
    assert len(rows) == 4
    assert "bad �� bytes" in msgs
    rows = parse(read_lines(spark, str(tmp_path / "x.log"), decode="ignore"), OPTS).collect()
    assert "bad  bytes" in sorted(r.message for r in rows)


def test_empty_and_truncated(spark, tmp_path):
    _write(tmp_path / "empty.log", b"")
    full = lzma.compress(("\n".join(TEN * 200) + "\n").encode())
    _write(tmp_path / "cut.log.xz", full[: len(full) // 2])
    assert parse(read_lines(spark, str(tmp_path / "empty.log")), OPTS).count() == 0
    full_gz = gzip.compress(("\n".join(TEN * 200) + "\n").encode())
    _write(tmp_path / "cut.log.gz", full_gz[: len(full_gz) // 2])
    for name in ("cut.log.xz", "cut.log.gz"):
        with pytest.raises(Exception):
            parse(read_lines(spark, str(tmp_path / name)), OPTS).count()


def test_a_folder_of_archives_is_parsed_without_a_shuffle(spark, tmp_path):
    for k in range(3):
        _write(tmp_path / f"a{k}.log.gz", ("\n".join(TEN) + "\n").encode(), gzip.open)
    df = parse(read_lines(spark, str(tmp_path)), OPTS)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 30
    dealt = parse(read_lines(spark, str(tmp_path), partitions=5), OPTS)
    assert dealt.rdd.getNumPartitions() == 5 and dealt.count() == 30


def test_line_order_within_file(spark, tmp_path):
    lines = [f"Jan  5 10:00:00 h s: n{i}" for i in range(5000)]
    _write(tmp_path / "big.log", ("\n".join(lines) + "\n").encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = read_lines(spark, str(tmp_path / "big.log"))
        rows = df.orderBy("file_path", "block_start", "line_seq").select("value").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in rows] == lines


def test_discovery_latest_and_rotations(spark, tmp_path):
    as_of = datetime(2024, 1, 5)
    names = ["syslog", "syslog.1", "syslog-20240105", "syslog.1.gz", "other.txt", "messages"]
    now = time.time()
    for i, n in enumerate(names):
        _write(tmp_path / n, b"x\n")
        os.utime(tmp_path / n, (now - 1000 + i * 10, now - 1000 + i * 10))
    os.utime(tmp_path / "syslog.1.gz", (now, now))
    found = {r.name for r in candidates(spark, str(tmp_path), as_of).collect()}
    assert found == {"syslog", "syslog.1", "syslog-20240105", "syslog.1.gz", "messages"}
    assert latest_log(spark, str(tmp_path), as_of).endswith("syslog.1.gz")
    assert sorted(p.rsplit("/", 1)[1] for p in rotation_set(spark, str(tmp_path), "syslog", as_of)) == \
        ["syslog", "syslog-20240105", "syslog.1", "syslog.1.gz"]


def test_latest_log_missing_folder(spark, tmp_path):
    assert latest_log(spark, str(tmp_path / "nope"), datetime(2024, 1, 5)) is None
    (tmp_path / "empty").mkdir()
    assert latest_log(spark, str(tmp_path / "empty"), datetime(2024, 1, 5)) is None


def test_analyzer_finds_its_log(spark, tmp_path):
    from logarbor.plans.analyzer import LogAnalyzer

    _write(tmp_path / "syslog", ("\n".join(TEN) + "\n").encode())
    _write(tmp_path / "syslog.1", ("\n".join(TEN[:4]) + "\n").encode())
    _write(tmp_path / "messages.1.gz", ("\n".join(TEN[:2]) + "\n").encode(), gzip.open)
    now = time.time()
    for i, n in enumerate(("syslog.1", "messages.1.gz", "syslog")):
        os.utime(tmp_path / n, (now + i, now + i))
    a = LogAnalyzer.from_latest(spark, str(tmp_path), OPTS)
    assert a.source.endswith("syslog") and a.entries.count() == 10
    assert LogAnalyzer.from_rotations(spark, str(tmp_path), "syslog", OPTS).entries.count() == 14
    with pytest.raises(FileNotFoundError):
        LogAnalyzer.from_latest(spark, str(tmp_path / "nope"), OPTS)
    with pytest.raises(FileNotFoundError):
        LogAnalyzer.from_rotations(spark, str(tmp_path), "secure", OPTS)
