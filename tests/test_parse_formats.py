from datetime import datetime

import pytest

from log_helpers import AS_OF, make_lines
from logarbor.operators.parse import parse, classify
from logarbor.options import AnalyzerOptions

OPTS = AnalyzerOptions(as_of=AS_OF, max_days=45)

GOOD = [
    ("Jan  5 10:00:00 web1 sshd[812]: session opened", "traditional", datetime(2024, 1, 5, 10), "sshd", "session opened", None, "web1", "812"),
    ("Jan  5 10:00:00.25 web1 sshd[812]: session opened", "traditional", datetime(2024, 1, 5, 10, 0, 0, 250000), "sshd", "session opened", None, "web1", "812"),
    ("Jan  5 10:00:01 web1 cron: job done", "traditional", datetime(2024, 1, 5, 10, 0, 1), "cron", "job done", None, "web1", None),
    ("Jan  5 10:00:02 web1 app: [ERROR] disk full", "with_level", datetime(2024, 1, 5, 10, 0, 2), "app", "disk full", "ERROR", "web1", None),
    ("2024-01-05T10:00:03.5Z web1 nginx[9]: GET /", "iso8601", datetime(2024, 1, 5, 10, 0, 3, 500000), "nginx", "GET /", None, "web1", "9"),
    ("2024-01-05 10:00:03 web1 nginx: GET /", "iso8601", datetime(2024, 1, 5, 10, 0, 3), "nginx", "GET /", None, "web1", None),
    ("2024-01-05T10:00:04+0100 web1 kubelet[77]: pod started", "journald", datetime(2024, 1, 5, 9, 0, 4), "kubelet", "pod started", None, "web1", "77"),
    ("2024-01-05T10:00:05.123456+01:00 web1 my(app)[5]: [WARN] slow", "rainerscript_enhanced", datetime(2024, 1, 5, 9, 0, 5, 123456), "my(app)", "slow", "WARN", "web1", "5"),
    ("Jan  5 10:00:00.1234567 web1 sshd[1]: seven digits", "traditional", datetime(2024, 1, 5, 10, 0, 0, 123456), "sshd", "seven digits", None, "web1", "1"),
    ("Dec 31 23:59:59 web1 sshd: last year", "traditional", datetime(2023, 12, 31, 23, 59, 59), "sshd", "last year", None, "web1", None),
    ("Jan  5 10:00:00 hé1 sshd: unicode host", "traditional", datetime(2024, 1, 5, 10), "sshd", "unicode host", None, "hé1", None),
]

NO_ENTRY = [
    "", "short line 1234", "Foo  5 10:00:00 web1 sshd: other prefix", "Jan  5 10:00:00 web1 sshd no colon",
    "Jan 32 10:00:00 web1 sshd: x", "Feb 30 10:00:00 web1 sshd: x", "Jan  5 10:00:60 web1 sshd: x",
    "Jan  5 24:00:00 web1 sshd: x", "2024-01-05T10:00:03.1234567Z web1 nginx[9]: seven fraction digits",
    "2023-11-01T10:00:00Z web1 nginx: older than the window", "2024-02-02T10:00:00Z web1 nginx: over a day ahead",
    "2024-01-05T10:00:03Z +0100 web1 nginx: Z and offset",
]


def test_good_lines(spark):
    df = make_lines(spark, [g[0] for g in GOOD])
    got = {r.line_seq: r for r in parse(df, OPTS).collect()}
    assert len(got) == len(GOOD)
    for i, (line, fmt, ts, svc, msg, level, host, pid) in enumerate(GOOD):
        r = got[i]
        assert (r.format, r.timestamp, r.service, r.message, r.level, r.host, r.pid) == (fmt, ts, svc, msg, level, host, pid), line
        assert r.raw_line == line
        assert r.log_date == ts.date() and r.hour_bucket == ts.strftime("%H:00")


def test_no_entry_lines(spark):
    df = make_lines(spark, NO_ENTRY)
    assert parse(df, OPTS).count() == 0
    assert classify(df, OPTS).count() == len(NO_ENTRY)


def test_blank_offset_is_converted(spark):
    df = make_lines(spark, ["2024-01-05T10:00:03 -0200 web1 nginx: blank offset"])
    (r,) = parse(df, OPTS).collect()
    assert r.timestamp == datetime(2024, 1, 5, 12, 0, 3)


def test_offsets_drop(spark):
    df = make_lines(spark, ["2024-01-05T10:00:04+0100 web1 kubelet[77]: pod started",
                            "2024-01-05T10:00:03Z web1 nginx: zulu stays"])
    rows = parse(df, OPTS.replace(offsets="drop")).collect()
    assert [r.message for r in rows] == ["zulu stays"]


def test_levels_off_restores_parity(spark):
    df = make_lines(spark, ["Jan  5 10:00:02 web1 app: [ERROR] disk full"])
    (r,) = parse(df, OPTS.replace(formats=("traditional", "traditional_simple", "iso8601"))).collect()
    assert r.level is None and r.message == "[ERROR] disk full" and r.format == "traditional"


def test_line_with_newline_field_separator(spark):
    df = make_lines(spark, ["Jan  5 10:00:00 web1 sshd: a\nb", "Jan  5 10:00:00 web1 sshd: tab\there"])
    rows = parse(df, OPTS).collect()
    assert [r.message for r in rows] == ["tab\there"]


def test_leap_day_rollback(spark):
    df = make_lines(spark, ["Feb 29 10:00:00 web1 sshd: leap"])
    (r,) = parse(df, AnalyzerOptions(as_of=datetime(2025, 1, 31), max_days=365)).collect()
    assert r.timestamp == datetime(2024, 2, 29, 10)


def test_error_modes(spark):
    lines = ["Jan  5 10:00:00 web1 a: all errors here", "Jan  5 10:00:00 web1 a: An Error here",
             "Jan  5 10:00:00 web1 a: [FATAL] quiet", "Jan  5 10:00:00 web1 a: panicked? no",
             "Jan  5 10:00:00 web1 a: kernel panic"]
    df = make_lines(spark, lines)
    word = [r.is_error for r in parse(df, OPTS).orderBy("line_seq").collect()]
    sub = [r.is_error for r in parse(df, OPTS.replace(error_mode="substring")).orderBy("line_seq").collect()]
    assert word == [False, True, True, False, True]
    assert sub == [True, True, True, True, True]


@pytest.mark.parametrize("bad", [dict(max_days=0), dict(truncate_length=5), dict(max_lines_per_service=0),
                                 dict(year_mode="x"), dict(formats=("nope",))])
def test_option_ranges(bad):
    with pytest.raises(ValueError):
        AnalyzerOptions(as_of=AS_OF, **bad)
