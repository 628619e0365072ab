import random
from datetime import datetime

from log_helpers import AS_OF, make_lines
from logarbor.operators.parse import parse
from logarbor.options import AnalyzerOptions

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def model_years(months, mode, base):
    """Plain-Python model of the year of each BSD line (months as numbers)."""
    out, prev, year = [], None, base
    for m in months:
        step = 1 if (prev == 12 and m == 1) else -1 if (prev == 1 and m == 12) else 0
        if mode == "sequential":
            year += step
            out.append(year)
        else:
            out.append(base + step)
        prev = m
    return out


def years_of(spark, months, mode, base, block_rows=None, **levels):
    lines = [f"{MONTHS[m - 1]} 10 10:00:00 h s: line {i}" for i, m in enumerate(months)]
    df = make_lines(spark, lines, block_rows=block_rows)
    opts = AnalyzerOptions(as_of=datetime(2024, 1, 31), max_days=45, year_mode=mode, base_year=base)
    from logarbor.operators.years import with_year_column
    from logarbor.operators.parse import match_lines
    m = match_lines(df, opts)
    ys = with_year_column(m, opts, **levels).orderBy("line_seq").collect()
    assert all(r.year is not None for r in ys)
    return [r.year for r in ys]


SEQS = [
    [12, 12, 1, 1, 2],
    [1, 12, 1, 1],
    [12, 1, 12, 1, 12, 12, 1, 3],
    [6, 7, 12, 12, 12, 1, 1, 1, 12, 1],
]


def test_sequential_and_transition_match_model(spark):
    for months in SEQS:
        for mode in ("sequential", "transition"):
            for block_rows in (None, 1, 2, 3):
                got = years_of(spark, months, mode, 2023, block_rows)
                assert got == model_years(months, mode, 2023), (months, mode, block_rows)


def test_chunks_and_segments_of_few_lines(spark):
    """The three levels of the scan, with steps inside and between segments, chunks and blocks."""
    rng = random.Random(1)
    months = [rng.choice([12, 12, 1, 1, 6]) for _ in range(200)]
    for block_rows, chunk_rows, segment_lines in ((None, 8, 4), (37, 16, 2), (50, 64, 64), (None, 1, 1)):
        for mode in ("sequential", "transition"):
            got = years_of(spark, months, mode, 2023, block_rows, chunk_rows=chunk_rows, segment_lines=segment_lines)
            assert got == model_years(months, mode, 2023), (mode, block_rows, chunk_rows, segment_lines)


def test_files_do_not_share_steps(spark):
    a = make_lines(spark, ["Dec 31 10:00:00 h s: a", "Jan  1 10:00:00 h s: a"], "a.log")
    b = make_lines(spark, ["Jun  1 10:00:00 h s: b", "Jun  2 10:00:00 h s: b"], "b.log")
    opts = AnalyzerOptions(as_of=AS_OF, max_days=45, year_mode="sequential", base_year=2023)
    got = sorted((r.file_path, r.timestamp.year) for r in parse(a.unionByName(b), opts.replace(max_days=365)).collect())
    assert got == [("a.log", 2023), ("a.log", 2024), ("b.log", 2023), ("b.log", 2023)]


def test_impossible_date_advances_state(spark):
    lines = ["Dec 20 10:00:00 h s: a", "Jan 32 10:00:00 h s: impossible", "Jan  2 10:00:00 h s: b"]
    df = make_lines(spark, lines)
    opts = AnalyzerOptions(as_of=AS_OF, max_days=45, year_mode="sequential", base_year=2023)
    got = [(r.line_seq, r.timestamp) for r in parse(df, opts).orderBy("line_seq").collect()]
    assert got == [(0, datetime(2023, 12, 20, 10)), (2, datetime(2024, 1, 2, 10))]


def test_rollback_crosses_year(spark):
    df = make_lines(spark, ["Dec 20 10:00:00 h s: a", "Jan  2 10:00:00 h s: b"])
    got = [r.timestamp for r in parse(df, AnalyzerOptions(as_of=AS_OF, max_days=45)).orderBy("line_seq").collect()]
    assert got == [datetime(2023, 12, 20, 10), datetime(2024, 1, 2, 10)]


def test_sequential_default_base_lands_in_future(spark):
    # a Dec -> Jan file read in January with the base year of as_of: Dec is a year ahead and dropped
    df = make_lines(spark, ["Dec 20 10:00:00 h s: a", "Jan  2 10:00:00 h s: b"])
    rows = parse(df, AnalyzerOptions(as_of=AS_OF, max_days=45, year_mode="sequential")).collect()
    assert rows == []


def test_other_lines_do_not_move_the_year(spark):
    lines = ["Dec 20 10:00:00 h s: a", "2024-01-01T00:00:00Z h s: iso", "junk", "Jan  2 10:00:00 h s: b",
             "2023-12-31T10:00:00Z h s: iso dec", "Jan  3 10:00:00 h s: c"]
    for block_rows in (None, 1, 2):
        df = make_lines(spark, lines, block_rows=block_rows)
        opts = AnalyzerOptions(as_of=AS_OF, max_days=45, year_mode="sequential", base_year=2023)
        got = [r.timestamp for r in parse(df, opts).orderBy("line_seq").collect()]
        assert got == [datetime(2023, 12, 20, 10), datetime(2024, 1, 1), datetime(2024, 1, 2, 10),
                       datetime(2023, 12, 31, 10), datetime(2024, 1, 3, 10)], block_rows
