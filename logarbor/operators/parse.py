"""Lines -> typed log entries.

Plan shape (all JVM expressions, one pass per line):

    lines ─ strip ─ pre-check/route ─ regexp_replace(alternation) ─ split
          ─ [Generate barrier] ─ timestamp (year mode) ─ day window ─ entries

The Generate barrier (``explode(array(x))``) keeps the regex result a real
column: Catalyst would otherwise substitute the expression into every filter
pushed below the projection and run the regex again.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logarbor.functions import timestamps as ts
from logarbor.functions.errors import is_error
from logarbor.functions.formats import DATE_PREFIX, FIELDS, MONTHS, family_matcher
from logarbor.functions.text import py_strip
from logarbor.operators.years import YearScan, with_year_column
from logarbor.options import AnalyzerOptions

LINE_COLUMNS = ("value", "file_path", "block_start", "line_seq")
ORDER_COLUMNS = ("file_path", "block_start", "line_seq")
MIN_LINE_LENGTH = 15

ENTRY_COLUMNS = (
    "timestamp", "service", "message", "level", "host", "pid", "raw_line", "format",
    "log_date", "hour_bucket", "is_error", "file_path", "block_start", "line_seq",
)


def route(line: Column) -> Column:
    """'bsd' for a month-name prefix, 'iso' for a YYYY-MM-DD prefix, NULL otherwise.

    Lines shorter than 15 characters never qualify.
    """
    long_enough = F.length(line) >= MIN_LINE_LENGTH
    return (F.when(long_enough & F.substring(line, 1, 3).isin(*MONTHS), F.lit("bsd"))
            .when(long_enough & line.rlike("(?U)" + DATE_PREFIX), F.lit("iso")))


@lru_cache(maxsize=None)
def _match_columns(formats: tuple[str, ...]) -> tuple[tuple[Column, ...], Column, tuple[Column, ...]]:
    """Column expressions of ``match_lines`` for one format set.

    Built once per format set and reused: the expressions are unresolved, so any
    DataFrame with the ``lines`` columns can take them (saves thousands of py4j calls).
    """
    line = py_strip(F.col("value"))
    stage = (line.alias("raw_line"), F.col("file_path"), F.col("block_start"), F.col("line_seq"),
             route(line).alias("route"))

    matchers = {fam: family_matcher(fam, formats) for fam in ("bsd", "iso")}
    rewritten = None
    raw = F.col("raw_line")
    is_ascii = F.length(raw) == F.octet_length(raw)
    for fam, m in matchers.items():
        if m is None:
            continue
        rep = F.when(is_ascii, F.regexp_replace(raw, F.lit(m.ascii_pattern), F.lit(m.replacement))) \
            .otherwise(F.regexp_replace(raw, F.lit(m.pattern), F.lit(m.replacement)))
        cond = F.col("route") == fam
        rewritten = F.when(cond, rep) if rewritten is None else rewritten.when(cond, rep)
    if rewritten is None:
        rewritten = F.lit(None).cast("string")
    # one regex pass: a match starts with '\n', so the first split element is empty
    gen = F.explode(F.array(F.split(rewritten, "\n"))).alias("parts")

    p = F.col("parts")
    ok = None
    for fam, m in matchers.items():
        if m is None:
            continue
        cond = (F.col("route") == fam) & (F.size(p) == m.n_fields + 1)
        ok = cond if ok is None else ok | cond
    ok = (F.get(p, 0) == "") & (ok if ok is not None else F.lit(False))
    nf = len(FIELDS)
    cols = [F.col("raw_line"), F.col("file_path"), F.col("block_start"), F.col("line_seq"), F.col("route")]
    for i, name in enumerate(FIELDS):
        cols.append(F.get(p, i + 1).alias(name))
    # which format matched: the first non-empty message field of the route's family
    fmt = None
    msg = None
    level_field = F.get(p, FIELDS.index("level") + 1)
    for fam, m in matchers.items():
        if m is None:
            continue
        for j, labels in enumerate(m.labels):
            field = F.get(p, nf + j + 1)
            cond = ok & (F.col("route") == fam) & (field != "")
            name = (F.lit(labels[0]) if len(labels) == 1
                    else F.when(level_field != "", F.lit(labels[0])).otherwise(F.lit(labels[1])))
            fmt = F.when(cond, name) if fmt is None else fmt.when(cond, name)
            msg = F.when(cond, field) if msg is None else msg.when(cond, field)
    cols.append((fmt if fmt is not None else F.lit(None).cast("string")).alias("format"))
    cols.append((msg if msg is not None else F.lit(None).cast("string")).alias("msg"))
    return stage, gen, tuple(cols)


def match_lines(lines: DataFrame, opts: AnalyzerOptions) -> DataFrame:
    """Every line, with the format that matched (NULL: none) and its raw fields."""
    stage, gen, cols = _match_columns(opts.formats)
    # Generate barrier: the regex result is a real column, computed once per line
    return lines.select(*stage).select("*", gen).select(*cols)


@lru_cache(maxsize=None)
def _month_columns(formats: tuple[str, ...]) -> tuple[tuple[Column, ...], Column, Column, Column, tuple[Column, ...]] | None:
    """``match_lines`` cut down to what the year modes need: is a month-name line matched, and its month."""
    m = family_matcher("bsd", formats)
    if m is None:
        return None
    raw, keys = F.col("raw_line"), [F.col(c) for c in ORDER_COLUMNS]
    rep = F.when(F.length(raw) == F.octet_length(raw), F.regexp_replace(raw, F.lit(m.ascii_pattern), F.lit(m.replacement))
                 ).otherwise(F.regexp_replace(raw, F.lit(m.pattern), F.lit(m.replacement)))
    p = F.col("parts")
    said = F.exists(F.slice(p, len(FIELDS) + 2, len(m.labels)), lambda x: x != "")
    return ((py_strip(F.col("value")).alias("raw_line"), *keys),
            (F.length(raw) >= MIN_LINE_LENGTH) & F.substring(raw, 1, 3).isin(*MONTHS),
            F.explode(F.array(F.split(rep, "\n"))).alias("parts"),
            (F.get(p, 0) == "") & (F.size(p) == m.n_fields + 1) & said,
            (*keys, F.substring(raw, 1, 3).alias("mon")))


def month_lines(lines: DataFrame, opts: AnalyzerOptions) -> DataFrame:
    """(line key, mon) of the lines that match a format without a year."""
    columns = _month_columns(opts.formats)
    if columns is None:
        return lines.select(*ORDER_COLUMNS, F.lit(None).cast("string").alias("mon")).filter(F.lit(False))
    stage, routed, gen, ok, out = columns
    return lines.select(*stage).filter(routed).select("*", gen).filter(ok).select(*out)


@lru_cache(maxsize=None)
def _iso_text_columns() -> tuple[Column, ...]:
    c = F.col
    texts = ts.iso_texts(c("frac"), c("off"), c("boff"), c("tail"))
    is_iso = c("route") == "iso"
    return (F.when(is_iso, texts["frac"]).otherwise(c("frac")).alias("_fr"),
            F.when(is_iso, texts["offset"]).otherwise(F.lit("")).alias("_ofs"))


@lru_cache(maxsize=None)
def _part_columns(offsets: str) -> tuple[Column, ...]:
    c = F.col
    is_bsd = c("route") == "bsd"
    iso = ts.iso_parts(c("date"), c("_fr"), c("_ofs"), c("z"), c("boff"), c("tail"), offsets)
    hh, mi, ss = ts.clock_parts(c("clock"))
    return (
        F.when(is_bsd, F.lit(None).cast("int")).otherwise(iso["year"]).alias("_y"),
        F.when(is_bsd, ts.month_number(c("mon"))).otherwise(iso["month"]).alias("_mo"),
        F.when(is_bsd, c("day").try_cast("int")).otherwise(iso["day"]).alias("_d"),
        hh.alias("_hh"), mi.alias("_mi"), ss.alias("_ss"),
        ts.micros_of(c("_fr")).alias("_us"),
        F.when(is_bsd, F.lit(0)).otherwise(iso["off_minutes"]).alias("_offm"),
        F.when(is_bsd, F.lit(False)).otherwise(iso["bad"]).alias("_bad"),
    )


def _with_parts(matched: DataFrame, opts: AnalyzerOptions) -> DataFrame:
    """Numeric timestamp parts of matched lines: _y (ISO only), _mo, _d, _hh, _mi, _ss, _us, _offm, _bad.

    The ISO fraction/offset texts are a projection of their own, so the numeric
    parts refer to them as columns instead of repeating their expressions.
    """
    return matched.select("*", *_iso_text_columns()).select("*", *_part_columns(opts.offsets)).drop("_fr", "_ofs")


PART_COLUMNS = ("_y", "_mo", "_d", "_hh", "_mi", "_ss", "_us", "_offm", "_bad")


@lru_cache(maxsize=16)
def _rollback_year(as_of) -> Column:
    c = F.col
    return F.when(c("route") == "bsd", ts.rollback_year(as_of, c("_mo"), c("_d"), c("_hh"), c("_mi"), c("_ss"),
                                                       c("_us"))).otherwise(c("_y")).alias("_year")


@lru_cache(maxsize=16)
def _timestamp_columns(as_of, max_days: int) -> tuple[Column, Column]:
    c = F.col
    local = ts.make_ts(c("_year"), c("_mo"), c("_d"), c("_hh"), c("_mi"), c("_ss"), c("_us"))
    utc = F.when(c("_offm") == 0, local).otherwise(F.timestamp_add("MINUTE", -c("_offm"), local))
    raw = F.when(c("format").isNull() | c("_bad"), F.lit(None).cast("timestamp_ntz")).otherwise(utc)
    lo, hi = ts.window_bounds(as_of, max_days)
    keep = (c("_ts") >= ts.ntz_literal(lo)) & (c("_ts") <= ts.ntz_literal(hi))
    return F.explode(F.array(raw)).alias("_ts"), F.when(keep, c("_ts")).alias("timestamp")


def assign_timestamps(matched: DataFrame, opts: AnalyzerOptions, months: DataFrame | None = None,
                      scan: YearScan | None = None) -> DataFrame:
    """Adds ``timestamp``: NULL when the line gives no entry (no match, bad date, outside the window).

    ``months``: the lines without a year as from ``month_lines``, which the file-order year modes need
    where no ``scan`` of them is given.
    """
    c = F.col
    is_bsd = c("route") == "bsd"
    if opts.year_mode == "rollback":
        staged = _with_parts(matched, opts).select("*", _rollback_year(opts.as_of))
    else:
        # transition / sequential: the year depends on earlier lines of the same file
        staged = _with_parts(with_year_column(matched, opts, months, scan=scan), opts)
        staged = staged.withColumn("_year", F.when(is_bsd, c("year")).otherwise(c("_y"))).drop("year")
    gen, timestamp = _timestamp_columns(opts.as_of, opts.max_days)
    keep = [x for x in staged.columns if x not in PART_COLUMNS and x != "_year"]
    # second Generate barrier: the timestamp is computed once, then only compared
    return staged.select("*", gen).select(*keep, timestamp)


@lru_cache(maxsize=None)
def _entry_columns(error_mode: str) -> tuple[Column, ...]:
    c = F.col
    level = F.when(c("level") != "", c("level"))
    message = py_strip(c("msg"))
    return (
        c("timestamp"),
        py_strip(c("svc")).alias("service"),
        message.alias("message"),
        level.alias("level"),
        F.when(c("host") != "", c("host")).alias("host"),
        F.when(c("pid") != "", c("pid")).alias("pid"),
        c("raw_line"),
        c("format"),
        F.to_date(c("timestamp")).alias("log_date"),
        F.date_format(c("timestamp"), "HH:00").alias("hour_bucket"),
        is_error(level, message, error_mode).alias("is_error"),
        c("file_path"), c("block_start"), c("line_seq"),
    )


def to_entries(classified: DataFrame, opts: AnalyzerOptions) -> DataFrame:
    """Typed entries from classified lines (rows with a timestamp)."""
    return classified.filter(F.col("timestamp").isNotNull()).select(*_entry_columns(opts.error_mode))


def classify(lines: DataFrame, opts: AnalyzerOptions, scan: YearScan | None = None) -> DataFrame:
    """All lines, each with its format and timestamp (NULL: no entry).

    ``scan``: year marks of these lines and the state of earlier parts, for a log that arrives in parts.
    """
    months = None if opts.year_mode == "rollback" or scan else month_lines(lines, opts)
    return assign_timestamps(match_lines(lines, opts), opts, months, scan)


def parse(lines: DataFrame, opts: AnalyzerOptions) -> DataFrame:
    """lines -> entries (see ENTRY_COLUMNS)."""
    return to_entries(classify(lines, opts), opts)
