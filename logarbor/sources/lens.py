"""The lens: renders the ``events`` table as syslog text lines.

No driver table holds log text, so the checks turn each event into one line
(seven line kinds: BSD with and without fraction, ISO, junk, impossible dates,
with and without pid, with and without a [LEVEL] token). The same rendering is
written in DuckDB SQL for the oracle (see ``duck_oracle``).

Output schema is the ``lines`` contract of the library:
``value STRING, file_path STRING, block_start BIGINT, line_seq BIGINT``.
``line_seq`` is the event id (rising with ``ts``); the event sequence is cut
into contiguous chunks of ``chunk_lines`` ids, which play the role of file
blocks for the two-level (per-chunk, then per-file) sequence operators.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Service per event type.
SERVICES = (("error", "kernel"), ("click", "nginx"), ("view", "web.ui"),
            ("signup", "auth-d"), ("purchase", "shop/pay"))
# Level token by event_id % 6.
LEVELS = ("ERROR", "WARN", "INFO", "CRIT", "DEBUG", "FATAL")
# Message word of error events by event_id % 8.
ERROR_WORDS_BY_ID = ("error", "failed", "failure", "exception", "critical", "panic", "errors", "Error")

LENS_FILE = "events"
DEFAULT_CHUNK_LINES = 1 << 13


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


@lru_cache(maxsize=None)
def render_events(shift_days: int = 0) -> Column:
    """The log line of one event (a Column over ``events``; built once per shift)."""
    eid = F.col("event_id")
    t = F.col("ts") - F.make_dt_interval(F.lit(shift_days))
    svc_expr = None
    for etype, name in SERVICES:
        svc_expr = (F.when(F.col("event_type") == etype, F.lit(name)) if svc_expr is None
                    else svc_expr.when(F.col("event_type") == etype, F.lit(name)))
    svc = svc_expr
    word = F.when(F.col("event_type") == "error", _pick(eid % 8, ERROR_WORDS_BY_ID)).otherwise(F.col("event_type"))
    tail = F.concat(
        F.lit("host"), (F.col("user_id") % 8).cast("string"), F.lit(" "), svc,
        F.when(eid % 3 != 0, F.concat(F.lit("["), eid.cast("string"), F.lit("]"))).otherwise(F.lit("")),
        F.lit(": "),
        F.when(eid % 5 == 0, F.concat(F.lit("["), _pick(eid % 6, LEVELS), F.lit("] "))).otherwise(F.lit("")),
        F.lit("user "), F.col("user_id").cast("string"), F.lit(" "), word, F.lit(" props "), F.col("props"),
    )
    mon = F.date_format(t, "MMM")
    clock = F.date_format(t, "HH:mm:ss")
    micros = F.date_format(t, "SSSSSS")
    day = F.lpad(F.dayofmonth(t).cast("string"), 2, " ")
    return (
        F.when(eid % 13 == 2, F.concat(F.lit("no timestamp on this line "), eid.cast("string")))
        .when(eid % 17 == 3, F.concat(mon, F.lit(" 32 10:00:00 host0 cron: impossible date")))
        .when(eid % 11 == 1, F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit("T"), clock, F.lit("."), micros,
                                      F.lit("Z "), tail))
        .otherwise(F.concat(mon, F.lit(" "), day, F.lit(" "), clock,
                            F.when(eid % 7 == 0, F.concat(F.lit("."), micros)).otherwise(F.lit("")),
                            F.lit(" "), tail))
    )


def lens_lines(events: DataFrame, shift_days: int = 0, chunk_lines: int = DEFAULT_CHUNK_LINES) -> DataFrame:
    """``events`` -> ``lines`` (value, file_path, block_start, line_seq)."""
    eid = F.col("event_id")
    return events.select(
        render_events(shift_days).alias("value"),
        F.lit(LENS_FILE).alias("file_path"),
        (F.floor(eid / F.lit(chunk_lines)) * F.lit(chunk_lines)).cast("bigint").alias("block_start"),
        eid.cast("bigint").alias("line_seq"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def lens(spark: SparkSession, sf_dir: str, shift_days: int = 0,
         chunk_lines: int = DEFAULT_CHUNK_LINES, partitions: int | None = None) -> DataFrame:
    """``partitions`` deals the narrow event rows (not the rendered text) out: the driver's table is one row group."""
    events = read_events(spark, sf_dir)
    return lens_lines(events.repartition(partitions, "event_id") if partitions else events, shift_days, chunk_lines)


# ---- the other line kinds: journald, rainerscript, offsets, odd fractions -------------

# Offsets by event_id % 4 (journald has only '+' ones).
PLUS_OFFSETS = ("+0000", "+0130", "+0545", "+2359")
BLANK_OFFSETS = ("+0000", "+0130", "-0500", "+0545")
COLON_OFFSETS = ("+00:00", "+01:30", "-05:00", "+05:45")


@lru_cache(maxsize=None)
def render_mixed() -> Column:
    """One event as a line of kind event_id % 10: every ISO layout the parser knows, lines whose time is bad, and a
    BSD line without fraction and pid."""
    eid, t = F.col("event_id"), F.col("ts")
    svc = None
    for etype, name in SERVICES:
        hit = F.col("event_type") == etype
        svc = F.when(hit, F.lit(name)) if svc is None else svc.when(hit, F.lit(name))
    pid = F.concat(F.lit("["), eid.cast("string"), F.lit("]"))
    host = F.concat(F.lit("host"), (F.col("user_id") % 8).cast("string"), F.lit(" "))
    message = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"),
                       F.lit(" props "), F.col("props"))
    day, clock = F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "HH:mm:ss")
    micros, millis = F.date_format(t, "SSSSSS"), F.date_format(t, "SSS")
    iso = F.concat(day, F.lit("T"), clock)
    level = F.concat(F.lit("["), _pick(eid % 6, LEVELS), F.lit("] "))
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(eid % 10 == 0, c(iso, _pick(eid % 4, PLUS_OFFSETS), " ", host, F.translate(svc, ".-/", "___"), pid,
                                ": ", message))
        .when(eid % 10 == 1, c(iso, ".", micros, _pick(eid % 4, COLON_OFFSETS), " ", host, svc, pid, ": ", level,
                               message))
        .when(eid % 10 == 2, c(iso, ".", millis, _pick(eid % 4, BLANK_OFFSETS), " ", host, svc, " ", message))
        .when(eid % 10 == 3, c(day, " ", clock, " ", host, svc, ": ", message))
        .when(eid % 10 == 4, c("  ", iso, ".", millis, " ", host, svc, pid, ":  ", message, "   "))
        .when(eid % 10 == 5, c(iso, ".", millis, "  ", _pick(eid % 4, BLANK_OFFSETS), " ", host, svc, ": ", message))
        .when(eid % 10 == 6, F.when(eid % 3 == 0, c(iso, ".", micros, "12 ", host, svc, ": ", message))
              .when(eid % 3 == 1, c(day, "T10:00:60 ", host, svc, ": ", message))
              .otherwise(c("2023-02-29T", clock, " ", host, svc, ": ", message)))
        .when(eid % 10 == 7, c(F.date_format(t, "MMM"), " ", F.lpad(F.dayofmonth(t).cast("string"), 2, " "), " ", clock,
                               " ", host, svc, ": ", message))
        .when(eid % 10 == 8, c(iso, "Z +0100 ", host, svc, ": ", message))
        .otherwise(c(iso, ".", micros, "789+01:00 ", host, svc, ": ", message))
    )


def mixed_lens(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    events = read_events(spark, sf_dir)
    events = events.repartition(partitions, "event_id") if partitions else events
    return events.select(render_mixed().alias("value"), F.lit("mixed").alias("file_path"),
                         F.lit(0).cast("bigint").alias("block_start"), F.col("event_id").cast("bigint").alias("line_seq"))


# ---- documents: long texts as log lines --------------------------------------------

DOCS_FILE = "documents"


def document_lines(documents: DataFrame, chunk_lines: int = DEFAULT_CHUNK_LINES) -> DataFrame:
    """``documents`` -> ``lines``: one BSD line per document with the whole text as message.

    ``Jan <dd> <HH:MM:SS> docs <source>[<doc_id>]: <text>``, every fourth with an ``[ERROR]`` level; whitespace runs (newlines
    included) become one blank. The clock is arithmetic on doc_id, so both engines agree.
    """
    d = F.col("doc_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.trim(F.regexp_replace(F.col("text"), r"[ \t\r\n\f]+", " "))
    value = F.concat(
        F.lit("Jan "), F.lpad((d % 28 + 1).cast("string"), 2, " "), F.lit(" "),
        two(d % 24), F.lit(":"), two(F.floor(d / 24) % 60), F.lit(":"), two(F.floor(d / 1440) % 60),
        F.lit(" docs "), F.col("source"), F.lit("["), d.cast("string"), F.lit("]: "),
        F.when(d % 4 == 0, F.lit("[ERROR] ")).otherwise(F.lit("")), text)
    return documents.select(
        value.alias("value"), F.lit(DOCS_FILE).alias("file_path"),
        (F.floor(d / F.lit(chunk_lines)) * F.lit(chunk_lines)).cast("bigint").alias("block_start"),
        d.cast("bigint").alias("line_seq"))


def documents_lens(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return document_lines(docs.repartition(partitions, "doc_id") if partitions else docs)
