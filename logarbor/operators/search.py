"""Searches over entries: errors, service regex, level, message substring, last-k views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logarbor.functions.text import hit_line
from logarbor.sinks.tables import kept_table

TIME_ORDER = ("timestamp", "file_path", "block_start", "line_seq")


def _time_order(desc: bool = False) -> list[Column]:
    return [F.desc(c) if desc else F.asc(c) for c in TIME_ORDER]


def errors_of(entries: DataFrame, service: str | None = None) -> DataFrame:
    """Error entries, optionally of one exact service (unordered)."""
    out = entries.filter(F.col("is_error"))
    if service:
        out = out.filter(F.col("service") == service)
    return out


def matching(entries: DataFrame, service_pattern: str | None = None, level: str | None = None,
             message_contains: str | None = None) -> DataFrame:
    """AND of the given criteria (empty or None = absent), unordered.

    service_pattern   regex *search* in the service name
    level             exact, case-sensitive level
    message_contains  case-insensitive substring of the message
    """
    out = entries
    if service_pattern:
        out = out.filter(F.col("service").rlike(service_pattern))
    if level:
        out = out.filter(F.col("level") == level)
    if message_contains:
        out = out.filter(F.lower("message").contains(message_contains.lower()))
    return out


def time_ordered(rows: DataFrame, stored: bool = False) -> DataFrame:
    """Global time order (ties: file order): one range-partitioned sort.

    The sort samples its input in a pass of its own, so what was found is first kept as a table: the
    log is parsed once, and the sampling pass reads four columns of the hits. ``stored``: the rows
    come from landed entries, where both passes are pruned Parquet scans.
    """
    return (rows if stored else kept_table(rows, "found")).orderBy(*_time_order())


def find_errors(entries: DataFrame, service: str | None = None, stored: bool = False) -> DataFrame:
    """Error entries, optionally of one exact service, in time order (ties: file order)."""
    return time_ordered(errors_of(entries, service), stored)


def filter_logs(entries: DataFrame, service_pattern: str | None = None, level: str | None = None,
                message_contains: str | None = None, stored: bool = False) -> DataFrame:
    """``matching`` in time order (ties: file order)."""
    return time_ordered(matching(entries, service_pattern, level, message_contains), stored)


def tail(df: DataFrame, k: int) -> DataFrame:
    """The last k rows in time order, returned ascending (bounded top-k, no global sort)."""
    return df.orderBy(*_time_order(desc=True)).limit(k).orderBy(*_time_order())


def error_hits(entries: DataFrame, service: str | None = None, k: int = 10, width: int = 100) -> DataFrame:
    """Last k errors rendered as '<ts> [<service>] <message[:width]>...'."""
    last = tail(errors_of(entries, service), k)
    return last.select(*TIME_ORDER, hit_line(F.col("timestamp"), F.col("service"), None,
                                             F.col("message"), width).alias("text"))


def match_hits(matches: DataFrame, k: int = 20, width: int = 80) -> DataFrame:
    """Last k of ``matches`` (pass the unordered ``matching`` frame) rendered as '<ts> [<service>] <level or N/A>: <message[:width]>...'."""
    return tail(matches, k).select(*TIME_ORDER, hit_line(F.col("timestamp"), F.col("service"), F.col("level"),
                                                         F.col("message"), width).alias("text"))
