"""Parse quality: lines read, entries produced, success rate; entries per format, file and host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_quality(classified: DataFrame) -> DataFrame:
    """One row: lines, entries, success_pct (percent, one decimal; 0.0 without lines)."""
    return classified.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("timestamp").alias("entries"),
    ).select("lines", "entries",
             F.coalesce(F.round(F.try_divide(F.col("entries") * F.lit(100.0), F.col("lines")), 1),
                        F.lit(0.0)).alias("success_pct"))


def quality_of_counts(counts: DataFrame) -> DataFrame:
    """``parse_quality`` from (format, n) as ``format_counts`` gives it."""
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"),
                      F.coalesce(F.sum(F.when(F.col("format").isNotNull(), F.col("n"))), F.lit(0)).alias("entries")).select(
        "lines", "entries", F.coalesce(F.round(F.try_divide(F.col("entries") * F.lit(100.0), F.col("lines")), 1),
                                       F.lit(0.0)).alias("success_pct"))


def format_profile(classified: DataFrame) -> DataFrame:
    """(file_path, host, format, n): entries by file, host and format; NULL host and format = lines without an entry.

    One hash aggregate; shows which formats a file or a host really writes, so ``formats=`` can be cut to them.
    """
    made = F.col("timestamp").isNotNull()
    return classified.groupBy("file_path", F.when(made & (F.col("host") != ""), F.col("host")).alias("host"),
                              F.when(made, F.col("format")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


def format_counts(classified: DataFrame) -> DataFrame:
    """(format, n): entries per format that produced them; NULL format = lines without an entry."""
    fmt = F.when(F.col("timestamp").isNotNull(), F.col("format"))
    return classified.groupBy(fmt.alias("format")).agg(F.count(F.lit(1)).alias("n"))
