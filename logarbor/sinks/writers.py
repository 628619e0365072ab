"""Sinks: CSV export, JSON report, columnar landing of entries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logarbor.operators.export_frames import csv_frame
from logarbor.functions.timestamps import ntz_literal, window_bounds
from logarbor.options import AnalyzerOptions
from logarbor.sinks.tables import kept_table


# Same text from batch and stream: nothing trimmed, quotes doubled, empty fields empty.
CSV_OPTIONS = {"header": "true", "emptyValue": "", "nullValue": "", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(entries: DataFrame, path: str, mode: str = "overwrite", ordered: bool = True) -> None:
    """Header Timestamp,Service,Level,Host,PID,Message; NULLs as ''; rows in file order.

    ``ordered``: a global (range-partitioned) sort makes the part files follow each
    other in file order. That is the one full shuffle of the export; pass False when
    the order does not matter.
    """
    frame = csv_frame(entries, keep_order_columns=True)
    if ordered:  # kept first, so that the sort's sampling pass does not parse the log a second time
        frame = kept_table(frame, "csv").orderBy("file_path", "block_start", "line_seq")
    frame.drop("file_path", "block_start", "line_seq").write.mode(mode).options(**CSV_OPTIONS).csv(path)


def land_entries(entries: DataFrame, path: str, mode: str = "overwrite", max_records_per_file: int = 5_000_000,
                 batch: str | None = None) -> None:
    """Parquet partitioned by log_date: later day windows prune whole partitions.

    With ``batch`` the days lie in a folder of that name; append then replaces that folder alone.

    The rebalance hint brings a day's rows together, adaptive execution merges small days
    and splits large ones, so a hot day is many tasks and a quiet one is one file. Each
    task sorts its rows, so row groups carry tight service min/max statistics.
    """
    rows = entries.hint("rebalance", F.col("log_date")).sortWithinPartitions("log_date", "service", "timestamp")
    keys = ["log_date"]
    if batch is not None and mode == "append":
        path, mode = f"{path}/batch={batch}", "overwrite"
    elif batch is not None:
        rows, keys = rows.withColumn("batch", F.lit(batch)), ["batch", "log_date"]
    rows.write.mode(mode).option("maxRecordsPerFile", max_records_per_file).partitionBy(*keys).parquet(path)


def read_landed(spark: SparkSession, path: str, opts: AnalyzerOptions | None = None) -> DataFrame:
    """Landed entries, restricted to the day window of ``opts`` (partition pruning on log_date)."""
    df = spark.read.parquet(path).drop("batch")
    if opts is not None:
        lo, hi = window_bounds(opts.as_of, opts.max_days)
        df = df.filter((F.col("log_date") >= F.lit(lo.date())) & (F.col("log_date") <= F.lit(hi.date())))
        df = df.filter((F.col("timestamp") >= ntz_literal(lo)) & (F.col("timestamp") <= ntz_literal(hi)))
    return df


def write_json_report(report: DataFrame, tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """``report``: one bounded document; ``tables``: folder -> rows that grow with the log, written
    in parallel beside it as JSON lines."""
    report.coalesce(1).write.mode(mode).json(f"{path}/report")
    for folder, rows in tables.items():
        rows.write.mode(mode).json(f"{path}/{folder}")


def exported_at() -> str:
    return datetime.now().isoformat()
