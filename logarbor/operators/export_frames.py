"""Row frames of the exports: the CSV frame and search-free entry views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_HEADER = ("Timestamp", "Service", "Level", "Host", "PID", "Message")


def iso_text(ts: Column) -> Column:
    """datetime.isoformat(): 'YYYY-MM-DDTHH:MM:SS' plus '.ffffff' only when the fraction is non-zero."""
    frac = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")))


def csv_frame(entries: DataFrame, keep_order_columns: bool = False) -> DataFrame:
    """Six text columns; NULL level/host/pid become ''. File order via file_path, block_start, line_seq."""
    cols = [
        iso_text(F.col("timestamp")).alias("Timestamp"),
        F.col("service").alias("Service"),
        F.coalesce("level", F.lit("")).alias("Level"),
        F.coalesce("host", F.lit("")).alias("Host"),
        F.coalesce("pid", F.lit("")).alias("PID"),
        F.col("message").alias("Message"),
    ]
    if keep_order_columns:
        cols += [F.col("file_path"), F.col("block_start"), F.col("line_seq")]
    return entries.select(*cols)
