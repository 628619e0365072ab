"""Order-dependent operators at scale: a two-level scheme over chunks.

A file is a sequence of lines ordered by (block_start, line_seq). It is cut into
chunks of contiguous lines: one per (file_path, block_start, line_seq div
CHUNK_ROWS). Row-level windows run per chunk (bounded partitions, parallel
even for one huge file or one unsplittable archive); only the few rows at chunk
edges are ordered per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 20
CHUNK_KEY = ("file_path", "block_start", "chunk")


def with_chunk(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col("line_seq") / F.lit(chunk_rows)).cast("bigint"))


def chunk_window() -> Window:
    return Window.partitionBy(*CHUNK_KEY).orderBy("line_seq")
