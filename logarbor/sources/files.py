"""Log files -> ``lines`` (value, file_path, block_start, line_seq).

plain, .gz, .bz2   ``spark.read.text``: Hadoop codecs by suffix; plain and bzip2
                   split into blocks, gzip is one task per file. Lines end at
                   \\n, \\r\\n or \\r.
.xz                no Hadoop codec: ``binaryFile`` + ``mapInArrow`` with the
                   stdlib ``lzma`` stream decoder, one task per file, emitted in
                   Arrow batches (the decompressed text is never held whole).

Line order is (file_path, block_start, line_seq): ``line_seq`` is a
``monotonically_increasing_id`` taken right at the scan, which is consecutive
inside one file block, so it orders lines within the block.
Bad UTF-8: ``decode='replace'`` gives U+FFFD, ``decode='ignore'`` drops the bad
bytes (and, by construction, also genuine U+FFFD characters).
"""

from __future__ import annotations

from typing import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_SCHEMA = "value string, file_path string, block_start bigint, line_seq bigint"
XZ_BATCH_LINES = 8192
# File names that do not end in .xz (Hadoop globs have no plain negation).
NOT_XZ = "{*[!z],*[!x]z,*[!.]xz,z,xz}"


def list_files(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """(path, modificationTime, length) of the files under ``paths``; content is not read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
            .select("path", "modificationTime", "length"))


def decoded(value, decode: str):
    fixed = F.make_valid_utf8(value)
    return F.replace(fixed, F.lit("\ufffd"), F.lit("")) if decode == "ignore" else fixed


def read_text_lines(spark: SparkSession, paths: list[str], decode: str = "replace") -> DataFrame:
    """Plain / gzip / bzip2 files under ``paths`` (one scan); a damaged or missing file fails the job."""
    df = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", NOT_XZ)
          .option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").text(paths))
    return df.select(decoded(F.col("value"), decode).alias("value"), F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_block_start").cast("bigint").alias("block_start"),
                     F.monotonically_increasing_id().alias("line_seq"))


def _xz_batches(decode: str):
    errors = "ignore" if decode == "ignore" else "replace"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import lzma

        def flush(values, path, start):
            return pa.RecordBatch.from_pydict({
                "value": values, "file_path": [path] * len(values), "block_start": [0] * len(values),
                "line_seq": list(range(start, start + len(values)))},
                schema=pa.schema([("value", pa.string()), ("file_path", pa.string()),
                                  ("block_start", pa.int64()), ("line_seq", pa.int64())]))

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                seq = 0
                values: list[str] = []
                with io.TextIOWrapper(lzma.open(io.BytesIO(content)), encoding="utf-8", errors=errors,
                                      newline=None) as fh:
                    for line in fh:  # a damaged or truncated archive raises
                        values.append(line[:-1] if line.endswith("\n") else line)
                        if len(values) >= XZ_BATCH_LINES:
                            yield flush(values, path, seq)
                            seq += len(values)
                            values = []
                if values:
                    yield flush(values, path, seq)
    return run


def read_xz_lines(spark: SparkSession, paths: list[str], decode: str = "replace") -> DataFrame:
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xz")
          .option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").load(paths))
    return df.select("path", "content").mapInArrow(_xz_batches(decode), LINES_SCHEMA)


def read_lines(spark: SparkSession, paths: str | Iterable[str], decode: str = "replace",
               partitions: int | None = None) -> DataFrame:
    """Lines of all files under ``paths`` (files, folders or globs), any supported codec.

    Two readers, each with a file name filter, so no path list passes the driver.
    Plain and bzip2 files split into blocks and lines are parsed where they are read,
    without a shuffle. gzip and xz archives are decoded by one task each; where few
    huge archives hold the log, ``partitions`` deals their lines out before parsing.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = read_text_lines(spark, paths, decode).unionByName(read_xz_lines(spark, paths, decode))
    return out.repartition(partitions, "file_path", "line_seq") if partitions else out
