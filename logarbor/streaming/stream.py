"""Structured Streaming: log folders read as they grow.

    entries = stream_entries(spark, "/logs/incoming", opts)       # append stream of entries
    counts  = running_counts(entries, "service")                   # update-mode counters
    q = write_entries(entries, "/out/entries", checkpoint, "parquet")

The same column functions as the batch parse run per micro-batch. ``stream_entries``
takes the row-local ``rollback`` year. The file-order modes (``transition``,
``sequential``) run through ``write_entries_in_file_order``. The file source hands
each new file whole to one micro-batch, and year state is per file, so every
micro-batch runs the batch two-level algorithm (chunk windows) on its files. A log
delivered in parts over several micro-batches keeps its last month and year between them.
Rows that come after their day was closed are counted and kept by ``write_daily_counts``.
Event time for watermarks is ``event_time`` (TIMESTAMP, session zone UTC),
because watermarks refuse TIMESTAMP_NTZ. The day window spans ``max_days`` + 1 days
and a day's group ends a day after it began, so the lateness bound is ``max_days`` + 2
days: no entry inside the window is ever late.

Streams cannot number lines, so ``stream_entries`` has no ``line_seq``; entries whose file
order matters (tree, last-k) are written by ``write_entries_in_file_order``, whose
micro-batches number them. Bad UTF-8 follows ``opts.decode``. ``.xz`` files have no
streaming codec and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logarbor.operators.clusters import error_pattern
from logarbor.operators.parse import assign_timestamps, match_lines, month_lines, to_entries
from logarbor.operators.years import STATE_SCHEMA, YearScan, year_marks, year_state
from logarbor.options import AnalyzerOptions
from logarbor.sinks.tables import kept_table
from logarbor.sinks.writers import CSV_OPTIONS
from logarbor.sources.files import NOT_XZ, decoded


def _raw_lines(spark: SparkSession, folder: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.format("text").option("pathGlobFilter", NOT_XZ)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder).select("value", F.col("_metadata.file_path").alias("file_path"),
                                      F.col("_metadata.file_block_start").cast("bigint").alias("block_start"))


def stream_lines(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None,
                 decode: str = "replace") -> DataFrame:
    return _raw_lines(spark, folder, max_files_per_trigger).withColumn("value", decoded(F.col("value"), decode))


def lateness(opts: AnalyzerOptions) -> str:
    return f"{opts.max_days + 2} days"


def stream_entries(spark: SparkSession, folder: str, opts: AnalyzerOptions,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    if opts.year_mode != "rollback":
        raise ValueError("streams support year_mode='rollback' only")
    lines = stream_lines(spark, folder, max_files_per_trigger, opts.decode)
    lines = lines.withColumn("line_seq", F.lit(0).cast("bigint"))  # only for the parser's column list
    entries = to_entries(assign_timestamps(match_lines(lines, opts), opts), opts).drop("line_seq")
    return entries.withColumn("event_time", F.col("timestamp").cast("timestamp"))


def running_counts(entries: DataFrame, key: str) -> DataFrame:
    """(key, n) counters; key in service / level / hour_bucket / log_date."""
    col = F.upper("level") if key == "level" else F.col(key)
    src = entries.filter(F.col("level").isNotNull()) if key == "level" else entries
    return src.groupBy(col.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def running_errors(entries: DataFrame) -> DataFrame:
    return entries.groupBy().agg(F.count(F.lit(1)).alias("total_entries"),
                                 F.count_if("is_error").alias("error_count"))


def running_clusters(entries: DataFrame) -> DataFrame:
    return (entries.filter(F.col("is_error"))
            .groupBy("service", error_pattern(F.col("message")).alias("pattern"))
            .agg(F.count(F.lit(1)).alias("n")))


def daily_counts(entries: DataFrame, opts: AnalyzerOptions) -> DataFrame:
    """Per (day, service) counts with a watermark past the day window: finished days are emitted once (append)."""
    return (entries.withWatermark("event_time", lateness(opts))
            .groupBy(F.window("event_time", "1 day").alias("day"), "service")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("errors")))


def daily_clusters(entries: DataFrame, opts: AnalyzerOptions) -> DataFrame:
    """Error clusters per (day, service, pattern) with a watermark past the day window.

    State of a day is dropped once the watermark passes it, so the state stays
    bounded by the window even when messages keep producing new patterns
    (``running_clusters`` keeps every pattern forever).
    """
    return (entries.filter(F.col("is_error")).withWatermark("event_time", lateness(opts))
            .groupBy(F.window("event_time", "1 day").alias("day"), "service",
                     error_pattern(F.col("message")).alias("pattern"))
            .agg(F.count(F.lit(1)).alias("n")))


# A part of a log: everything before '.part', and the number behind it.
PARTS = r"^(.*)\.part-?([0-9]+)$"
PART_SPAN = 1 << 44  # bytes of the longest part


def _of_whole_logs(lines: DataFrame, parts: str) -> DataFrame:
    """Lines of parts, placed in their log; files that are no parts stay as they are."""
    number = F.regexp_extract("file_path", parts, 2)
    log = F.when(number != "", F.regexp_extract("file_path", parts, 1)).otherwise(F.col("file_path"))
    place = F.col("block_start") + F.when(number != "", number.cast("bigint") * PART_SPAN).otherwise(F.lit(0))
    return lines.select("value", log.alias("file_path"), place.cast("bigint").alias("block_start"), "line_seq")


def _state(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """What micro-batch ``batch_id - 1`` left (ids have no gaps); nothing before the first."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={batch_id - 1}")


CELL_SCHEMA = "log_date date, service string, late boolean, n bigint, errors bigint, newest timestamp_ntz"
MARK_SCHEMA = "newest timestamp_ntz"


def write_daily_counts(entries: DataFrame, path: str, checkpoint: str, delay_days: int = 1,
                       available_now: bool = True) -> StreamingQuery:
    """Counts by day and service of an entry stream, with every row that comes too late accounted for.

    A day is closed once the newest entry of earlier micro-batches is ``delay_days`` past its end. An entry of a
    closed day is late: it is counted apart, and kept whole in ``path/late``. Nothing is dropped, so counts and
    late counts together are those of a batch over the same entries, in whatever order the files came.

        path/cells/batch=<b>/   (log_date, service, late, n, errors, newest) of a micro-batch
        path/late/batch=<b>/    its late entries
        path/_mark/batch=<b>/   the newest entry so far

    A rerun micro-batch reads the mark that the one before it left and overwrites its own folders. No state is held
    between batches: counts grow by the days and services that a batch meets, and are added up on read.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _state(spark, f"{path}/_mark", MARK_SCHEMA, batch_id).agg(F.max("newest")).first()[0]
        rows = batch.drop("event_time").withColumn("late", _closed(F.lit(newest).cast("timestamp_ntz"), delay_days))
        (rows.groupBy("log_date", "service", "late")
         .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("errors"), F.max("timestamp").alias("newest"))
         .write.mode("overwrite").parquet(f"{path}/cells/batch={batch_id}"))
        cells = spark.read.schema(CELL_SCHEMA).parquet(f"{path}/cells/batch={batch_id}")
        seen, late = cells.agg(F.max("newest"), F.count_if("late")).first()
        if late:  # the batch is parsed again only for its late rows
            rows.filter("late").drop("late").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        mark = max((t for t in (newest, seen) if t is not None), default=None)
        (spark.createDataFrame([(mark,)], MARK_SCHEMA).coalesce(1)
         .write.mode("overwrite").parquet(f"{path}/_mark/batch={batch_id}"))

    w = entries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _closed(newest: Column, delay_days: int) -> Column:
    """Whether ``log_date`` ended ``delay_days`` before ``newest`` (no entry yet: no day has)."""
    return F.coalesce(F.date_add("log_date", 1 + delay_days).cast("timestamp_ntz") <= newest, F.lit(False))


def read_daily_counts(spark: SparkSession, path: str, delay_days: int = 1) -> DataFrame:
    """(log_date, service, n, errors, late_n, late_errors, closed): counts in time, late ones, and whether the
    day is closed by now."""
    cells = spark.read.schema(CELL_SCHEMA).parquet(f"{path}/cells")
    newest = cells.agg(F.max("newest")).first()[0]
    n, errors = F.col("n"), F.col("errors")
    zero = F.lit(0)
    return (cells.groupBy("log_date", "service").agg(
        F.sum(F.when(F.col("late"), zero).otherwise(n)).alias("n"),
        F.sum(F.when(F.col("late"), zero).otherwise(errors)).alias("errors"),
        F.sum(F.when(F.col("late"), n).otherwise(zero)).alias("late_n"),
        F.sum(F.when(F.col("late"), errors).otherwise(zero)).alias("late_errors"))
        .withColumn("closed", _closed(F.lit(newest).cast("timestamp_ntz"), delay_days)))


def write_entries_in_file_order(spark: SparkSession, folder: str, path: str, checkpoint: str,
                                opts: AnalyzerOptions, max_files_per_trigger: int | None = None,
                                available_now: bool = True, parts: str | None = None) -> StreamingQuery:
    """Entries of a growing folder with any year mode, appended as Parquet under ``path``.

    Each micro-batch numbers its lines at the scan (file order inside each block)
    and is landed with the options as given; the batch id makes reruns of a
    failed micro-batch overwrite their own output folders (idempotent). Inside a batch
    the folders are days, so ``read_landed`` prunes by day window. Totals and parse quality
    are kept by batch as for a landed log, so ``LogAnalyzer.from_landed`` answers for a stream too.

    ``parts``: a regular expression whose groups are a log and the number of a part of it (``PARTS``), for logs
    delivered in pieces. Entries then carry the log as ``file_path`` and part * ``PART_SPAN`` + offset as
    ``block_start``, and the file-order year modes go on from one micro-batch to the next: each leaves the last
    month and the change of year of every log, a row a log, in ``path/_years`` for the next one. Parts of one
    micro-batch are taken in the order of their numbers; a part that arrives after a later one counts as arrived.
    """
    from logarbor.sinks.landing import land_log

    stateful = parts is not None and opts.year_mode != "rollback"

    def run(batch: DataFrame, batch_id: int) -> None:
        lines = batch.select(decoded(F.col("value"), opts.decode).alias("value"), "file_path", "block_start",
                             F.monotonically_increasing_id().alias("line_seq"))
        scan = None
        if parts is not None:
            lines = _of_whole_logs(lines, parts)
        if stateful:
            # eagerly, as the state of this batch and the years of its lines both come from the marks
            marks = kept_table(year_marks(month_lines(lines, opts)), "year-marks")
            scan = YearScan(marks, _state(batch.sparkSession, f"{path}/_years", STATE_SCHEMA, batch_id))
        land_log(lines, opts, path, mode="append", batch=str(batch_id), scan=scan)
        if stateful:
            year_state(scan).write.mode("overwrite").parquet(f"{path}/_years/batch={batch_id}")

    w = (_raw_lines(spark, folder, max_files_per_trigger).writeStream.foreachBatch(run)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def write_entries(entries: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                  available_now: bool = True) -> StreamingQuery:
    """File sink (parquet or csv) with a checkpoint; exactly-once per micro-batch."""
    frame = entries.drop("event_time")
    if fmt == "csv":
        from logarbor.operators.export_frames import csv_frame
        frame = csv_frame(frame)
    w = frame.writeStream.format(fmt).option("checkpointLocation", checkpoint).option("path", path)
    if fmt == "csv":
        w = w.options(**CSV_OPTIONS)
    w = w.outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
