"""A landed log: entries by batch and day, and beside them what the landing pass counted.

    path/batch=<b>/log_date=<d>/*.parquet   entries
    path/_totals/batch=<b>/                 cells (day, hour, service, level) with entries and errors
    path/_quality/batch=<b>/                lines by the format that made an entry of them (NULL: none did)
    path/_sketches/batch=<b>/               on request: sketches of distinct counts by day
    path/_patterns/batch=<b>/               on request: frequent error patterns by day, with what was left out

Every batch (one ``land_log``, one micro-batch of a stream) has folders of its own, so a rerun of
a failed batch overwrites what it left, and totals grow by a batch's cells. They are added up on
read: reports that need totals scan the cells, not the entries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logarbor.functions.timestamps import window_bounds
from logarbor.operators import quality, sketches, summary
from logarbor.operators.parse import classify, to_entries
from logarbor.operators.years import YearScan
from logarbor.options import AnalyzerOptions
from logarbor.sinks.writers import land_entries, read_landed


def land_log(lines: DataFrame, opts: AnalyzerOptions, path: str, mode: str = "overwrite", batch: str | None = None,
             scan: YearScan | None = None, patterns: int | None = None) -> str:
    """Parses ``lines`` once and lands them; returns the batch's name.

    ``mode``: overwrite replaces all that is there, append adds the batch (and replaces it, if it is there).
    ``scan``: as for ``classify``. ``patterns``: keep day summaries (``operators.sketches``) with so many error
    patterns a day; they read the landed batch once more for each of the two.
    """
    spark = lines.sparkSession
    batch = batch or uuid.uuid4().hex
    seen = Observation(f"landing-{batch}")
    made = F.col("timestamp").isNotNull()
    classified = classify(lines, opts, scan)
    observed = classified.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(made).alias("entries"), *(
        F.count_if(made & (F.col("format") == name)).alias(name) for name in opts.formats))
    land_entries(to_entries(observed, opts), path, mode, batch=batch)
    entries = to_entries(classified, opts)
    try:
        landed = spark.read.parquet(f"{path}/batch={batch}").select(*entries.columns)
        counted = seen.get
    except AnalysisException:  # no entry, no day, no file; Spark drops the counts of an empty plan
        landed, counted = entries.filter(F.lit(False)), None
    cells = summary.cell_counts(landed)
    cells.write.mode("overwrite").parquet(f"{path}/_totals/batch={batch}")
    n = spark.read.schema(cells.schema).parquet(f"{path}/_totals/batch={batch}").agg(F.sum("n")).first()[0] or 0
    if counted and n == counted["entries"]:
        rows = [(name, counted[name]) for name in opts.formats] + [(None, counted["lines"] - counted["entries"])]
        formats = spark.createDataFrame([r for r in rows if r[1]], "format string, n bigint")
    else:  # no entries, or a lost task was run again and counted twice: count the log once more
        formats = quality.format_counts(classified)
    formats.coalesce(1).write.mode("overwrite").parquet(f"{path}/_quality/batch={batch}")
    if patterns is not None:
        sketches.day_sketches(landed).write.mode("overwrite").parquet(f"{path}/_sketches/batch={batch}")
        frequent = sketches.frequent_patterns(landed, patterns)
        frequent.write.mode("overwrite").parquet(f"{path}/_patterns/batch={batch}")
    return batch


def _beside(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{name}").drop("batch")
    except AnalysisException:  # landed as entries alone
        return None


def _uncounted(spark: SparkSession, path: str, name: str) -> list[str]:
    """Names of batches that were landed without ``name``; an empty table is a file as well."""
    def batches(folder: str) -> set[str]:
        files = spark.read.parquet(f"{path}/{folder}").inputFiles()
        return {part.removeprefix("batch=") for f in files for part in f.split("/")[-2:-1]}

    return sorted(batches("_quality") - batches(name))


def landed_formats(spark: SparkSession, path: str) -> DataFrame | None:
    """(format, n) over all batches, as ``quality.format_counts`` of the landed lines; None if it was not kept."""
    kept = _beside(spark, path, "_quality")
    return None if kept is None else kept.groupBy("format").agg(F.sum("n").alias("n"))


def landed_cells(spark: SparkSession, path: str, opts: AnalyzerOptions) -> DataFrame | None:
    """Cells of the day window, a row or more each (to be added up); None if they were not kept.

    Days that lie whole in the window come from the totals. The window's first and last day may be cut by its
    instant; those two are counted from their entries.
    """
    kept = _beside(spark, path, "_totals")
    return None if kept is None else _in_window(spark, path, opts, kept, summary.cell_counts)


def landed_summaries(spark: SparkSession, path: str, opts: AnalyzerOptions, name: str,
                     of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pieces of ``name`` in the day window, from what every batch kept; ``of`` makes them from entries."""
    kept = _beside(spark, path, name)
    missing = ["all"] if kept is None else _uncounted(spark, path, name)
    if missing:
        raise ValueError(f"landed without day summaries (land(patterns=...)): batch {', '.join(missing)}")
    return _in_window(spark, path, opts, kept, of)


def _in_window(spark: SparkSession, path: str, opts: AnalyzerOptions, kept: DataFrame,
               of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``kept`` for the days that lie whole in the window; the days it cuts are counted by ``of`` anew."""
    lo, hi = window_bounds(opts.as_of, opts.max_days)
    first = F.col("log_date") > F.lit(lo.date()) if lo.time() > time() else F.col("log_date") >= F.lit(lo.date())
    whole = kept.filter(first & (F.col("log_date") < F.lit(hi.date())))
    cut = [hi.date()] + ([lo.date()] if lo.time() > time() else [])
    edges = read_landed(spark, path, opts).filter(F.col("log_date").isin(cut))
    return whole.unionByName(of(edges))
