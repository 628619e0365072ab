"""Named analyses over the driver tables (the ``queries()`` of the entry module).

Every query renders the whole ``events`` table through the lens, parses it
and runs one operator. Dates and timestamps leave as ISO text so that results
compare exactly with the DuckDB oracle (``duck_oracle``).
"""

from __future__ import annotations

import uuid
from datetime import datetime
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logarbor.operators import clusters, quality, search, summary, tree
from logarbor.operators.accumulators import BusiestMinute, accumulator_plugin
from logarbor.operators.export_frames import csv_frame
from logarbor.operators.parse import classify, parse, to_entries
from logarbor.functions.errors import severity
from logarbor.options import AnalyzerOptions
from logarbor.plans.analyzer import LogAnalyzer
from logarbor.session import checkpoint_dir
from logarbor.sources.lens import documents_lens, lens, mixed_lens

# Fixed values of the checks: the lens instant and window.
AS_OF = datetime(2024, 1, 31, 0, 0, 0)
CHECK_OPTS = AnalyzerOptions(as_of=AS_OF, max_days=45)
LISTED = 25  # error patterns a day that the landed checks keep
SHIFT_YEAR_END = 15  # days: moves the lens across Dec 2023 -> Jan 2024


def as_text_times(df: DataFrame) -> DataFrame:
    """DATE -> 'yyyy-MM-dd', TIMESTAMP -> 'yyyy-MM-dd HH:mm:ss.SSSSSS' (exact, engine-neutral)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _lines(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    return lens(spark, sf_dir, shift, partitions=spark.sparkContext.defaultParallelism)


def _entries(spark: SparkSession, sf_dir: str, opts: AnalyzerOptions = CHECK_OPTS, shift: int = 0) -> DataFrame:
    return parse(_lines(spark, sf_dir, shift), opts)


def _seq_ts(df: DataFrame) -> DataFrame:
    return as_text_times(df.select("line_seq", "timestamp"))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ---- parsing -------------------------------------------------------------

@query("entries")
def q_entries(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return as_text_times(e.drop("file_path", "block_start"))


@query("entries_iso")
def q_entries_iso(spark, sf_dir):
    e = _entries(spark, sf_dir).filter(F.col("format") == "iso8601")
    return as_text_times(e.select("line_seq", "timestamp", "host", "service", "pid", "message"))


@query("entries_levels")
def q_entries_levels(spark, sf_dir):
    e = _entries(spark, sf_dir).filter(F.col("level").isNotNull())
    return e.select("line_seq", "format", "level", "message")


@query("format_counts")
def q_format_counts(spark, sf_dir):
    return quality.format_counts(classify(_lines(spark, sf_dir), CHECK_OPTS))


@query("parse_quality")
def q_parse_quality(spark, sf_dir):
    return quality.parse_quality(classify(_lines(spark, sf_dir), CHECK_OPTS))


@query("year_rollback")
def q_year_rollback(spark, sf_dir):
    return _seq_ts(_entries(spark, sf_dir, CHECK_OPTS, SHIFT_YEAR_END))


@query("year_transition")
def q_year_transition(spark, sf_dir):
    opts = CHECK_OPTS.replace(year_mode="transition", base_year=2023)
    return _seq_ts(_entries(spark, sf_dir, opts, SHIFT_YEAR_END))


@query("year_sequential")
def q_year_sequential(spark, sf_dir):
    opts = CHECK_OPTS.replace(year_mode="sequential", base_year=2023)
    return _seq_ts(_entries(spark, sf_dir, opts, SHIFT_YEAR_END))


@query("day_window")
def q_day_window(spark, sf_dir):
    return _seq_ts(_entries(spark, sf_dir, CHECK_OPTS.replace(max_days=7)))


def _mixed(spark: SparkSession, sf_dir: str, opts: AnalyzerOptions = CHECK_OPTS) -> DataFrame:
    return classify(mixed_lens(spark, sf_dir, partitions=spark.sparkContext.defaultParallelism), opts)


def _mixed_entries(spark, sf_dir, fmt: str, opts: AnalyzerOptions = CHECK_OPTS) -> DataFrame:
    e = to_entries(_mixed(spark, sf_dir, opts), opts).filter(F.col("format") == fmt)
    return as_text_times(e.select("line_seq", "timestamp", "host", "service", "pid", "level", "message", "raw_line"))


@query("entries_journald")
def q_entries_journald(spark, sf_dir):
    return _mixed_entries(spark, sf_dir, "journald")


@query("entries_rainerscript")
def q_entries_rainerscript(spark, sf_dir):
    return _mixed_entries(spark, sf_dir, "rainerscript_enhanced")


@query("entries_offsets")
def q_entries_offsets(spark, sf_dir):
    return _mixed_entries(spark, sf_dir, "iso8601")


@query("entries_simple")
def q_entries_simple(spark, sf_dir):
    return _mixed_entries(spark, sf_dir, "traditional_simple", CHECK_OPTS.replace(formats=("traditional_simple",)))


@query("format_counts_mixed")
def q_format_counts_mixed(spark, sf_dir):
    return quality.format_counts(_mixed(spark, sf_dir))


@query("offsets_dropped")
def q_offsets_dropped(spark, sf_dir):
    return quality.format_counts(_mixed(spark, sf_dir, CHECK_OPTS.replace(offsets="drop")))


# ---- predicates and searches ----------------------------------------------

@query("errors_word")
def q_errors_word(spark, sf_dir):
    return _entries(spark, sf_dir).select("line_seq", "is_error")


@query("errors_substring")
def q_errors_substring(spark, sf_dir):
    return _entries(spark, sf_dir, CHECK_OPTS.replace(error_mode="substring")).select("line_seq", "is_error")


def _hits(df: DataFrame) -> DataFrame:
    return as_text_times(df.select("line_seq", "timestamp", "service", "level", "message"))


@query("find_errors")
def q_find_errors(spark, sf_dir):
    return _hits(search.find_errors(_entries(spark, sf_dir)))


@query("find_errors_service")
def q_find_errors_service(spark, sf_dir):
    return _hits(search.find_errors(_entries(spark, sf_dir), service="kernel"))


@query("filter_service")
def q_filter_service(spark, sf_dir):
    return _hits(search.filter_logs(_entries(spark, sf_dir), service_pattern=r"web\.|^auth"))


@query("filter_level")
def q_filter_level(spark, sf_dir):
    return _hits(search.filter_logs(_entries(spark, sf_dir), level="ERROR"))


@query("filter_message")
def q_filter_message(spark, sf_dir):
    return _hits(search.filter_logs(_entries(spark, sf_dir), message_contains="FAIL"))


@query("filter_combined")
def q_filter_combined(spark, sf_dir):
    return _hits(search.filter_logs(_entries(spark, sf_dir), service_pattern="n", level="WARN",
                                    message_contains="user 1"))


@query("tail_errors")
def q_tail_errors(spark, sf_dir):
    return search.error_hits(_entries(spark, sf_dir), k=10).select("line_seq", "text")


@query("tail_matches")
def q_tail_matches(spark, sf_dir):
    matches = search.matching(_entries(spark, sf_dir), message_contains="click")
    return search.match_hits(matches, k=20).select("line_seq", "text")


@query("severity")
def q_severity(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return e.select("line_seq", severity(F.col("level"), F.col("message")).alias("severity"))


# ---- aggregations -----------------------------------------------------------

@query("summary")
def q_summary(spark, sf_dir):
    return as_text_times(summary.summary(_entries(spark, sf_dir)))


@query("summary_lines")
def q_summary_lines(spark, sf_dir):
    return summary.summary_lines(_entries(spark, sf_dir))


@query("ranked_distributions")
def q_ranked_distributions(spark, sf_dir):
    return summary.ranked_distributions(_entries(spark, sf_dir))


@query("unique_services")
def q_unique_services(spark, sf_dir):
    return summary.unique_services(_entries(spark, sf_dir))


@query("date_range")
def q_date_range(spark, sf_dir):
    return as_text_times(summary.date_range(_entries(spark, sf_dir)))


@query("level_distribution")
def q_level_distribution(spark, sf_dir):
    return summary.level_distribution(_entries(spark, sf_dir))


@query("hourly_distribution")
def q_hourly_distribution(spark, sf_dir):
    return summary.hourly_distribution(_entries(spark, sf_dir))


@query("service_counts")
def q_service_counts(spark, sf_dir):
    return summary.service_counts(_entries(spark, sf_dir))


@query("top_services")
def q_top_services(spark, sf_dir):
    return summary.top_k(summary.service_counts(_entries(spark, sf_dir)), 5)


# ---- tree report --------------------------------------------------------------

@query("tree_nodes")
def q_tree_nodes(spark, sf_dir):
    return as_text_times(tree.tree_nodes(_entries(spark, sf_dir), CHECK_OPTS.max_lines_per_service))


@query("tree_first_n")
def q_tree_first_n(spark, sf_dir):
    shown = tree.first_n(_entries(spark, sf_dir), CHECK_OPTS.max_lines_per_service)
    return as_text_times(shown.select("log_date", "service", F.col("rn").cast("bigint").alias("rn"), "line_seq"))


@query("tree_overflow")
def q_tree_overflow(spark, sf_dir):
    nodes = tree.tree_nodes(_entries(spark, sf_dir), CHECK_OPTS.max_lines_per_service)
    return as_text_times(nodes.filter(F.col("overflow") > 0)
                         .select("log_date", "service", "overflow", "overflow_errors"))


@query("tree_rows")
def q_tree_rows(spark, sf_dir):
    return as_text_times(tree.tree_rows(_entries(spark, sf_dir), CHECK_OPTS))


@query("tree_rows_truncated")
def q_tree_rows_truncated(spark, sf_dir):
    opts = CHECK_OPTS.replace(truncate_length=20)
    return as_text_times(tree.tree_rows(_entries(spark, sf_dir, opts), opts))


@query("tree_rows_full")
def q_tree_rows_full(spark, sf_dir):
    opts = CHECK_OPTS.replace(show_full_lines=True)
    return as_text_times(tree.tree_rows(_entries(spark, sf_dir, opts), opts))


@query("tree_rows_wrapped")
def q_tree_rows_wrapped(spark, sf_dir):
    opts = CHECK_OPTS.replace(wrap_lines=True, truncate_length=10)
    return as_text_times(tree.tree_rows(_entries(spark, sf_dir, opts), opts))


# ---- clusters and exports ---------------------------------------------------------

@query("error_clusters")
def q_error_clusters(spark, sf_dir):
    return clusters.error_clusters(_entries(spark, sf_dir), 10)


@query("error_clusters_by_service")
def q_error_clusters_by_service(spark, sf_dir):
    return clusters.error_clusters_by_service(_entries(spark, sf_dir))


@query("csv_frame")
def q_csv_frame(spark, sf_dir):
    return csv_frame(_entries(spark, sf_dir))


# ---- landed once, then reported ----------------------------------------------------

def _landed(spark: SparkSession, sf_dir: str, patterns: int | None = None) -> LogAnalyzer:
    """The lens landed in two batches (odd and even lines), as a log that grows."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    lines = _lines(spark, sf_dir)
    for k, mode in enumerate(("overwrite", "append")):
        LogAnalyzer(lines.filter(F.col("line_seq") % 2 == k), CHECK_OPTS).land(path, mode, f"part{k}", patterns)
    return LogAnalyzer.from_landed(spark, path, CHECK_OPTS)


@query("landed_tree_rows")
def q_landed_tree_rows(spark, sf_dir):
    a = _landed(spark, sf_dir)
    return as_text_times(tree.tree_rows(a.entries, a.options, a.nodes))


@query("landed_tree_overflow")
def q_landed_tree_overflow(spark, sf_dir):
    a = _landed(spark, sf_dir)
    return as_text_times(a.tree_nodes().filter(F.col("overflow") > 0)
                         .select("log_date", "service", "overflow", "overflow_errors"))


@query("landed_summary")
def q_landed_summary(spark, sf_dir):
    return as_text_times(_landed(spark, sf_dir).summary())


@query("landed_parse_quality")
def q_landed_parse_quality(spark, sf_dir):
    return _landed(spark, sf_dir).parse_quality()


@query("landed_format_counts")
def q_landed_format_counts(spark, sf_dir):
    return _landed(spark, sf_dir).format_counts()


@query("landed_distinct")
def q_landed_distinct(spark, sf_dir):
    """Exact distinct counts of landed entries, and whether the day sketches' union comes within 3 % of them."""
    a = _landed(spark, sf_dir, patterns=LISTED)
    e = a.entries
    counts = e.agg(F.count_distinct("service").alias("services"), F.count_distinct("host").alias("hosts"),
                   F.count_distinct("message").alias("messages"),
                   F.count_distinct(F.when(F.col("is_error"), clusters.error_pattern(F.col("message"))))
                   .alias("error_patterns"))
    exact = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("n"))
                                              for c in counts.columns))).alias("row")).select("row.*")
    return (exact.join(a.distinct_estimates(), "what")
            .select("what", "n", (F.abs(F.col("estimate") - F.col("n")) <= 0.03 * F.col("n")).alias("near")))


@query("landed_top_patterns")
def q_landed_top_patterns(spark, sf_dir):
    return _landed(spark, sf_dir, patterns=LISTED).top_patterns(10)


@query("landed_error_clusters")
def q_landed_error_clusters(spark, sf_dir):
    return _landed(spark, sf_dir).error_clusters(10)


@query("format_profile")
def q_format_profile(spark, sf_dir):
    return quality.format_profile(classify(_lines(spark, sf_dir), CHECK_OPTS))


@query("format_profile_mixed")
def q_format_profile_mixed(spark, sf_dir):
    return quality.format_profile(_mixed(spark, sf_dir))


# ---- plugins that see the entries one by one -----------------------------------------

@query("plugin_busiest_minute")
def q_plugin_busiest_minute(spark, sf_dir):
    a = LogAnalyzer(_lines(spark, sf_dir), CHECK_OPTS,
                    plugins={"Activity": accumulator_plugin({"busiest_minute": BusiestMinute()})})
    return as_text_times(a.plugin_results()["Activity"]["busiest_minute"])


# ---- long texts: the documents lens ------------------------------------------------------

def _doc_entries(spark: SparkSession, sf_dir: str, opts: AnalyzerOptions = CHECK_OPTS) -> DataFrame:
    return parse(documents_lens(spark, sf_dir, partitions=spark.sparkContext.defaultParallelism), opts)


@query("doc_entries")
def q_doc_entries(spark, sf_dir):
    e = _doc_entries(spark, sf_dir)
    return as_text_times(e.select("line_seq", "timestamp", "service", "pid", "is_error",
                                  F.length("message").cast("bigint").alias("msg_chars"), "message"))


@query("doc_tree_rows")
def q_doc_tree_rows(spark, sf_dir):
    return as_text_times(tree.tree_rows(_doc_entries(spark, sf_dir), CHECK_OPTS))


@query("doc_tree_rows_wrapped")
def q_doc_tree_rows_wrapped(spark, sf_dir):
    opts = CHECK_OPTS.replace(wrap_lines=True)
    return as_text_times(tree.tree_rows(_doc_entries(spark, sf_dir, opts), opts))


@query("doc_error_clusters_by_service")
def q_doc_error_clusters_by_service(spark, sf_dir):
    return clusters.error_clusters_by_service(_doc_entries(spark, sf_dir))
