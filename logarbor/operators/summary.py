"""Aggregations over entries: node counts, summary row, distributions, top services.

Each is one hash aggregation of the entries with map-side partial counts; a hot
service or day only grows one partial counter per task. Reports of several parts
derive all of them from one table of cells (day, hour, service, level).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logarbor.session import checkpoint_dir


def node_counts(entries: DataFrame) -> DataFrame:
    """(log_date, service, n, errors): entries and errors per tree node."""
    return entries.groupBy("log_date", "service").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_error")).alias("errors"),
    )


def cell_counts(entries: DataFrame) -> DataFrame:
    """(log_date, hour_bucket, service, level, n, errors), level upper-cased: all of the summary derives from it."""
    return entries.groupBy("log_date", "hour_bucket", "service", F.upper("level").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_error")).alias("errors"))


def materialised(cells: DataFrame) -> DataFrame:
    """The small cell table, computed once and kept in the checkpoint folder."""
    checkpoint_dir(cells.sparkSession)
    return cells.checkpoint()


def nodes_of(cells: DataFrame) -> DataFrame:
    return cells.groupBy("log_date", "service").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))


def levels_of(cells: DataFrame) -> DataFrame:
    return (cells.filter(F.col("level").isNotNull()).groupBy(F.col("level").alias("key"))
            .agg(F.sum("n").alias("n")))


def hours_of(cells: DataFrame) -> DataFrame:
    return cells.groupBy(F.col("hour_bucket").alias("key")).agg(F.sum("n").alias("n"))


def summary(entries: DataFrame, nodes: DataFrame | None = None, approx: bool = False) -> DataFrame:
    """One row: total_entries, unique_services, date_min, date_max, days_with_logs, error_count.

    ``approx=True`` counts services with a HyperLogLog sketch (approx_count_distinct):
    exact counting already runs on the small node table, so this only matters when
    a log has millions of distinct service names.
    """
    nodes = node_counts(entries) if nodes is None else nodes
    services = F.approx_count_distinct("service") if approx else F.count_distinct("service")
    return nodes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_entries"),
        services.alias("unique_services"),
        F.min("log_date").alias("date_min"),
        F.max("log_date").alias("date_max"),
        F.count_distinct("log_date").alias("days_with_logs"),
        F.coalesce(F.sum("errors"), F.lit(0)).cast("bigint").alias("error_count"),
    )


def service_counts(entries: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(key, n) per service."""
    if nodes is None:
        return entries.groupBy(F.col("service").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.groupBy(F.col("service").alias("key")).agg(F.sum("n").cast("bigint").alias("n"))


def level_distribution(entries: DataFrame) -> DataFrame:
    """(key, n) per upper-cased level; entries without level are skipped."""
    return (entries.filter(F.col("level").isNotNull())
            .groupBy(F.upper("level").alias("key")).agg(F.count(F.lit(1)).alias("n")))


def hourly_distribution(entries: DataFrame) -> DataFrame:
    """(key, n) per hour of day 'HH:00', across all days."""
    return entries.groupBy(F.col("hour_bucket").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def ordered(dist: DataFrame) -> DataFrame:
    """Full ordered distribution: count descending, key ascending on ties."""
    return dist.orderBy(F.desc("n"), F.asc("key"))


def ranked_distributions(entries: DataFrame) -> DataFrame:
    """(kind, rank, key, n): the full service, level and hour distributions in their order, from one cell table."""
    cells = materialised(cell_counts(entries))
    parts = (("service", service_counts(entries, nodes_of(cells))), ("level", levels_of(cells)),
             ("hour", hours_of(cells)))
    both = None
    for kind, dist in parts:
        part = dist.select(F.lit(kind).alias("kind"), "key", F.col("n").cast("bigint").alias("n"))
        both = part if both is None else both.unionByName(part)
    order = Window.partitionBy("kind").orderBy(F.desc("n"), F.asc("key"))
    return both.select("kind", F.row_number().over(order).cast("bigint").alias("rank"), "key", "n")


def top_k(dist: DataFrame, k: int = 5) -> DataFrame:
    """Top-k keys by count (ties: key ascending). A bounded TakeOrderedAndProject."""
    return ordered(dist).limit(k)


def unique_services(entries: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The distinct service set, one row per service."""
    return (entries if nodes is None else nodes).select("service").distinct()


def date_range(entries: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return (entries if nodes is None else nodes).agg(F.min("log_date").alias("date_min"), F.max("log_date").alias("date_max"),
                     F.count_distinct("log_date").alias("days_with_logs"))


def top_services_text(top: DataFrame) -> DataFrame:
    """Summary line 'svc (1,234), svc2 (99)' from a top-k frame (k rows, ordered)."""
    item = F.concat(F.col("key"), F.lit(" ("), F.format_number("n", 0), F.lit(")"))
    return top.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.negative("n").alias("o"), F.col("key"), item.alias("t")))),
        lambda s: s["t"]), ", ").alias("top_services"))


def summary_lines(entries: DataFrame, cells: DataFrame | None = None, k: int = 5) -> DataFrame:
    """The text summary report as ordered lines (line_no, text), counts with thousands separators.

    Summary:, totals, services, date range, days, errors, top-k services, and the level
    distribution (count descending, level ascending on ties) when any entry has a level.
    The entries are read once, into the cell table; the lines are a union of small aggregates of it.
    """
    cells = materialised(cell_counts(entries)) if cells is None else cells
    nodes = nodes_of(cells)
    num = lambda c: F.format_number(F.col(c), 0)
    line = lambda no, text: F.struct(F.lit(no).alias("line_no"), text.alias("text"))
    # The report's line labels.
    head = summary(entries, nodes).select(F.explode(F.array(
        line(0, F.lit("Summary:")),
        line(1, F.concat(F.lit("  Total entries: "), num("total_entries"))),
        line(2, F.concat(F.lit("  Unique services: "), F.col("unique_services").cast("string"))),
        line(3, F.concat(F.lit("  Date range: "), F.coalesce(F.col("date_min").cast("string"), F.lit("")),
                         F.lit(" to "), F.coalesce(F.col("date_max").cast("string"), F.lit("")))),
        line(4, F.concat(F.lit("  Days with logs: "), F.col("days_with_logs").cast("string"))),
        line(5, F.concat(F.lit("  Error count: "), num("error_count"))),
    )).alias("l")).select("l.*")
    top = top_services_text(top_k(service_counts(entries, nodes), k)).select(
        F.lit(6).alias("line_no"), F.concat(F.lit("  Top services: "), F.coalesce("top_services", F.lit(""))).alias("text"))
    levels = levels_of(cells)
    ranked = levels.select(
        (F.lit(7) + F.row_number().over(Window.orderBy(F.desc("n"), F.asc("key")))).alias("line_no"),
        F.concat(F.lit("    "), F.col("key"), F.lit(": "), num("n")).alias("text"))
    level_head = levels.agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > 0).select(
        F.lit(7).alias("line_no"), F.lit("  Level distribution:").alias("text"))
    return (head.unionByName(top).unionByName(level_head).unionByName(ranked)
            .select(F.col("line_no").cast("bigint").alias("line_no"), "text"))
