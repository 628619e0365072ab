"""Error clusters: errors grouped by the first three words of their message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logarbor.functions.text import WS_CLASS, py_strip

CLUSTER_WORDS = 3


def error_pattern(message: Column) -> Column:
    """First three words joined by one blank plus '...' when there are more, else the whole message."""
    w = F.split(py_strip(message), "(?U)" + WS_CLASS + "+", CLUSTER_WORDS + 1)  # the rest of a long text stays whole
    return F.when(F.size(w) > CLUSTER_WORDS,
                  F.concat(F.array_join(F.slice(w, 1, CLUSTER_WORDS), " "), F.lit("..."))).otherwise(message)


def cluster_counts(entries: DataFrame) -> DataFrame:
    """(service, pattern, n) for error entries (partial aggregation absorbs hot patterns)."""
    return (entries.filter(F.col("is_error"))
            .groupBy("service", error_pattern(F.col("message")).alias("pattern"))
            .agg(F.count(F.lit(1)).alias("n")))


def error_clusters(entries: DataFrame, k: int | None = 10, by_service: DataFrame | None = None) -> DataFrame:
    """(pattern, n): the k most frequent patterns (ties: pattern ascending); all when k is None."""
    base = cluster_counts(entries) if by_service is None else by_service
    out = base.groupBy("pattern").agg(F.sum("n").cast("bigint").alias("n"))
    out = out.orderBy(F.desc("n"), F.asc("pattern"))
    return out.limit(k) if k is not None else out


def error_clusters_by_service(entries: DataFrame) -> DataFrame:
    return cluster_counts(entries)
