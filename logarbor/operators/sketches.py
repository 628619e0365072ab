"""Mergeable day summaries: distinct counts as HyperLogLog sketches, frequent error patterns with bounds.

A piece is what one landing batch holds of one day. Summaries of pieces are small and add up
over any set of pieces, so that a report over years reads them in place of the messages:

- ``day_sketches``: one row a piece, one sketch a column. Sketches of pieces unite into the
  sketch of their union, so a service seen on every day counts once.
- ``frequent_patterns``: the ``kept`` most frequent error patterns of a piece with their exact
  counts, and the greatest count that was left out (``cut``). A pattern that a piece does not
  list has at most ``cut`` entries there, so the sums over pieces bound its total on both sides.

A piece without errors has no pattern rows; its cut would be 0. Both are estimates beside the
exact reports (``summary``, ``clusters``), which stay what the analyzer answers by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logarbor.operators.clusters import error_pattern

LOG2_REGISTERS = 14  # a sketch has 2^14 registers: standard error 0.8 %, at most some 16 KB
KEPT_PATTERNS = 1000
RANK_PARTS = 32      # a piece's patterns are ranked in so many parts first


def _measured() -> dict[str, Column]:
    """What is counted; a NULL is not."""
    return {"services": F.col("service"), "hosts": F.col("host"), "messages": F.col("message"),
            "error_patterns": F.when(F.col("is_error"), error_pattern(F.col("message")))}


def day_sketches(entries: DataFrame) -> DataFrame:
    """(log_date, n, services, hosts, messages, error_patterns): entries and a sketch of each distinct count by day."""
    return entries.groupBy("log_date").agg(F.count(F.lit(1)).alias("n"), *(
        F.hll_sketch_agg(value, F.lit(LOG2_REGISTERS)).alias(what) for what, value in _measured().items()))


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """(what, estimate): distinct services, hosts, messages and error patterns over all pieces in ``sketches``."""
    names = list(_measured())
    united = sketches.agg(*(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in names))
    return united.select(F.explode(F.array(*(
        F.struct(F.lit(c).alias("what"), F.coalesce(F.col(c), F.lit(0)).alias("estimate")) for c in names)))
        .alias("row")).select("row.*")


def frequent_patterns(entries: DataFrame, kept: int = KEPT_PATTERNS) -> DataFrame:
    """(log_date, pattern, n, rank, cut): by day the ``kept`` most frequent error patterns (ties: pattern ascending).

    The rank is taken in parts of a day and then in the day, both cut at ``kept`` + 1 rows while
    they are sorted, so a day with very many patterns is spread over tasks.
    """
    counts = (entries.filter(F.col("is_error"))
              .groupBy("log_date", error_pattern(F.col("message")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("part", F.pmod(F.xxhash64("pattern"), F.lit(RANK_PARTS))))
    order = [F.desc("n"), F.asc("pattern")]
    in_part = Window.partitionBy("log_date", "part").orderBy(*order)
    in_day = Window.partitionBy("log_date").orderBy(*order)
    first = (counts.withColumn("rank", F.row_number().over(in_part)).filter(F.col("rank") <= kept + 1).drop("rank", "part")
             .withColumn("rank", F.row_number().over(in_day)).filter(F.col("rank") <= kept + 1))
    left_out = F.max(F.when(F.col("rank") == kept + 1, F.col("n"))).over(Window.partitionBy("log_date"))
    return (first.withColumn("cut", F.coalesce(left_out, F.lit(0))).filter(F.col("rank") <= kept)
            .select("log_date", "pattern", "n", "rank", "cut"))


def pattern_bounds(pieces: DataFrame) -> DataFrame:
    """(pattern, n, n_max): every listed pattern's entries over all pieces lie between ``n`` and ``n_max``."""
    listed = pieces.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("cut").alias("own"))
    return (listed.withColumn("one", F.lit(1)).join(_all_cuts(pieces), "one")  # one row: no pair is made twice
            .select("pattern", "n", (F.col("n") + F.col("cuts") - F.col("own")).alias("n_max")))


def _all_cuts(pieces: DataFrame) -> DataFrame:
    """One row (one, cuts): the most entries that a pattern listed by no piece can have."""
    first = pieces.filter(F.col("rank") == 1)
    return first.agg(F.coalesce(F.sum("cut"), F.lit(0)).alias("cuts")).withColumn("one", F.lit(1))


def top_patterns(pieces: DataFrame, k: int = 10) -> DataFrame:
    """(pattern, n, n_max, sure): the ``k`` patterns of largest ``n`` (ties: pattern ascending).

    ``sure``: no pattern outside these k can have more entries than this one has at least. Where
    it holds for all k, they are the patterns of the exact top k, up to ties.
    """
    bounds = pattern_bounds(pieces)
    top = bounds.orderBy(F.desc("n"), F.asc("pattern")).limit(k)
    # of the k + 1 largest upper bounds at least one belongs to a pattern outside the top
    high = bounds.orderBy(F.desc("n_max"), F.asc("pattern")).limit(k + 1)
    outside = (high.join(top.select("pattern"), "pattern", "left_anti")
               .agg(F.coalesce(F.max("n_max"), F.lit(0)).alias("others")).withColumn("one", F.lit(1)))
    return (top.withColumn("one", F.lit(1)).join(outside, "one").join(_all_cuts(pieces), "one")
            .select("pattern", "n", "n_max", (F.col("n") >= F.greatest("others", "cuts")).alias("sure")))
