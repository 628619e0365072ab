"""The date -> service -> entries tree report as rows.

first N entries per (log_date, service) node come from ``row_number() <= N``
(planned as WindowGroupLimit: a partial top-N per task before the shuffle, so a
hot node ships at most N rows per task). Node totals come from the hash
aggregate of ``summary.node_counts``, which is small; for the mark of a day's first
service it is partitioned by day once more.

Rows: (log_date, service, kind, rn, part, text, severity); kind in date / service /
entry / wrap / overflow. Sorting by (log_date, service NULLS FIRST, rn, part)
gives the printed report.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logarbor.functions.errors import severity
from logarbor.functions.text import truncate
from logarbor.operators.search import TIME_ORDER
from logarbor.operators.summary import node_counts
from logarbor.options import AnalyzerOptions

NODE = ("log_date", "service")
NODE_SALTS = 32
TREE_COLUMNS = ("log_date", "service", "kind", "rn", "part", "text", "severity")

# Tree connectors of the report.
BRANCH = "├── "
ENTRY_MID = "│   ├── "
ENTRY_LAST = "│   └── "
CONT_MID = "│      "
CONT_LAST = "       "
CONT_HEAD = "│   "


def node_window() -> Window:
    return Window.partitionBy(*NODE).orderBy(*TIME_ORDER)


def first_n(entries: DataFrame, n: int) -> DataFrame:
    """The first n entries of each node in time order, with ``rn`` 1..n.

    Every task offers n rows of a hot node. They meet first in ``NODE_SALTS`` parts of the
    node, so the task that ranks the node reads n rows a part, not n rows a task.
    """
    salt = F.pmod(F.xxhash64("file_path", "block_start", "line_seq"), F.lit(NODE_SALTS))
    part = Window.partitionBy(*NODE, "_salt").orderBy(*TIME_ORDER)
    some = entries.withColumn("_salt", salt).withColumn("rn", F.row_number().over(part)).filter(F.col("rn") <= n)
    return (some.drop("_salt", "rn").withColumn("rn", F.row_number().over(node_window()))
            .filter(F.col("rn") <= n))


def tree_nodes(entries: DataFrame, n: int, nodes: DataFrame | None = None) -> DataFrame:
    """(log_date, service, n, errors, overflow, overflow_errors)."""
    nodes = node_counts(entries) if nodes is None else nodes
    shown = first_n(entries, n).groupBy(*NODE).agg(F.count_if(F.col("is_error")).alias("_shown_err"))
    return nodes.join(shown, list(NODE)).select(
        *NODE, "n", "errors",
        F.greatest(F.col("n") - F.lit(n), F.lit(0)).cast("bigint").alias("overflow"),
        (F.col("errors") - F.col("_shown_err")).cast("bigint").alias("overflow_errors"),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _wrap(message: pd.Series, width: pd.Series) -> pd.Series:
    import textwrap
    return pd.Series([textwrap.wrap(m, width=int(w)) for m, w in zip(message, width)])


def _level_indicator() -> Column:
    return F.when(F.col("level").isNotNull(), F.concat(F.lit("["), F.col("level"), F.lit("] "))).otherwise(F.lit(""))


def _row(kind: str, rn: Column, part: Column, text: Column) -> Column:
    """``severity`` is set on the lines of an entry, as the report colours them."""
    shade = severity(F.col("level"), F.col("message")) if kind in ("entry", "wrap") else F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), rn.cast("bigint").alias("rn"), part.cast("bigint").alias("part"),
                    text.alias("text"), shade.alias("severity"))


@lru_cache(maxsize=None)
def _tree_columns(limit: int, mode: str, truncate_length: int) -> tuple[Column, Column, Column, tuple[Column, ...]]:
    """Column expressions of the tree report for one display setting (built once, reused)."""
    day = Window.partitionBy("log_date").orderBy("service")
    first_of_day = (F.row_number().over(day) == 1).alias("_first_of_day")
    shown_err = F.count_if(F.col("is_error")).over(Window.partitionBy(*NODE)).alias("_shown_err")

    n, rn = F.col("n"), F.col("rn")
    is_last = rn == F.least(n, F.lit(limit))
    prefix = F.when(is_last, F.lit(ENTRY_LAST)).otherwise(F.lit(ENTRY_MID))
    head = F.concat(prefix, F.lit("["), F.date_format("timestamp", "HH:mm:ss"), F.lit("] "), _level_indicator())
    zero = F.lit(0)
    if mode == "full":
        entry_rows = F.array(_row("entry", rn, zero, F.concat(head, F.col("message"))))
    elif mode == "wrap":
        # width = max(40, truncate - len(prefix) - len("HH:MM:SS") - len(level indicator) - 3)
        width = F.greatest(F.lit(40), F.lit(truncate_length - len(ENTRY_MID) - 8 - 3)
                           - F.length(_level_indicator()))
        cont = F.concat(F.lit(CONT_HEAD), F.when(is_last, F.lit(CONT_LAST)).otherwise(F.lit(CONT_MID)))
        entry_rows = F.transform(_wrap(F.col("message"), width), lambda line, i: F.when(
            i == 0, _row("entry", rn, i, F.concat(head, line))).otherwise(_row("wrap", rn, i, F.concat(cont, line))))
    else:
        entry_rows = F.array(_row("entry", rn, zero, F.concat(head, truncate(F.col("message"), truncate_length))))

    first = rn == 1
    errors, over_err = F.col("errors"), F.col("errors") - F.col("_shown_err")
    date_row = _row("date", zero, zero, F.date_format("log_date", "yyyy-MM-dd"))
    service_row = _row("service", zero, zero, F.concat(
        F.lit(BRANCH), F.col("service"),
        F.when(errors > 0, F.concat(F.lit(" [errors: "), errors.cast("string"), F.lit("]"))).otherwise(F.lit(""))))
    overflow_row = _row("overflow", F.lit(limit + 1), zero, F.concat(
        F.lit(ENTRY_LAST), F.lit("... ("), (n - F.lit(limit)).cast("string"), F.lit(" more logs"),
        F.when(over_err > 0, F.concat(F.lit(", "), over_err.cast("string"), F.lit(" errors"))).otherwise(F.lit("")),
        F.lit(")")))
    extra = F.array(F.when(first & F.col("_first_of_day"), date_row), F.when(first, service_row),
                    F.when(first & (n > limit), overflow_row))
    rows = F.explode(F.concat(F.filter(extra, lambda x: x.isNotNull()), entry_rows)).alias("r")
    final = (F.col("log_date"), F.when(F.col("r.kind") != "date", F.col("service")).alias("service"),
             F.col("r.kind"), F.col("r.rn"), F.col("r.part"), F.col("r.text"), F.col("r.severity"))
    return first_of_day, shown_err, rows, final


def tree_rows(entries: DataFrame, opts: AnalyzerOptions, nodes: DataFrame | None = None) -> DataFrame:
    """The rendered report (see module doc). Display mode from opts: full, wrap or truncate.

    One pass per side: node totals (hash aggregate, plus a small per-day window
    that marks the first service of each day) and the first N entries per node
    (WindowGroupLimit, plus window counts over those N rows). One join, then a
    single explode emits every row kind, so the entries are read once per side.
    """
    limit = opts.max_lines_per_service
    mode = "full" if opts.show_full_lines else "wrap" if opts.wrap_lines else "truncate"
    first_of_day, shown_err, rows, final = _tree_columns(limit, mode, opts.truncate_length)
    nodes = node_counts(entries) if nodes is None else nodes
    nodes = nodes.select("*", first_of_day)
    shown = first_n(entries, limit).select("*", shown_err)
    return shown.join(nodes, list(NODE)).select("log_date", "service", rows).select(*final)


def report_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.asc("log_date"), F.asc_nulls_first("service"), F.asc("rn"), F.asc("part"))
