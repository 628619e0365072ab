"""Year inference for formats without a year (BSD syslog lines).

rollback    row-local: year of as_of, or the year before when that is in the future
transition  base year, +1 on the line right after a Dec -> Jan step, -1 after Jan -> Dec
sequential  running year: base year plus every Dec -> Jan (+1) and Jan -> Dec (-1) step so far

Steps are taken between consecutive BSD-matched lines of one file, including
lines whose date turns out impossible or falls outside the day window.

A segmented prefix scan in three levels, none of which shuffles the lines:

  lines     only (chunk, line_seq, month) of the BSD lines goes through the per-chunk window of
            ``sequence``; what remains are the lines where the year steps inside a chunk, and each
            chunk's first and last line (``year_marks``)
  chunks    one summary a chunk (first month, last month, sum of its steps) is scanned over the
            chunks of a file, which gives the change of year that each chunk begins with
  segments  inside chunks that step, runs of ``SEGMENT_LINES`` lines hold the change they begin
            with and their own few steps

Lines look the result up by equality on their chunk and their segment (transition: on the line
itself). The lookup table is written in one job, so the planner joins it by its size: broadcast
when small, else shuffled on the chunk or segment, so one huge file is many keys.

A log that arrives in parts goes on where its last part ended: ``before`` holds, by file, the last month
and the change of year so far (``year_state``), and the first chunk begins with them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logarbor.functions.formats import MONTHS
from logarbor.operators.sequence import CHUNK_KEY, CHUNK_ROWS
from logarbor.options import AnalyzerOptions
from logarbor.sinks.tables import kept_table

# Lines of a segment; a chunk is a whole number of segments.
SEGMENT_LINES = 1 << 10
SEGMENT_KEY = ("file_path", "block_start", "segment")
LINE_KEY = ("file_path", "block_start", "line_seq")
IS_BSD = "format IS NOT NULL AND route = 'bsd'"
MONTH_NUMBER = "cast(array_position(array(" + ", ".join(f"'{m}'" for m in MONTHS) + "), mon) AS int)"
IN_CHUNK = "PARTITION BY file_path, block_start, chunk ORDER BY"
IN_FILE = "PARTITION BY file_path ORDER BY block_start, chunk"
STATE_SCHEMA = "file_path string, last_m int, change int"


class YearScan(NamedTuple):
    """What the scan needs of the lines and of earlier parts: ``year_marks``, and the state they left (or None)."""

    marks: DataFrame
    before: DataFrame | None = None


def step(prev: str, cur: str) -> str:
    """+1 for Dec -> Jan, -1 for Jan -> Dec, else 0 (also when there is no previous month)."""
    return f"CASE WHEN {prev} = 12 AND {cur} = 1 THEN 1 WHEN {prev} = 1 AND {cur} = 12 THEN -1 ELSE 0 END"


def year_marks(months: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """From the lines without a year, (line key, mon): (chunk key, line_seq, m, delta, run): lines where the year
    steps inside a chunk, and its first and last.

    ``run`` is the sum of the chunk's inner steps up to the line.
    """
    lines = months.selectExpr(*LINE_KEY, f"line_seq div {chunk_rows} AS chunk", f"{MONTH_NUMBER} AS m")
    stepped = lines.selectExpr("*", f"lag(m) OVER ({IN_CHUNK} line_seq) AS prev", f"lead(m) OVER ({IN_CHUNK} line_seq) AS next")
    summed = stepped.selectExpr("*", f"{step('prev', 'm')} AS delta").selectExpr(
        "*", f"cast(sum(delta) OVER ({IN_CHUNK} line_seq) AS int) AS run")
    return summed.where("delta <> 0 OR prev IS NULL OR next IS NULL").select(*CHUNK_KEY, "line_seq", "m", "delta", "run")


def chunk_carries(marks: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(chunk key, first_seq, last_m, total, edge, carry): the step onto a chunk's first line, and all steps up to it."""
    chunks = marks.groupBy(*CHUNK_KEY).agg(F.expr("min(line_seq) AS first_seq"), F.expr("min_by(m, line_seq) AS first_m"),
                                           F.expr("max_by(m, line_seq) AS last_m"), F.expr("max_by(run, line_seq) AS total"))
    if before is None:
        chunks = chunks.selectExpr("*", "cast(NULL AS int) AS state_m", "0 AS state_change")
    else:  # one row a chunk meets one row a file
        state = before.selectExpr("file_path", "last_m AS state_m", "change AS state_change")
        chunks = chunks.join(state, "file_path", "left").fillna(0, ["state_change"])
    edges = chunks.selectExpr("*", f"coalesce(lag(last_m) OVER ({IN_FILE}), state_m) AS before_m").selectExpr(
        "*", f"{step('before_m', 'first_m')} AS edge")
    return edges.selectExpr(*CHUNK_KEY, "first_seq", "last_m", "total", "edge",
                            f"cast(state_change + sum(edge + total) OVER ({IN_FILE}) - total AS int) AS carry")


def year_state(scan: YearScan) -> DataFrame:
    """(file_path, last_m, change) after the lines of ``scan``; files without new lines keep what they had."""
    last = chunk_carries(*scan).groupBy("file_path").agg(
        F.expr("max_by(struct(last_m, carry + total AS change), struct(block_start, chunk)) AS s"))
    new = last.selectExpr("file_path", "s.last_m AS last_m", "s.change AS change")
    if scan.before is None:
        return new
    return new.unionByName(scan.before.join(new.select("file_path"), "file_path", "left_anti"))


def line_steps(marks: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(line key, delta): every line that a step leads to."""
    inner = marks.where("delta <> 0").select(*LINE_KEY, "delta")
    edges = chunk_carries(marks, before).where("edge <> 0")
    return inner.unionByName(edges.selectExpr("file_path", "block_start", "first_seq AS line_seq", "edge AS delta"))


def year_changes(marks: DataFrame, chunk_rows: int = CHUNK_ROWS, segment_lines: int = SEGMENT_LINES,
                 before: DataFrame | None = None) -> DataFrame:
    """Change of year by chunk and by segment, in one table of (file_path, block_start, chunk, segment, before, steps).

    A row without segment has a chunk's change at its first line (0: no row). From the first inner step of a chunk
    on, each segment has the change it begins with, relative to its chunk, and its own steps as (line_seq, run).
    """
    carries = chunk_carries(marks, before).where("carry <> 0").selectExpr(
        *CHUNK_KEY, "cast(NULL AS bigint) AS segment", "carry AS before", "cast(NULL AS array<struct<line_seq: bigint, run: int>>) AS steps")
    own = (marks.where("delta <> 0").withColumn("segment", F.expr(f"line_seq div {segment_lines}"))
           .groupBy(*CHUNK_KEY, "segment").agg(F.expr("array_sort(collect_list(struct(line_seq, run))) AS steps"),
                                               F.expr("min_by(run - delta, line_seq) AS before")))
    last = f"((chunk + 1) * {chunk_rows} - 1) div {segment_lines}"
    spans = own.selectExpr("*", f"coalesce(lead(segment) OVER ({IN_CHUNK} segment) - 1, {last}) AS until")
    # a segment without steps of its own begins and ends with the change of the last one that had some
    segments = spans.selectExpr("*", "explode(sequence(segment, until)) AS at").selectExpr(
        *CHUNK_KEY, "at AS segment", "if(at = segment, before, element_at(steps, -1).run) AS before",
        "if(at = segment, steps, NULL) AS steps")
    return carries.unionByName(segments)


def with_year_column(rows: DataFrame, opts: AnalyzerOptions, months: DataFrame | None = None,
                     chunk_rows: int = CHUNK_ROWS, segment_lines: int = SEGMENT_LINES,
                     scan: YearScan | None = None) -> DataFrame:
    """Adds ``year`` to matched lines (NULL for lines that are not BSD-matched).

    ``months``: (line key, mon) of the BSD-matched lines, if at hand in a cheaper way than from ``rows``.
    ``scan``: their marks (with the same ``chunk_rows``) and the state of earlier parts, in place of ``months``.
    """
    if opts.year_mode not in ("sequential", "transition"):
        raise ValueError(f"year mode {opts.year_mode!r} needs no window")
    if chunk_rows % segment_lines:
        raise ValueError("a chunk is a whole number of segments")
    marks, before = scan or (year_marks(rows.where(IS_BSD) if months is None else months, chunk_rows), None)
    columns = rows.columns
    if opts.year_mode == "transition":
        steps = kept_table(line_steps(marks, before), "year-steps")
        rows = rows.join(steps, list(LINE_KEY), "left")
        change = "coalesce(delta, 0)"
    else:
        changes = kept_table(year_changes(marks, chunk_rows, segment_lines, before), "year-changes")
        carry = changes.where("segment IS NULL").selectExpr(*CHUNK_KEY, "before AS carry")
        inside = changes.where("segment IS NOT NULL").select(*SEGMENT_KEY, "before", "steps")
        rows = rows.selectExpr("*", f"line_seq div {chunk_rows} AS chunk", f"line_seq div {segment_lines} AS segment")
        rows = rows.join(carry, list(CHUNK_KEY), "left").join(inside, list(SEGMENT_KEY), "left")
        # the last own step up to the line
        change = ("coalesce(carry, 0) + coalesce(try_element_at(filter(steps, s -> s.line_seq <= line_seq), -1).run, before, 0)")
    return rows.selectExpr(*columns, f"CASE WHEN {IS_BSD} THEN {opts.year} + {change} END AS year")
