"""Column functions for text: strip, truncate, word split, hit rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() treats as whitespace
# (what str.strip() and str.split() remove). Java's (?U)\s lacks only \x1c-\x1f.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java regex class (used with the (?U) flag).
WS_CLASS = r"[\s\x1c-\x1f]"
NON_WS_CLASS = r"[^\s\x1c-\x1f]"


def py_strip(col: Column | str) -> Column:
    """Both-side strip with Python's whitespace set; a JVM trim, no regex."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(PY_WHITESPACE))


def truncate(col: Column, length: int) -> Column:
    """Cut at ``length`` characters and add '...' only when the text was longer."""
    return F.when(F.length(col) > length, F.concat(F.substring(col, 1, length), F.lit("..."))).otherwise(col)


def words(col: Column) -> Column:
    """str.split(): runs of whitespace, no empty words at either end."""
    stripped = py_strip(col)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, "(?U)" + WS_CLASS + "+"))


def hit_line(ts: Column, service: Column, level: Column | None, message: Column, width: int) -> Column:
    """Search hit rendering: '<ts> [<service>] [<level or N/A>: ]<message cut>...'.

    The ellipsis is always appended, as in the reference's search output.
    """
    stamp = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    stamp = F.concat(stamp, F.when(F.date_format(ts, "SSSSSS") != "000000",
                                   F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))).otherwise(F.lit("")))
    parts = [stamp, F.lit(" ["), service, F.lit("] ")]
    if level is not None:
        parts += [F.coalesce(level, F.lit("N/A")), F.lit(": ")]
    parts += [F.substring(message, 1, width), F.lit("...")]
    return F.concat(*parts)
