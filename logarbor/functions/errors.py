"""Error detection (word and substring modes) and the severity class of an entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels that mark an entry as an error.
ERROR_LEVELS = ("ERROR", "CRITICAL", "FATAL")
# Words that mark a message as an error.
ERROR_WORDS = ("error", "failed", "failure", "exception", "critical", "panic")
# Words of the severity fallback when an entry has no level.
SEVERITY_WORDS = ("error", "failed", "failure", "exception", "critical")
# Level -> severity class of the tree display.
LEVEL_CLASSES = (
    ("ERROR", "red"), ("ERR", "red"), ("FATAL", "bold red"),
    ("WARN", "yellow"), ("WARNING", "yellow"),
    ("INFO", "green"), ("DEBUG", "blue"),
    ("CRIT", "bold red"), ("CRITICAL", "bold red"),
)

WORD_PATTERN = r"(?iU)\b(?:" + "|".join(ERROR_WORDS) + r")\b"
# same words for pure-ASCII messages: ASCII classes and case folding agree there and are cheaper
ASCII_WORD_PATTERN = r"(?i)\b(?:" + "|".join(ERROR_WORDS) + r")\b"


def level_is_error(level: Column) -> Column:
    return F.coalesce(F.upper(level).isin(*ERROR_LEVELS), F.lit(False))


def is_error(level: Column, message: Column, mode: str = "word") -> Column:
    """word: whole word, any case (default); substring: lower-cased substring."""
    if mode == "word":
        is_ascii = F.length(message) == F.octet_length(message)
        text_hit = F.when(is_ascii, message.rlike(ASCII_WORD_PATTERN)).otherwise(message.rlike(WORD_PATTERN))
    elif mode == "substring":
        low = F.lower(message)
        text_hit = F.lit(False)
        for w in ERROR_WORDS:
            text_hit = text_hit | low.contains(w)
    else:
        raise ValueError(f"unknown error mode {mode!r}")
    return level_is_error(level) | F.coalesce(text_hit, F.lit(False))


def severity(level: Column, message: Column) -> Column:
    """Display class: by level when present, else red when an error word is a substring."""
    up = F.upper(level)
    by_level = F.lit("white")
    expr = None
    for name, cls in LEVEL_CLASSES:
        expr = (F.when(up == name, F.lit(cls)) if expr is None else expr.when(up == name, F.lit(cls)))
    by_level = expr.otherwise(F.lit("white"))
    low = F.lower(message)
    hit = F.lit(False)
    for w in SEVERITY_WORDS:
        hit = hit | low.contains(w)
    return F.when(level.isNotNull(), by_level).when(hit, F.lit("red")).otherwise(F.lit("white"))
