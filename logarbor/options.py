"""Analyzer options: plain keyword arguments instead of a JSON config file.

Every option is a literal that Catalyst can fold into the plan; in particular
``as_of`` (the reference's "now") is fixed once, so reruns and tests repeat.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from datetime import datetime

# Names of the line formats, in the order they are tried.
FORMAT_ORDER = (
    "with_level",
    "traditional",
    "traditional_simple",
    "iso8601",
    "journald",
    "rainerscript_enhanced",
)

YEAR_MODES = ("rollback", "transition", "sequential")
ERROR_MODES = ("word", "substring")
OFFSET_MODES = ("utc", "drop")
DECODE_MODES = ("replace", "ignore")

# Accepted option ranges (days, truncate length, lines per service).
RANGES = {
    "max_days": (1, 365),
    "truncate_length": (10, 1000),
    "max_lines_per_service": (1, 1000),
}


@dataclass(frozen=True)
class AnalyzerOptions:
    """Options of one analysis run.

    as_of            the reference instant ("now"); defaults to the wall clock at construction
    max_days         day window: keep entries with as_of - max_days <= ts <= as_of + 1 day
    year_mode        rollback (default) | transition | sequential, for formats without a year
    base_year        starting year for transition/sequential (default: year of as_of)
    formats          active line formats, tried in FORMAT_ORDER
    error_mode       word (whole-word, default) | substring
    offsets          utc: timestamps with a UTC offset become UTC wall clock; drop: no entry
    decode           replace: bad UTF-8 -> U+FFFD; ignore: bad bytes removed
    """

    as_of: datetime = field(default_factory=lambda: datetime.now().replace(microsecond=0))
    max_days: int = 30
    truncate_length: int = 80
    show_full_lines: bool = False
    wrap_lines: bool = False
    max_lines_per_service: int = 5
    year_mode: str = "rollback"
    base_year: int | None = None
    formats: tuple[str, ...] = FORMAT_ORDER
    error_mode: str = "word"
    offsets: str = "utc"
    decode: str = "replace"

    def __post_init__(self) -> None:
        for name, (lo, hi) in RANGES.items():
            value = getattr(self, name)
            if not (lo <= value <= hi):
                raise ValueError(f"{name}={value} out of range [{lo}, {hi}]")
        _check_choice("year_mode", self.year_mode, YEAR_MODES)
        _check_choice("error_mode", self.error_mode, ERROR_MODES)
        _check_choice("offsets", self.offsets, OFFSET_MODES)
        _check_choice("decode", self.decode, DECODE_MODES)
        unknown = [f for f in self.formats if f not in FORMAT_ORDER]
        if unknown:
            raise ValueError(f"unknown formats {unknown}; known: {FORMAT_ORDER}")
        if not self.formats:
            raise ValueError("at least one format is required")
        # keep the try order fixed whatever order the caller listed
        object.__setattr__(self, "formats", tuple(f for f in FORMAT_ORDER if f in self.formats))

    @property
    def year(self) -> int:
        return self.base_year if self.base_year is not None else self.as_of.year

    def replace(self, **changes) -> "AnalyzerOptions":
        return dataclasses.replace(self, **changes)


def _check_choice(name: str, value: str, choices: tuple[str, ...]) -> None:
    if value not in choices:
        raise ValueError(f"{name}={value!r}; expected one of {choices}")
