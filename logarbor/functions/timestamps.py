"""Total timestamp construction from parsed fields: bad input gives NULL, never an error."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from logarbor.functions.formats import MONTHS


def _int(col: Column) -> Column:
    return col.try_cast("int")


def month_number(mon: Column) -> Column:
    """1..12 for a month name, NULL otherwise (exact, case-sensitive names)."""
    pos = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), mon)
    return F.when(pos > 0, pos.cast("int"))


def micros_of(frac: Column) -> Column:
    """Fraction digits -> microseconds: right-padded, cut to 6 digits (not rounded)."""
    return F.when((frac.isNull()) | (frac == ""), F.lit(0)).otherwise(
        _int(F.rpad(F.substring(frac, 1, 6), 6, "0")))


def clock_parts(clock: Column) -> tuple[Column, Column, Column]:
    """'HH:MM:SS' -> (hour, minute, second) integers."""
    return (_int(F.substring(clock, 1, 2)), _int(F.substring(clock, 4, 2)), _int(F.substring(clock, 7, 2)))


def make_ts(year: Column, month: Column, day: Column, hh: Column, mi: Column, ss: Column,
            micros: Column) -> Column:
    """TIMESTAMP_NTZ from parts; NULL for impossible dates and hours/minutes/seconds out of range.

    Seconds must be < 60 (make_timestamp would roll 60 into the next minute).
    """
    ok = (year >= 1) & (hh < 24) & (mi < 60) & (ss < 60)
    whole = F.try_make_timestamp_ntz(year, month, day, hh, mi, ss)
    # integer microsecond step: no decimal arithmetic per row
    return F.when(ok, F.timestamp_add("MICROSECOND", micros, whole))


def _is_leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def _ordinal(month, day, hh, mi, ss, micros):
    """Position inside a year as one comparable number (month, day, clock, micros)."""
    return ((((month * 32 + day) * 24 + hh) * 60 + mi) * 60 + ss) * 1000000 + micros


def rollback_year(as_of: datetime, month: Column, day: Column, hh: Column, mi: Column, ss: Column,
                  micros: Column) -> Column:
    """Year of ``as_of``; the year before when the date lies after ``as_of`` in that year,
    or cannot exist in it (29 Feb of a common year)."""
    ref = _ordinal(as_of.month, as_of.day, as_of.hour, as_of.minute, as_of.second, as_of.microsecond)
    pos = _ordinal(month.cast("bigint"), day.cast("bigint"), hh.cast("bigint"), mi.cast("bigint"),
                   ss.cast("bigint"), micros.cast("bigint"))
    future = pos > F.lit(ref)
    if not _is_leap(as_of.year):
        future = future | ((month == 2) & (day == 29))
    return F.when(future, F.lit(as_of.year - 1)).otherwise(F.lit(as_of.year))


def iso_texts(frac: Column, off: Column, boff: Column, tail: Column) -> dict[str, Column]:
    """Fraction digits and offset text of an ISO timestamp, as two plain columns.

    ``tail`` (rainerscript) holds fraction digits and an attached offset in one run;
    it is split with a small regex only on the rows that have one.
    """
    has_tail = tail != ""
    return {
        "frac": F.when(has_tail, F.regexp_extract(tail, r"^(\d{1,6})(?:[+-]\d{2}:?\d{2})?$", 1)).otherwise(frac),
        "offset": F.when(has_tail, F.regexp_extract(tail, r"^\d{1,6}([+-]\d{2}:?\d{2})?$", 1))
                   .when(off != "", off).otherwise(boff),
    }


def iso_parts(date: Column, frac: Column, offset: Column, z: Column, boff: Column, tail: Column,
              offsets: str) -> dict[str, Column]:
    """Year, month, day, microseconds, offset minutes and a 'bad' flag of an ISO timestamp.

    ``frac`` and ``offset`` come from ``iso_texts`` (materialized columns). A 'Z' is
    the wall clock as written. A 'Z' followed by a blank-separated offset, more than
    6 fraction digits, or an unreadable offset are bad. With ``offsets='drop'`` any
    offset is bad.
    """
    digits = F.replace(offset, F.lit(":"), F.lit(""))
    sign = F.when(F.substring(offset, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    oh = _int(F.substring(digits, 2, 2))
    om = _int(F.substring(digits, 4, 2))
    has_off = offset != ""
    bad = ((F.length(frac) > 6) | ((tail != "") & (frac == "")) | ((z != "") & (boff != ""))
           | (has_off & ~((oh < 24) & (om < 60))))
    if offsets == "drop":
        bad = bad | has_off
    return {
        "year": _int(F.substring(date, 1, 4)),
        "month": _int(F.substring(date, 6, 2)),
        "day": _int(F.substring(date, 9, 2)),
        "micros": micros_of(frac),
        "off_minutes": F.when(has_off, sign * (oh * 60 + om)).otherwise(F.lit(0)),
        "bad": F.coalesce(bad, F.lit(True)),
    }


def ntz_literal(value: datetime) -> Column:
    """A TIMESTAMP_NTZ literal from its wall-clock text: independent of any time zone setting."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def window_bounds(as_of: datetime, max_days: int) -> tuple[datetime, datetime]:
    """Day window [as_of - max_days, as_of + 1 day], both inclusive."""
    return as_of - timedelta(days=max_days), as_of + timedelta(days=1)
