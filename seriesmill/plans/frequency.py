"""Frequencies: strings such as '1d', '30 minutes', '1mo' or '2', parsed once and turned into date arithmetic."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unit words by their meaning: seconds of a fixed step, or months of a calendar step.
FIXED = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
CALENDAR = {"month": 1, "quarter": 3, "year": 12}
_WORDS = {
    "second": ("s", "sec", "secs", "second", "seconds"),
    "minute": ("m", "min", "mins", "minute", "minutes"),
    "hour": ("h", "hr", "hrs", "hour", "hours"),
    "day": ("d", "day", "days"),
    "week": ("w", "week", "weeks"),
    "month": ("mo", "mon", "month", "months"),
    "quarter": ("q", "quarter", "quarters"),
    "year": ("y", "yr", "year", "years"),
}
_UNIT = {w: u for u, ws in _WORDS.items() for w in ws}


@dataclass(frozen=True)
class Frequency:
    """`count` units; unit None is a bare number: days for dates and timestamps, raw units for integers."""

    count: int
    unit: str | None

    @property
    def calendar(self) -> bool:
        return self.unit in CALENDAR

    @property
    def months(self) -> int:
        return self.count * CALENDAR[self.unit]

    @property
    def seconds(self) -> int:
        return self.count * FIXED[self.unit or "day"]


def parse(text: str | int | None) -> Frequency:
    """A missing frequency is one day. Raises ValueError for what is no positive frequency."""
    if text is None:
        return Frequency(1, "day")
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", str(text))
    if not m or int(m[1]) < 1 or (m[2] and m[2].lower() not in _UNIT):
        raise ValueError(f"no frequency: {text!r}")
    return Frequency(int(m[1]), _UNIT[m[2].lower()] if m[2] else None)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))


def check_date(df: DataFrame, date: str) -> T.DataType:
    """The date column's type; an error for anything but dates, timestamps and integers."""
    kind = df.schema[date].dataType
    if not (is_integer(kind) or isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))):
        raise TypeError(f"{date} must be a date, a timestamp or an integer, not {kind.simpleString()}")
    return kind


def whole_seconds(freq: Frequency, kind: T.DataType) -> int:
    """The fixed step: days for a date column (at least one), seconds for a timestamp, raw units for an integer."""
    if is_integer(kind):
        return freq.count if freq.unit is None else max(1, freq.seconds // 86400)
    return max(1, freq.seconds // 86400) if isinstance(kind, T.DateType) else freq.seconds


def shift(at: Column, freq: Frequency, kind: T.DataType, steps: Column) -> Column:
    """`at` moved by a number of steps, in its own type. Calendar steps clamp the day to the month's end and drop the
    time of day."""
    if is_integer(kind):
        return (at + steps * (freq.months if freq.calendar else whole_seconds(freq, kind))).cast(kind)
    if freq.calendar:
        return F.add_months(at.cast("date"), (steps * freq.months).cast("int")).cast(kind)
    if isinstance(kind, T.DateType):
        return F.date_add(at, (steps * whole_seconds(freq, kind)).cast("int"))
    seconds = (steps * freq.seconds).cast("decimal(18,6)")
    return (at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).cast(kind)


def as_number(at: Column, kind: T.DataType) -> Column:
    """A long that orders and subtracts like the date: days, microseconds or the integer."""
    if is_integer(kind):
        return at.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(at).cast("long")
    return F.unix_micros(at.cast("timestamp"))


def number_step(freq: Frequency, kind: T.DataType) -> int:
    """The fixed step in the units of `as_number`."""
    step = whole_seconds(freq, kind)
    return step * 1_000_000 if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else step


def between(a: Column, b: Column, freq: Frequency, kind: T.DataType) -> Column:
    """How many points prep.fill_gaps inserts between two dates of a series; negative or null for none."""
    if freq.calendar and not is_integer(kind):
        at = lambda x: F.floor((F.year(x) * 12 + F.month(x) - 1) / CALENDAR[freq.unit])
        return F.greatest(at(b) - at(a) - 1, F.lit(0)).cast("int")
    return F.greatest(F.ceil((as_number(b, kind) - as_number(a, kind)) / F.lit(number_step(freq, kind))) - 1, F.lit(0)).cast("int")


def inserted(at: Column, k: Column, freq: Frequency, kind: T.DataType) -> Column:
    """The k-th of those points."""
    if freq.calendar and not is_integer(kind):
        return F.add_months(F.trunc(at.cast("date"), freq.unit), (k * CALENDAR[freq.unit]).cast("int")).cast(kind)
    return shift(at, freq, kind, k)


def literal(value, kind: T.DataType) -> Column:
    return F.lit(value).cast(kind)
