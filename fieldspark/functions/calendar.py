"""Numeric time with units and a calendar, as integers of year, month, day and second.

Calendars are ``standard`` (Gregorian, also before its start and before year 1), ``noleap`` and ``360_day``. Years are
astronomical (a year 0 exists), so that years that no date type holds stay plain integers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of the units, and days before each month of a year without a leap day.
UNITS = {"days": 86_400, "hours": 3_600, "minutes": 60, "seconds": 1}
BEFORE = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)
CALENDARS = {"standard": "standard", "gregorian": "standard", "proleptic_gregorian": "standard", "noleap": "noleap", "365_day": "noleap", "360_day": "360_day"}


def parse_units(units: str) -> tuple[int, tuple[int, int, int], int]:
    """Seconds of a unit, the base date, and its second of the day, of ``<unit> since <y>-<m>-<d> [<h>:<m>:<s>]``."""
    m = re.fullmatch(r"\s*(\w+?)s?\s+since\s+(-?\d+)-(\d+)-(\d+)(?:[ T](\d+):(\d+)(?::(\d+))?\S*)?\s*", units)
    if not m or f"{m[1]}s" not in UNITS:
        raise ValueError(f"unknown units of time: {units}")
    h, mi, s = (int(x or 0) for x in m.groups()[4:])
    return UNITS[f"{m[1]}s"], (int(m[2]), int(m[3]), int(m[4])), h * 3600 + mi * 60 + s


def day_number(year: int, month: int, day: int, calendar: str) -> int:
    """Days from the first day of year 0 of the calendar."""
    if calendar == "360_day":
        return year * 360 + (month - 1) * 30 + day - 1
    if calendar == "noleap":
        return year * 365 + BEFORE[month - 1] + day - 1
    # years from March, so that the leap day is the last of a year; year 0 begins 60 days before its March
    y, m = (year, month - 3) if month > 2 else (year - 1, month + 9)
    return y * 365 + y // 4 - y // 100 + y // 400 + (153 * m + 2) // 5 + day - 1 + 60


def _floor(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def date_of(days: Column, calendar: str) -> tuple[Column, Column, Column]:
    """Year, month and day of a number of days as ``day_number`` counts them."""
    if calendar == "360_day":
        rest = F.pmod(days, F.lit(360))
        return _floor(days, 360), (_floor(rest, 30) + 1), (rest % 30 + 1)
    if calendar == "noleap":
        rest = F.pmod(days, F.lit(365))
        month, before = F.lit(1), F.lit(0)
        for k, b in enumerate(BEFORE[1:], 2):
            month, before = F.when(rest >= b, k).otherwise(month), F.when(rest >= b, b).otherwise(before)
        return _floor(days, 365), month.cast("long"), (rest - before + 1)
    z = days - 60
    era = _floor(z, 146_097)
    doe = z - era * 146_097
    yoe = _floor(doe - _floor(doe, 1460) + _floor(doe, 36_524) - _floor(doe, 146_096), 365)
    doy = doe - (yoe * 365 + _floor(yoe, 4) - _floor(yoe, 100))
    mp = _floor(doy * 5 + 2, 153)
    month = F.when(mp < 10, mp + 3).otherwise(mp - 9)
    return (yoe + era * 400 + F.when(month <= 2, 1).otherwise(0)), month, (doy - _floor(mp * 153 + 2, 5) + 1)


def decode(number: Column, units: str, calendar: str = "standard") -> tuple[Column, Column, Column, Column]:
    """Year, month, day and second of the day of a numeric time; an unknown calendar raises ValueError."""
    if calendar not in CALENDARS:
        raise ValueError(f"unknown calendar: {calendar}")
    calendar = CALENDARS[calendar]
    unit, base, second = parse_units(units)
    total = F.round(number.cast("double") * unit).cast("long") + second
    days = _floor(total, 86_400) + day_number(*base, calendar)
    return (*date_of(days, calendar), F.pmod(total, F.lit(86_400)))


def months(year: Column, month: Column, base_year: int) -> Column:
    """Months since January of a base year: the time of a monthly field."""
    return ((year - base_year) * 12 + month - 1).cast("long")
