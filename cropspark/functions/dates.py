"""Calendar, business days and seasons."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions.numeric import at_least

# Day number 0 (1970-01-01) is a Thursday, so day number -3 starts a week on Monday.
_MONDAY_SHIFT = 3


def day_number(c: Column) -> Column:
    return F.unix_date(c.cast("date")).cast("long")


def moment(when: datetime) -> Column:
    """A wall-clock literal that does not depend on the session's or the driver's time zone."""
    return F.lit(when.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def is_weekday(c: Column) -> Column:
    return F.weekday(c) < 5


def business_index(c: Column) -> Column:
    """Number of weekdays before the date, counted from a fixed Monday; consecutive weekdays differ by 1."""
    shifted = day_number(c) + _MONDAY_SHIFT
    return F.floor(shifted / 7) * 5 + F.least(F.pmod(shifted, F.lit(7)), F.lit(5))


def business_date(index: Column) -> Column:
    """Weekday that has the given business index."""
    return F.date_from_unix_date((F.floor(index / 5) * 7 + F.pmod(index, F.lit(5)) - _MONDAY_SHIFT).cast("int"))


def business_days_half_open(start: Column, end: Column) -> Column:
    """Weekdays in [start, end); 0 when end is not later."""
    return at_least(business_index(end) - business_index(start), 0)


def business_days_after(start: Column, end: Column) -> Column:
    """Weekdays in (start, end]; 0 when end is not later."""
    return at_least(business_index(F.date_add(end, 1)) - business_index(F.date_add(start, 1)), 0)


def month_index(year: Column, month: Column) -> Column:
    return year.cast("int") * 12 + month.cast("int")


def month_index_year(index: Column) -> Column:
    return F.floor((index - 1) / 12).cast("int")


def month_index_month(index: Column) -> Column:
    return (F.pmod(index - 1, F.lit(12)) + 1).cast("int")


def month_name_es(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in K.MONTH_NAMES_ES]), month.cast("int"))


def semester(month: Column) -> Column:
    return F.when(month <= 6, "A").otherwise("B")


def date_token(c: Column) -> Column:
    """2026-09-18 -> 18sep2026."""
    abbrev = F.element_at(F.array(*[F.lit(m) for m in K.MONTH_ABBREV_ES]), F.month(c))
    return F.concat(F.date_format(c, "dd"), abbrev, F.date_format(c, "yyyy"))


def parse_spanish_date(c: Column) -> Column:
    """'Viernes 24 de abril de 2026' -> date; missing when the text holds no such date."""
    pattern = r"(?i)(\d{1,2})\s+de\s+(\p{L}+)\s+de\s+(\d{4})"
    name = F.lower(F.regexp_extract(c, pattern, 2))
    names = F.array(*[F.lit(m.lower()) for m in K.MONTH_NAMES_ES])
    month = F.array_position(names, name).cast("string")
    text = F.concat_ws("-", F.regexp_extract(c, pattern, 3), F.lpad(month, 2, "0"),
                       F.lpad(F.regexp_extract(c, pattern, 1), 2, "0"))
    return F.when(F.array_contains(names, name), F.try_to_date(text, "yyyy-MM-dd"))


def season_sin(position: Column, period: float) -> Column:
    return F.sin(2 * F.pi() * position / period)


def season_cos(position: Column, period: float) -> Column:
    return F.cos(2 * F.pi() * position / period)


def local_day(ts: Column, zone: str = "America/Bogota") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))
