"""Numbers: rounding flavours, guards and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def round_half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def round_half_away(c: Column, digits: int = 0) -> Column:
    return F.round(c, digits)


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Ties go towards plus infinity."""
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale


def at_least(c: Column, low: float) -> Column:
    """Raise to the lower bound; missing stays missing (greatest alone would return the bound)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clean_number(c: Column) -> Column:
    """Text or number to double: what does not parse, and NaN, is missing."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def bounded_int(c: Column, low: int, high: int, default: int) -> Column:
    """Parse, cut off decimals, clamp; anything unparsable gives the default."""
    number = clean_number(c)
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    clamped = F.greatest(F.lit(low), F.least(F.lit(high), whole))  # these two skip missing values, hence the guard
    return F.when(whole.isNotNull(), clamped).otherwise(F.lit(default)).cast("int")


def positive_id(c: Column) -> Column:
    number = clean_number(c)
    return F.when((number > 0) & (number == F.floor(number)), number.cast("long"))


def pct_change(value: Column, base: Column) -> Column:
    return F.when(base > 0, (value - base) / base * 100)


def pct_of(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole * 100)


def null_outside(c: Column, low: float | None = None, high: float | None = None) -> Column:
    keep = F.lit(True)
    if low is not None:
        keep = keep & (c >= low)
    if high is not None:
        keep = keep & (c <= high)
    return F.when(keep, c)


def clamp_low_null_high(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, F.lit(float(low))).when(c <= high, c)


def sentinel_to_null(c: Column, at_or_below: float) -> Column:
    return F.when(c > at_or_below, c)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return EARTH_RADIUS_KM * 2 * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def sum_if_enough(c: Column, at_least: int) -> Column:
    """Aggregate: the sum, only when enough values are present."""
    return F.when(F.count(c) >= at_least, F.sum(c))


def avg_when(condition: Column, c: Column) -> Column:
    return F.avg(F.when(condition, c))


def sum_when(condition: Column, c: Column) -> Column:
    return F.sum(F.when(condition, c))


def is_present(c: Column) -> Column:
    return c.isNotNull().cast("int")
