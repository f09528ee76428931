"""Column functions: strict parsing, finite numbers, clocks, money, digests and reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"
DAY = r"^\d{4}-\d{2}-\d{2}$"


def instant(text: Column) -> Column:
    """ISO instant with a zone to a timestamp; anything else, a missing zone included, is null."""
    return F.when(F.rlike(text, F.lit(INSTANT)), F.try_to_timestamp(text))


def day(text: Column) -> Column:
    """Canonical ISO date; `2024-1-2` and impossible dates are null."""
    return F.when(F.rlike(text, F.lit(DAY)), text.try_cast("date"))


def finite(value: Column) -> Column:
    """True for numbers other than null, NaN and the infinities."""
    x = value.cast("double")
    return x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0))) & (F.abs(F.coalesce(x, F.lit(0.0))) < float("inf"))


def number(text: Column, *, integer: bool = False) -> Column:
    """Text to a finite double, or a long if ``integer``; booleans, NaN and fractions of integers are null."""
    shape = r"^\s*[+-]?\d+\s*$" if integer else r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
    value = F.trim(text).try_cast("bigint" if integer else "double")
    return F.when(F.rlike(text, F.lit(shape)) & finite(value), value)


def plus_seconds(at: Column, seconds: int | float) -> Column:
    """Elapsed time, 0 to 86400 seconds."""
    if isinstance(seconds, bool) or not 0 <= seconds <= 86400:
        raise ValueError("processing delay has to be 0 to 86400 seconds")
    return at + F.make_dt_interval(secs=F.lit(seconds))


def assumed_available(published_on: Column, zone: str, delay_hours: float) -> Column:
    """The next local midnight after a publication date, in UTC, plus a delay of 0 to 168 hours."""
    if isinstance(delay_hours, bool) or not 0 <= delay_hours <= 168:
        raise ValueError("assumed delay has to be 0 to 168 hours")
    midnight = F.to_utc_timestamp(F.date_add(published_on, 1).cast("timestamp"), zone)
    return midnight + F.make_dt_interval(secs=F.lit(delay_hours * 3600))


def money(value: Column) -> Column:
    """Cents, half to even."""
    return F.bround(value.cast("decimal(38,10)"), 2)


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns' texts; null differs from empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]), 256)


def first_reason(*pairs: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds; null if none does. Order is meaning."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in pairs], F.lit(None).cast("string"))


def all_reasons(*pairs: tuple[Column, str]) -> Column:
    """The reasons of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in pairs]))


def half_open(lo: Column, hi: Column, at: Column) -> Column:
    """lo <= at < hi; a null hi is open."""
    return (lo <= at) & (hi.isNull() | (at < hi))


def left_open(lo: Column, hi: Column, at: Column) -> Column:
    """lo < at <= hi."""
    return (lo < at) & (at <= hi)


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
