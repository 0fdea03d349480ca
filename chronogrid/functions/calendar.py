"""Historical dates: years before Christ are negative, year 0 exists, and minutes count from the start of year 0.

Leap years are those of the Gregorian rule at all times, and in antiquity also a list of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: leap years before Christ beside the rule (every third year from -45 to -9)
EARLY_LEAPS = [-45, -42, -39, -36, -33, -30, -27, -24, -21, -18, -15, -12, -9]
#: The days of the months in years that are no leap years.
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
DAY = 24 * 60


def is_leap(year: Column) -> Column:
    rule = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return rule | year.isin(EARLY_LEAPS)


def let(value: Column, form) -> Column:
    """form(value), the value being worked out once however often it stands there."""
    return F.get(F.transform(F.array(value), form), F.lit(0))


def days_before_year(year: Column) -> Column:
    """Days from the start of year 0 to that of the year; negative before it."""

    def days(year: Column) -> Column:
        last, size = year - 1, -year
        after = sum((sign * (F.floor(last / n) + 1) for n, sign in ((4, 1), (100, -1), (400, 1))), F.lit(0))  # multiples from 0 to last
        before = sum((sign * F.floor(size / n) for n, sign in ((4, 1), (100, -1), (400, 1))), F.lit(0))  # multiples from year to -1
        extra = sum(((F.lit(y) >= year).cast("int") for y in EARLY_LEAPS if y % 4), F.lit(0))
        return year * 365 + F.when(year > 0, after).when(year < 0, -(before + extra)).otherwise(0)

    return let(year, days).cast("long")


def days_before_month(year: Column, month: Column) -> Column:
    starts = F.array(*[F.lit(sum(MONTH_DAYS[:i])) for i in range(12)])
    return F.get(starts, (month - 1).cast("int")) + F.when((month > 2) & is_leap(year), 1).otherwise(0)


def month_of(year: Column, day: Column) -> Column:
    """The month of a year's day, counted from 0."""
    leap = is_leap(year).cast("int")
    return sum(((day >= sum(MONTH_DAYS[:i]) + (leap if i > 1 else 0)).cast("int") for i in range(1, 12)), F.lit(1))


def to_minutes(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """Minutes of a date; minutes of 60 and more go over into hours, hours of 24 into days, months beyond 1 to 12 into years."""
    hour = hour + F.when(minute >= 60, F.floor(minute / 60)).otherwise(0)
    minute = F.when(minute >= 60, minute % 60).otherwise(minute)
    day = day + F.when(hour >= 24, F.floor(hour / 24)).otherwise(0)
    hour = F.when(hour >= 24, hour % 24).otherwise(hour)
    year = (year + F.floor((month - 1) / 12)).cast("long")
    month = (F.pmod(month - 1, F.lit(12)) + 1).cast("int")
    return ((days_before_year(year) + days_before_month(year, month) + day - 1) * DAY + hour * 60 + minute).cast("long")


def from_minutes(minutes: Column) -> Column:
    """Struct of year, month, day, hour and minute."""
    days = F.floor(minutes / DAY).cast("long")
    guess = F.floor(days / 365.2425).cast("long")
    year = let(guess, lambda y: y + (days_before_year(y + 1) <= days).cast("int") - (days_before_year(y) > days).cast("int"))
    placed = let(year, lambda y: F.struct(y.alias("y"), (days - days_before_year(y)).alias("day")))
    dated = let(placed, lambda p: F.struct(p["y"].alias("y"), p["day"].alias("day"), month_of(p["y"], p["day"]).alias("m")))
    left = minutes - days * DAY
    return let(
        dated,
        lambda p: F.struct(
            p["y"].cast("int").alias("year"), p["m"].cast("int").alias("month"), (p["day"] - days_before_month(p["y"], p["m"]) + 1).cast("int").alias("day"),
            F.floor(left / 60).cast("int").alias("hour"), (left % 60).cast("int").alias("minute"),
        ),
    )


def parse_date(text: Column, delimiter: str = ".") -> Column:
    """Struct of year, month, day, hour and minute of ``Y.M.D.h.m``; missing parts are 1, 1, 0 and 0; null if a part is no number."""
    parts = F.transform(F.split(text, "[" + delimiter + "]"), lambda p: F.regexp_extract(p, r"^\s*([+-]?\d+)", 1).try_cast("int"))
    value = lambda i, missing: F.coalesce(F.get(parts, F.lit(i)), F.lit(missing))
    names = ("year", 0), ("month", 1), ("day", 1), ("hour", 0), ("minute", 0)
    return F.when(F.forall(parts, lambda p: p.isNotNull()), F.struct(*[value(i, m).alias(n) for i, (n, m) in enumerate(names)]))


def fractional_year(years: Column) -> Column:
    """Struct of year, month, day and hour of a number of years; a year's fraction counts as 365 days. Days count from 0 here."""
    year = F.floor(years).cast("int")
    days = (years - year) * 365
    whole = F.floor(days).cast("int")
    month = month_of(year, whole)
    return F.struct(year.alias("year"), month.cast("int").alias("month"), (whole - days_before_month(year, month)).cast("int").alias("day"), F.floor((days - whole) * 24).cast("int").alias("hour"))


def year_label(year: Column) -> Column:
    """500BC, 0AD, 1900AD."""
    return F.concat(F.abs(year).cast("string"), F.when(year >= 0, "AD").otherwise("BC"))


def since(as_of: str, time: Column, unit: str) -> Column:
    """Time up to ``as_of`` in milliseconds, seconds, minutes, hours or days."""
    micros = {"milliseconds": 1e3, "seconds": 1e6, "minutes": 6e7, "hours": 3.6e9, "days": 8.64e10}[unit]
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(time.cast("timestamp"))) / micros


def to_instant(value: Column) -> Column:
    """A timestamp from a text: milliseconds if it is a whole number, else what Spark reads as a time; null otherwise."""
    millis = F.trim(value).try_cast("long")
    return F.coalesce(F.timestamp_millis(millis), F.trim(value).try_cast("timestamp")).cast("timestamp_ntz")
