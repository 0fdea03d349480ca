"""Number expressions: safe values, roots, logarithms, rounding, ordinals, digits as letters, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS, LETTERS = "0123456789", "abcdefghij"


def safe_number(text: Column, default: float = 0.0) -> Column:
    """The number that a text begins with; the default where there is none, or no finite one."""
    number = F.regexp_extract(F.trim(text.cast("string")), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double")
    infinite = F.abs(number) == float("inf")
    return F.when(number.isNull() | F.isnan(number) | infinite, F.lit(default)).otherwise(number)


def unzero(number: Column, default: float = 1.0) -> Column:
    return F.when(F.coalesce(number, F.lit(0.0)) == 0, F.lit(default)).otherwise(number)


def root(number: Column, degree: int) -> Column:
    """The real root; of a negative number only for an odd degree, else null."""
    positive = F.pow(F.abs(number), F.lit(1.0 / degree))
    return F.when(number >= 0, positive).when(F.lit(degree % 2 == 1), -positive)


def logarithm(base: Column, number: Column) -> Column:
    return F.when((number > 0) & (base > 0) & (base != 1), F.ln(number) / F.ln(base))


def log_factorial(n: Column) -> Column:
    """ln n! by its terms; 0 for 0 and 1, null for negative numbers."""
    return F.when(n >= 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln(i)))


def factorial(n: Column) -> Column:
    """n! as a double, up to 170."""
    return F.when((n >= 0) & (n <= 170), F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(1.0), lambda a, i: a * i))


def round_to(number: Column, places: int) -> Column:
    """Rounded half away from zero."""
    return F.round(number, places)


def significant(number: Column, figures: int) -> Column:
    """Rounded to so many significant figures, half up; 0 stays 0."""
    scale = F.pow(F.lit(10.0), figures - (F.floor(F.log10(F.abs(number))) + 1))
    return F.when(number == 0, 0.0).otherwise(F.floor(number * scale + 0.5) / scale)


def ordinalise(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, -21st."""
    size = F.abs(n)
    teens = (size % 100).isin(11, 12, 13)
    ending = F.when(teens, "th").when(size % 10 == 1, "st").when(size % 10 == 2, "nd").when(size % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def deordinalise(text: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(text, "(st|nd|rd|th)", ""), r"^\s*([+-]?\d+)", 1).try_cast("long")


def digits_to_letters(value: Column) -> Column:
    return F.translate(value.cast("string"), DIGITS, LETTERS)


def letters_to_digits(text: Column) -> Column:
    return safe_number(F.translate(text, LETTERS, DIGITS), float("nan"))


def interval(low: Column, high: Column) -> Column:
    """Ends in order, as a struct of low and high."""
    return F.struct(F.least(low, high).alias("low"), F.greatest(low, high).alias("high"))


def interval_by_interval(a: Column, b: Column, op: str) -> Column:
    """Two intervals end by end (low with low, high with high), in order again; a quotient by 0 is null."""
    known = {"add": lambda p, q: p + q, "subtract": lambda p, q: p - q, "multiply": lambda p, q: p * q, "divide": lambda p, q: F.when(q != 0, p / q), "pow": F.pow, "root": lambda p, q: F.when((q != 0) & (p >= 0), F.pow(p, 1 / q))}
    return interval(known[op](a["low"], b["low"]), known[op](a["high"], b["high"]))


def interval_by_number(a: Column, number: Column, op: str) -> Column:
    return interval_by_interval(a, F.struct(number.alias("low"), number.alias("high")), op)


def midpoint(a: Column) -> Column:
    return (a["low"] + a["high"]) / 2
