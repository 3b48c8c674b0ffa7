"""Check digits and dates of Swedish numbers, as Column expressions (in the JVM) and as plain functions."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _weighted(c: Column, weigh) -> Column:
    values = F.transform(F.filter(F.split(F.reverse(c), ""), lambda d: d != ""), lambda d, i: weigh(d.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _two(d: Column) -> Column:
    return F.when(d > 9, d - 9).otherwise(d)


def luhn(c: Column) -> Column:
    """The Luhn sum of a run of digits is a multiple of ten; zeros alone pass."""
    return _weighted(c, lambda d, i: _two(d * (i % 2 + 1))) % 10 == 0


def mod10(c: Column) -> Column:
    """Luhn with a sum other than zero."""
    s = _weighted(c, lambda d, i: _two(d * (i % 2 + 1)))
    return (s % 10 == 0) & (s != 0)


def mod11(c: Column) -> Column:
    """Weights 1 to 10 from the right, again and again; a multiple of eleven other than zero."""
    s = _weighted(c, lambda d, i: d * (i % 10 + 1))
    return (s % 11 == 0) & (s != 0)


def luhn_sum(number: str, twice: int = 1) -> int:
    """Digit sum with every second digit doubled; twice: 1 if the last digit counts once."""
    return sum(sum(divmod(int(d) * (1 + (i + 1 + twice) % 2), 10)) for i, d in enumerate(reversed(number)))


def passes_luhn(number: str) -> bool:
    return luhn_sum(number) % 10 == 0


def passes_mod10(number: str) -> bool:
    return (s := luhn_sum(number)) > 0 and s % 10 == 0


def passes_mod11(number: str) -> bool:
    s = sum(int(d) * (i % 10 + 1) for i, d in enumerate(reversed(number)))
    return s > 0 and s % 11 == 0


def is_day(year: int | None, yy: int, month: int, day: int) -> bool:
    """A real day; without a full year any year that ends in yy may be meant, so every fourth is a leap year."""
    if not 1 <= month <= 12 or day < 1:
        return False
    leap = calendar.isleap(year) if year is not None else yy % 4 == 0
    return day <= (29 if leap else 28) if month == 2 else day <= calendar.monthrange(2001, month)[1]
