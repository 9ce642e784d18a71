"""Hearing dates, which stay DD-MM-YYYY texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_empty, let, strip

DATE_PATTERN = r"^(\d{1,2})[-/.]?(\d{1,2})[-/.]?(\d{4})$"
DATE_SWAPS = (("O", "0"), ("0", "O"), ("I", "1"), ("1", "I"))


def valid_date_parts(day: Column, month: Column, year: Column) -> Column:
    """A day that the calendar has, in the years 1950 to 2100."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return year.between(1950, 2100) & month.between(1, 12) & (day >= 1) & (day <= last)


def _numbers(t: Column) -> Column:
    """Day, month and year of a text that has the form of a date, else null."""
    return F.when(t.rlike(DATE_PATTERN), F.array(*(F.regexp_extract(t, DATE_PATTERN, i).try_cast("int") for i in (1, 2, 3))))


def _formatted(n: Column) -> Column:
    return F.concat_ws("-", F.lpad(n[0].cast("string"), 2, "0"), F.lpad(n[1].cast("string"), 2, "0"), n[2].cast("string"))


def parse_date(c: Column) -> Column:
    """struct(raw_text, day, month, year, is_valid, formatted, date_obj, confidence); null where the text has another form."""

    def parsed(n: Column) -> Column:
        valid = valid_date_parts(n[0], n[1], n[2])
        return F.struct(
            strip(c).alias("raw_text"),
            n[0].alias("day"),
            n[1].alias("month"),
            n[2].alias("year"),
            valid.alias("is_valid"),
            _formatted(n).alias("formatted"),
            F.when(valid, F.make_date(n[2], n[1], n[0])).alias("date_obj"),
            F.when(valid, 0.95).otherwise(0.50).alias("confidence"),
        )

    return let(_numbers(strip(c)), lambda n: F.when(n.isNotNull(), parsed(n)))


def is_logical_date(date: Column, as_of: Column) -> Column:
    """From 1950 to a year (365 days) after as_of."""
    return (date <= F.date_add(as_of, 365)) & (F.year(date) >= 1950)


def _valid_formatted(t: Column) -> Column:
    return let(_numbers(t), lambda n: F.when(n.isNotNull() & valid_date_parts(n[0], n[1], n[2]), _formatted(n)))


def correct_date(c: Column) -> Column:
    """The first of the text and its letter-digit swaps that is a valid date, as DD-MM-YYYY; else null."""
    text = F.replace(strip(c), F.lit("/"), F.lit("-"))
    return let(text, lambda t: F.coalesce(_valid_formatted(t), *(_valid_formatted(F.replace(t, F.lit(a), F.lit(b))) for a, b in DATE_SWAPS)))


def date_sort_key(c: Column) -> Column:
    """struct(year, month, day) of the numbers between dashes, unchecked; (9999, 99, 99) for empty and other texts."""
    numbers = F.transform(F.slice(F.split(c, "-"), 1, 3), lambda x: strip(x).try_cast("int"))
    bad = F.array(F.lit(99), F.lit(99), F.lit(9999))
    good = lambda n: ~is_empty(c) & (F.size(n) == 3) & ~F.exists(n, lambda x: x.isNull())
    return let(let(numbers, lambda n: F.when(good(n), n).otherwise(bad)), lambda n: F.struct(n[2].alias("year"), n[1].alias("month"), n[0].alias("day")))
