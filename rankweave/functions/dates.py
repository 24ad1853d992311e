"""Dates from text and file names, and bounds of periods."""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.text import narrow


def full_year(yy: Column, pivot: int) -> Column:
    """Two digits to a year: from the pivot on in the last century."""
    return F.when(yy >= pivot, 1900 + yy).otherwise(2000 + yy)


def file_date(name: Column, pivot: int = 90) -> Column:
    """The date in a name such as K240131.TXT; null where there is none."""
    part = lambda k: F.regexp_extract(name, r"[A-Za-z](\d{2})(\d{2})(\d{2})\.[A-Za-z]+$", k).try_cast("int")
    return F.try_make_timestamp(full_year(part(1), pivot), part(2), part(3), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def text_date(text: Column, pivot: int = 80) -> Column:
    """A date written as 2024/ 1/31 or as 24. 1.31, wide digits allowed."""
    plain = narrow(text)
    long = lambda k: F.regexp_extract(plain, r"(\d{4})[/年]\s*(\d{1,2})[/月]\s*(\d{1,2})", k).try_cast("int")
    short = lambda k: F.regexp_extract(plain, r"(?<!\d)(\d{2})\.\s*(\d{1,2})\.\s*(\d{1,2})", k).try_cast("int")
    made = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.coalesce(made(long(1), long(2), long(3)), made(full_year(short(1), pivot), short(2), short(3)))


def years_before(day: Column, years: float) -> Column:
    return F.add_months(day, -round(years * 12))


def warm_up_start(last: Column, years: float) -> Column:
    """First day to read so that windows are filled: two more years than are wanted."""
    return F.date_sub(last, math.ceil((years + 2) * 365.25))


def period(start: date | None, end: date | None, days: int, today: date) -> tuple[date, date]:
    """Start and end of a backtest from what is given of them."""
    end = end or (start + timedelta(days - 1) if start else today - timedelta(1))
    start = start or end - timedelta(days - 1)
    if start > end:
        raise ValueError("the period ends before it starts")
    return start, end
