"""Dates and times as numbers since 1960-01-01, and back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_TO_UNIX_DAYS = 3653
STAMP = "%d%b%y:%H:%M:%S"


def sas_days(date: Column) -> Column:
    return F.datediff(date, F.lit("1960-01-01").cast("date"))


def sas_seconds(stamp: Column) -> Column:
    """Whole seconds, toward zero."""
    return F.timestamp_diff("SECOND", F.lit("1960-01-01 00:00:00").cast("timestamp_ntz"), stamp.cast("timestamp_ntz"))


def seconds_of_day(stamp: Column) -> Column:
    return F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.second(stamp)


def date_of_sas(days: Column) -> Column:
    """Null outside the years 1 to 9999."""
    inside = days.between(-715_510, 2_936_547)
    return F.when(inside, F.date_add(F.lit("1960-01-01").cast("date"), F.when(inside, days).cast("int")))


def stamp_of_sas(seconds: Column) -> Column:
    inside = seconds.between(-715_510 * 86_400, 2_936_548 * 86_400 - 1)
    return F.when(inside, F.timestamp_add("SECOND", F.when(inside, seconds).cast("long"), F.lit("1960-01-01 00:00:00").cast("timestamp_ntz")))


def time_of_sas(seconds: Column) -> Column:
    """HH:mm:ss; null outside a day."""
    s = seconds.cast("long")
    return F.when(s.between(0, 86_399), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def iso_stamp(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")


def header_stamp(when: dt.datetime) -> str:
    """``15JUN24:14:30:45``."""
    return when.strftime(STAMP).upper()


def parse_header_stamp(text: str) -> dt.datetime | None:
    for form in (STAMP, "%d%b%Y:%H:%M:%S"):
        try:
            return dt.datetime.strptime(text.strip().title(), form)
        except ValueError:
            continue
    return None
