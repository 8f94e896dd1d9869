"""Spreadsheet date serials (1900 system, with its 29 February 1900 that never was)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tieout.functions.numeric import round_half_away
from tieout.naming import col as _col

# Fixed values of the 1900 date system.
FIRST_SERIAL = 1
PHANTOM_LEAP_DAY = 60
LAST_SERIAL = 2958465
OFFSET_BEFORE_PHANTOM = 25568
OFFSET_AFTER_PHANTOM = 25569
MICROS_PER_DAY = 86_400_000_000.0


def _epoch_days(whole: Column) -> Column:
    early = whole.between(FIRST_SERIAL, PHANTOM_LEAP_DAY - 1)
    late = whole.between(PHANTOM_LEAP_DAY + 1, LAST_SERIAL)
    return (
        F.when(early, whole - OFFSET_BEFORE_PHANTOM).when(late, whole - OFFSET_AFTER_PHANTOM)
    ).cast("int")


def serial_to_date(serial: Column) -> Column:
    """Date of a serial; null for 60, below 1, above 9999-12-31 and for null."""
    return F.date_from_unix_date(_epoch_days(F.floor(serial.cast("double"))))


def serial_to_datetime(serial: Column) -> Column:
    """Naive timestamp of a serial; the day fraction is rounded to whole microseconds."""
    number = serial.cast("double")
    whole = F.floor(number)
    micros = round_half_away((number - whole) * MICROS_PER_DAY).cast("bigint")
    midnight = F.date_from_unix_date(_epoch_days(whole)).cast("timestamp_ntz")
    zero = F.lit(0)
    seconds = (micros / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(18,6)")
    return midnight + F.make_dt_interval(zero, zero, zero, seconds)


def date_to_serial(value: Column) -> Column:
    """Serial of a date; null before 1900-01-01."""
    days = F.unix_date(value.cast("date"))
    return (
        F.when(days >= PHANTOM_LEAP_DAY + 1 - OFFSET_AFTER_PHANTOM, days + OFFSET_AFTER_PHANTOM)
        .when(days >= FIRST_SERIAL - OFFSET_BEFORE_PHANTOM, days + OFFSET_BEFORE_PHANTOM)
    ).cast("bigint")


def to_naive_utc(df: DataFrame) -> DataFrame:
    """Zoned timestamps become naive UTC; other columns pass through."""
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    changed = {
        field.name: F.to_utc_timestamp(_col(field.name).cast("timestamp_ntz").cast("timestamp"), zone)
        if zone not in ("UTC", "Etc/UTC", "GMT")
        else _col(field.name)
        for field in df.schema.fields
        if isinstance(field.dataType, T.TimestampType)
    }
    return df.withColumns({name: c.cast("timestamp_ntz") for name, c in changed.items()}) if changed else df
