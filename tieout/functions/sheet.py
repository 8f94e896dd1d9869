"""The text and date functions spreadsheet formulas use, as column expressions."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, functions as F

from tieout.errors import UnknownPatternError
from tieout.functions.cells import to_number
from tieout.functions.numeric import round_half_away

# Functions whose result changes on every calculation. They are refused.
VOLATILE = ["TODAY", "NOW", "RAND", "RANDBETWEEN", "RANDARRAY", "OFFSET", "INDIRECT", "CELL", "INFO"]


# Text

def concatenate(*columns: Column) -> Column:
    """CONCATENATE: empty cells join as nothing."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def textjoin(separator: str, *columns: Column) -> Column:
    """TEXTJOIN across columns, empty cells skipped."""
    return F.concat_ws(separator, *[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def left(value: Column, count: int = 1) -> Column:
    return F.left(value, F.lit(count))


def right(value: Column, count: int = 1) -> Column:
    return F.right(value, F.lit(count))


def mid(value: Column, start: int, count: int) -> Column:
    return F.substring(value, start, count)


def trim(value: Column) -> Column:
    """TRIM: no outer spaces, single inner spaces."""
    return F.trim(F.regexp_replace(value, " +", " "))


def proper(value: Column) -> Column:
    """PROPER: a capital after every non-letter, the rest in lower case."""
    words = F.split(F.lower(value), r"(?<=\P{L})")
    raised = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1)))
    return F.array_join(raised, "")


def text(value: Column, mask: str) -> Column:
    """TEXT for number masks such as ``0.00``, ``#,##0.0``, ``0%`` and two date masks."""
    dates = {"yyyy-mm-dd": "yyyy-MM-dd", "dd/mm/yyyy": "dd/MM/yyyy"}
    if mask.lower() in dates:
        return F.date_format(value, dates[mask.lower()])
    shape = re.fullmatch(r"(0|#,##0)(?:\.(0+))?(%?)", mask)
    if shape is None:
        raise UnknownPatternError(f"TEXT mask {mask!r} is not supported")
    places = len(shape.group(2) or "")
    number = value.cast("double") * (100.0 if shape.group(3) else 1.0)
    rounded = round_half_away(number, places)
    shown = (F.format_number(rounded, places) if shape.group(1) == "#,##0"
             else F.format_string(f"%.{places}f", rounded))
    return F.when(value.isNotNull(), F.concat(shown, F.lit(shape.group(3))))


def substitute(value: Column, old: str, new: str) -> Column:
    """SUBSTITUTE: every occurrence."""
    return F.replace(value, F.lit(old), F.lit(new)) if old else value


def replace(value: Column, start: int, count: int, new: str) -> Column:
    """REPLACE by position."""
    return F.overlay(value, F.lit(new), start, count)


def rept(value: Column, times: int) -> Column:
    return F.repeat(value, times)


def find(needle: Column | str, value: Column) -> Column:
    """FIND: 1-based position, null when absent."""
    wanted = needle if isinstance(needle, Column) else F.lit(needle)
    return F.nullif(F.position(wanted, value), F.lit(0))


def search(needle: Column | str, value: Column) -> Column:
    """SEARCH: FIND without regard to case."""
    wanted = needle if isinstance(needle, Column) else F.lit(needle)
    return find(F.lower(wanted), F.lower(value))


def value(text_value: Column) -> Column:
    """VALUE: text to number."""
    return to_number(text_value)


def clean(text_value: Column) -> Column:
    """CLEAN: drop control characters 0 to 31."""
    return F.regexp_replace(text_value, r"[\x00-\x1f]", "")


# Dates

def date(year: Column, month: Column, day: Column) -> Column:
    """DATE: months and days outside their range roll over; years below 1900 count from 1900."""
    full_year = F.when(year < 1900, year + 1900).otherwise(year)
    start = F.make_date(full_year.cast("int"), F.lit(1), F.lit(1))
    return F.date_add(F.add_months(start, (month - 1).cast("int")), (day - 1).cast("int"))


def datevalue(text_value: Column, pattern: str | None = None) -> Column:
    """DATEVALUE: null where the text is no date."""
    return F.try_to_date(text_value, pattern) if pattern else F.try_to_date(text_value)


def eomonth(day: Column, months: int = 0) -> Column:
    return F.last_day(F.add_months(day, months))


def edate(day: Column, months: int) -> Column:
    return F.add_months(day, months)


def datedif(start: Column, end: Column, unit: str) -> Column:
    """DATEDIF in whole days, months or years; null when the end lies before the start."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    months = months - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)
    units = {"D": F.datediff(end, start), "M": months, "Y": F.floor(months / 12).cast("int")}
    if unit.upper() not in units:
        raise UnknownPatternError(f"DATEDIF unit {unit!r} is not supported")
    return F.when(end >= start, units[unit.upper()])


def weekday(day: Column) -> Column:
    """WEEKDAY: Sunday is 1."""
    return F.dayofweek(day)


def weeknum(day: Column) -> Column:
    """WEEKNUM: week 1 holds 1 January, weeks begin on Sunday."""
    lead = F.dayofweek(F.trunc(day, "year")) - 1
    return (F.floor((F.dayofyear(day) + lead - 1) / 7) + 1).cast("int")


def _weekday_index(day: Column) -> Column:
    """Number of Mondays to Fridays from 29 December 1969 up to and including the day."""
    since_monday = F.unix_date(day) + 3
    return (F.floor(since_monday / 7) * 5 + F.least(F.pmod(since_monday, F.lit(7)) + 1, F.lit(5))).cast("int")


def _holiday_indexes(holidays: list[dt.date]) -> list[int]:
    epoch_monday = dt.date(1969, 12, 29)
    found = set()
    for holiday in holidays:
        if holiday.weekday() < 5:
            weeks, rest = divmod((holiday - epoch_monday).days, 7)
            found.add(weeks * 5 + rest + 1)
    return sorted(found)


def networkdays(start: Column, end: Column, holidays: list[dt.date] = ()) -> Column:
    """NETWORKDAYS: weekdays from start to end, both included; negative when reversed."""
    low, high = F.least(start, end), F.greatest(start, end)
    first, last = _weekday_index(F.date_sub(low, 1)), _weekday_index(high)
    days = last - first
    marks = _holiday_indexes(list(holidays))
    if marks:
        off = F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: (m > first) & (m <= last))
        days = days - F.size(off)
    return F.when(start.isNotNull() & end.isNotNull(), F.when(start <= end, days).otherwise(-days))


def workday(start: Column, days: Column | int, holidays: list[dt.date] = ()) -> Column:
    """WORKDAY: the date that many working days away."""
    count = days if isinstance(days, Column) else F.lit(days)
    begin = _weekday_index(start)
    weekend = F.dayofweek(start).isin(1, 7)
    back_from = begin + F.when(weekend, 1).otherwise(0)
    ahead, behind = begin + count, back_from + count
    marks = _holiday_indexes(list(holidays))
    if marks:
        rising = F.array(*[F.lit(m) for m in marks])
        falling = F.array(*[F.lit(m) for m in reversed(marks)])
        ahead = F.aggregate(rising, ahead, lambda at, m: at + F.when((m > begin) & (m <= at), 1).otherwise(0))
        behind = F.aggregate(falling, behind, lambda at, m: at - F.when((m < back_from) & (m >= at), 1).otherwise(0))
    index = F.when(count > 0, ahead).otherwise(behind) - 1
    day_number = F.floor(index / 5) * 7 + F.pmod(index, F.lit(5)) - 3
    return F.when(count == 0, start.cast("date")).otherwise(F.date_from_unix_date(day_number.cast("int")))


def yearfrac(start: Column, end: Column, basis: int = 0) -> Column:
    """YEARFRAC for the five day-count bases."""
    a, b = F.least(start, end), F.greatest(start, end)
    actual = F.datediff(b, a)
    years = F.year(b) - F.year(a)
    if basis in (0, 4):
        day_a, day_b = F.dayofmonth(a), F.dayofmonth(b)
        if basis == 4:
            from_day, to_day = F.least(day_a, F.lit(30)), F.least(day_b, F.lit(30))
        else:
            february_a = (F.month(a) == 2) & (a == F.last_day(a))
            february_b = (F.month(b) == 2) & (b == F.last_day(b))
            to_day = F.when(february_a & february_b, 30).otherwise(day_b)
            from_day = F.when(february_a | (day_a == 31), 30).otherwise(day_a)
            to_day = F.when((to_day == 31) & (from_day == 30), 30).otherwise(to_day)
        return (years * 360 + (F.month(b) - F.month(a)) * 30 + to_day - from_day) / F.lit(360.0)
    if basis in (2, 3):
        return actual / F.lit(360.0 if basis == 2 else 365.0)
    if basis == 1:
        def length(year: Column) -> Column:
            return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
        leap_a = F.make_date(F.year(a), F.lit(3), F.lit(1))
        leap_b = F.make_date(F.year(b), F.lit(3), F.lit(1))
        has_leap_day = (
            ((length(F.year(a)) == 366) & (a < leap_a) & (b >= leap_a))
            | ((length(F.year(b)) == 366) & (a < leap_b) & (b >= leap_b))
        )
        within = F.when(years == 0, length(F.year(a))).otherwise(F.when(has_leap_day, 366).otherwise(365))
        first, after = F.make_date(F.year(a), F.lit(1), F.lit(1)), F.make_date(F.year(b) + 1, F.lit(1), F.lit(1))
        average = F.datediff(after, first) / (years + 1)
        return actual / F.when(b <= F.add_months(a, 12), within).otherwise(average)
    raise UnknownPatternError(f"YEARFRAC basis {basis} is not one of 0 to 4")


def volatile(name: str) -> Column:
    """TODAY, NOW and the like: pass the run date as a parameter instead."""
    raise UnknownPatternError(f"{name} changes on every run; pass its value as a parameter")
