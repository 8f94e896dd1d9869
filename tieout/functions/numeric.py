"""Rounding the way a spreadsheet rounds, and comparing numbers within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tieout.errors import ArgumentError

# The digits accepted, and the size of the 15-digit correction.
MAX_DIGITS = 15
NUDGE_RELATIVE = 1e-15
NUDGE_CEILING = 1e-3

# From here on a double has no fraction left, and floor() would overflow a bigint soon after.
WHOLE_FROM = float(2**52)


def _round_magnitude(value: Column, digits: int, step) -> Column:
    """Scale to whole units, let ``step`` pick the unit count, scale back with the sign."""
    if isinstance(digits, bool) or not isinstance(digits, int):
        raise ArgumentError(f"digits must be a whole number, not {type(digits).__name__}")
    if not -MAX_DIGITS <= digits <= MAX_DIGITS:
        raise ArgumentError(f"digits={digits} lies outside -{MAX_DIGITS}..{MAX_DIGITS}")
    power = F.lit(float(10 ** abs(digits)))
    number = value.cast("double")
    scaled = number * power if digits >= 0 else number / power
    size = F.abs(scaled)
    nudge = F.least(size * NUDGE_RELATIVE, F.lit(NUDGE_CEILING))
    units = F.when(size >= WHOLE_FROM, size).otherwise(step(size, nudge).cast("double"))
    signed = units * F.signum(scaled)
    result = signed / power if digits >= 0 else signed * power
    return F.when(result == 0.0, F.lit(0.0)).otherwise(result)


def round_half_away(value: Column, digits: int = 0) -> Column:
    """ROUND: halves go away from zero, judged on 15 significant digits. Null stays null."""
    return _round_magnitude(value, digits, lambda size, nudge: F.floor(size + nudge + 0.5))


def round_up(value: Column, digits: int = 0) -> Column:
    """ROUNDUP: away from zero."""
    return _round_magnitude(value, digits, lambda size, nudge: F.ceil(size - nudge))


def round_down(value: Column, digits: int = 0) -> Column:
    """ROUNDDOWN: toward zero."""
    return _round_magnitude(value, digits, lambda size, nudge: F.floor(size + nudge))


def to_thousands(value: Column, digits: int = 0) -> Column:
    """The value in thousands, rounded with :func:`round_half_away`."""
    return round_half_away(value.cast("double") / 1000.0, digits)


def is_finite(value: Column) -> Column:
    """True for a number that is neither NaN nor infinite; never null."""
    number = value.cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))


def decimals_retained(value: Column) -> Column:
    """Decimal places shown at 15 significant digits; null where only an exponent would do."""
    number = F.abs(value.cast("double"))
    shown = F.format_string("%.14e", number)
    digits = F.rtrim(F.concat(F.substring(shown, 1, 1), F.substring(shown, 3, 14)), F.lit("0"))
    exponent = F.substring_index(shown, "e", -1).cast("int")
    places = F.greatest(F.length(digits) - 1 - exponent, F.lit(0))
    usable = is_finite(value)
    return (
        F.when(usable & (number == 0.0), F.lit(0))
        .when(usable, F.when((exponent >= -4) & (exponent < 15), places))
    )


def last_digit(value: Column, decimals: Column | int) -> Column:
    """Last of ``decimals`` decimal digits; null at 2^53 units and beyond."""
    places = decimals if isinstance(decimals, Column) else F.lit(decimals)
    units = F.abs(value.cast("double")) * F.pow(F.lit(10.0), places.cast("double"))
    safe = F.when(is_finite(units) & (units < float(2**53)), units)
    return (F.rint(safe).cast("bigint") % 10).cast("int")


def within_tolerance(expected: Column, actual: Column, absolute: float = 1e-6,
                     relative: float = 0.0) -> Column:
    """Whether two finite numbers agree absolutely, or relative to the expected one."""
    if absolute < 0 or relative < 0:
        raise ArgumentError("tolerances cannot be negative")
    want, got = expected.cast("double"), actual.cast("double")
    gap, size = F.abs(got - want), F.abs(want)
    close = (gap <= absolute) | ((size > 0.0) & (gap <= size * relative))
    return is_finite(want) & is_finite(got) & F.coalesce(close, F.lit(False))


def _is_exact(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.IntegralType, T.DecimalType))


def exact_gap(expected: Column, actual: Column, expected_type: T.DataType, actual_type: T.DataType) -> Column:
    """actual - expected as a double: of whole numbers and decimals the exact difference, rounded once."""
    plain = actual.cast("double") - expected.cast("double")
    if not (_is_exact(expected_type) and _is_exact(actual_type)):
        return plain
    scale = max(t.scale if isinstance(t, T.DecimalType) else 0 for t in (expected_type, actual_type))
    want, got = (c.try_cast(f"decimal(38,{scale})") for c in (expected, actual))
    return F.coalesce((got - want).cast("double"), plain)


def numbers_agree(expected: Column, actual: Column, expected_type: T.DataType, actual_type: T.DataType,
                  absolute: float = 1e-6, relative: float = 0.0) -> Column:
    """:func:`within_tolerance`, with the gap between whole numbers or decimals taken exactly."""
    if not (_is_exact(expected_type) and _is_exact(actual_type)):
        return within_tolerance(expected, actual, absolute, relative)
    gap, size = F.abs(exact_gap(expected, actual, expected_type, actual_type)), F.abs(expected.cast("double"))
    return F.coalesce((gap <= absolute) | ((size > 0.0) & (gap <= size * relative)), F.lit(False))


def is_number_type(dtype: T.DataType) -> bool:
    """Numeric, boolean excluded."""
    return isinstance(dtype, T.NumericType)


def is_date_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def micros_of(value: Column) -> Column:
    """Microseconds since 1970 of a date or naive timestamp, free of the session time zone."""
    naive = value.cast("timestamp_ntz")
    seconds = (
        F.unix_date(naive.cast("date")).cast("bigint") * 86400
        + F.hour(naive) * 3600 + F.minute(naive) * 60
    )
    parts = F.date_part(F.lit("SECONDS"), naive) * 1000000
    return seconds * 1000000 + parts.cast("bigint")


def signed_delta(expected: Column, actual: Column, expected_type: T.DataType,
                 actual_type: T.DataType) -> Column:
    """actual - expected: numbers as they are, dates in (fractional) days, anything else null."""
    if is_number_type(expected_type) and is_number_type(actual_type):
        want, got = expected.cast("double"), actual.cast("double")
        gap = exact_gap(expected, actual, expected_type, actual_type)
        return F.when(is_finite(want) & is_finite(got), gap)
    if is_date_type(expected_type) and is_date_type(actual_type):
        return (micros_of(actual) - micros_of(expected)) / F.lit(86_400_000_000.0)
    return F.lit(None).cast("double")
