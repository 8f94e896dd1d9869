"""Arithmetic with empty cells, error values and numbers that arrived as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tieout.errors import ArgumentError

# The error literals a spreadsheet shows in a cell.
ERROR_LITERALS = [
    "#CALC!",
    "#DIV/0!",
    "#GETTING_DATA",
    "#N/A",
    "#NAME?",
    "#NULL!",
    "#NUM!",
    "#REF!",
    "#SPILL!",
    "#VALUE!",
]

# A number as people write it. Java would also accept "1d", "NaN" and "Infinity".
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Every character Unicode counts as white space, the no-break spaces included.
SPACES = ("\t\n\x0b\x0c\r \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
          + "\u2028\u2029\u202f\u205f\u3000")
# What a displayed number may carry beside its digits.
NUMBER_CLUTTER = SPACES + ",$£€¥"

Operand = Column | int | float


def _operand(value: Operand) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ArgumentError(f"an operand is a column or a number, not {type(value).__name__}")
    return F.lit(value)


def strip(value: Column) -> Column:
    """Trim every kind of white space, the no-break space included."""
    return F.btrim(value, F.lit(SPACES))


def empty_as_zero(value: Column) -> Column:
    """Null counts as 0. Text that is no number raises (ANSI cast)."""
    return F.coalesce(value.cast("double"), F.lit(0.0))


def add(a: Operand, b: Operand) -> Column:
    return empty_as_zero(_operand(a)) + empty_as_zero(_operand(b))


def sub(a: Operand, b: Operand) -> Column:
    return empty_as_zero(_operand(a)) - empty_as_zero(_operand(b))


def mul(a: Operand, b: Operand) -> Column:
    return empty_as_zero(_operand(a)) * empty_as_zero(_operand(b))


def div(numerator: Operand, denominator: Operand) -> Column:
    """Null over an empty, zero or NaN denominator; an empty numerator is 0."""
    below = _operand(denominator).cast("double")
    usable = F.when((below != 0.0) & ~F.isnan(below), below)
    return empty_as_zero(_operand(numerator)) / usable


def sum_horizontal(*columns: Column | str) -> Column:
    """Row-wise sum that skips empty cells; all empty gives 0."""
    total = F.lit(0.0)
    for column in columns:
        total = total + empty_as_zero(F.col(column) if isinstance(column, str) else column)
    return total


def parse_plain(text: Column) -> Column:
    """Double for text in plain number form, null for the rest."""
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def to_number(value: Column) -> Column:
    """Read a displayed number: ``(1,234.50)``, ``£12``, ``4.5%``, ``1e3``; else null."""
    text = strip(value.cast("string"))
    negative = text.startswith("(") & text.endswith(")")
    inner = F.when(negative, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    percent = inner.endswith("%")
    body = F.when(percent, F.substring(inner, F.lit(1), F.length(inner) - 1)).otherwise(inner)
    number = parse_plain(F.translate(body, NUMBER_CLUTTER, ""))
    number = F.when(percent, number / 100.0).otherwise(number)
    return F.when(negative, -number).otherwise(number)


def is_error(value: Column) -> Column:
    """Null, NaN, infinite, or text that is no number. Never null itself."""
    # typeof folds to a constant, so a numeric column never goes through its text.
    number = F.when(F.typeof(value) == "string", parse_plain(value.cast("string"))).otherwise(
        value.try_cast("double"))
    return number.isNull() | F.coalesce(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(True))


def iferror(value: Column, fallback: Column | int | float | str | None) -> Column:
    """``fallback`` where :func:`is_error`; a plain string is taken as text."""
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(is_error(value), other).otherwise(value)


def error_text_to_null(value: Column) -> Column:
    """Null for a spreadsheet error literal."""
    return F.when(~F.coalesce(value.isin(ERROR_LITERALS), F.lit(False)), value)
