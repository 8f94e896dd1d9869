"""Column functions. Everything here maps columns to columns and stays in the JVM."""

from tieout.functions.cells import (
    add, div, empty_as_zero, error_text_to_null, iferror, is_error, mul, sub, sum_horizontal,
    to_number,
)
from tieout.functions.dates import date_to_serial, serial_to_date, serial_to_datetime, to_naive_utc
from tieout.functions.numeric import (
    decimals_retained, last_digit, round_down, round_half_away, round_up, signed_delta,
    to_thousands, within_tolerance,
)
from tieout.functions.sqltext import render_statements, sql_literal
from tieout.functions.text import (
    date_text_layout, hash_value, looks_numeric, mask_secrets, note_text, numeric_text_shape,
    value_kind,
)

__all__ = [
    "add", "date_text_layout", "date_to_serial", "decimals_retained", "div", "empty_as_zero",
    "error_text_to_null", "hash_value", "iferror", "is_error", "last_digit", "looks_numeric",
    "mask_secrets", "mul", "note_text", "numeric_text_shape", "render_statements", "round_down",
    "round_half_away", "round_up", "serial_to_date", "serial_to_datetime", "signed_delta",
    "sql_literal", "sub", "sum_horizontal", "to_naive_utc", "to_number", "to_thousands",
    "value_kind", "within_tolerance",
]
