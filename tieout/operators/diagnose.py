"""Naming the likely cause when numbers differ, from the pattern of all differing rows.

Two aggregations over the mismatches: the first finds how many decimals the expected values keep
and counts each kind of difference, the second tests the rounding patterns at that precision.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tieout.functions.cells import ERROR_LITERALS, PLAIN_NUMBER, strip
from tieout.functions.dates import LAST_SERIAL
from tieout.functions.numeric import decimals_retained, is_finite, last_digit

# Causes, limits and confidences.
MAX_CAUSES = 4
UNIT_SLACK = 0.02
MAX_DECIMALS = 10
CONFIDENCE = {
    "rounding_not_applied": 0.9,
    "rounding_mode_unclear": 0.6,
    "rounding_mode": 0.9,
    "rounding_15_digit_collapse": 0.8,
    "join_matched_nothing": 0.75,
    "divide_by_zero": 0.9,
    "join_key_not_unique": 0.85,
    "date_serial_unconverted": 0.8,
    "date_serial_offset": 0.85,
    "text_formatted_number": 0.85,
}


@dataclass(frozen=True)
class Diagnosis:
    cause: str
    confidence: float
    evidence: str
    remedy: str
    affected_rows: int


def _facts(bad: DataFrame) -> dict:
    kind = F.col("kind")
    numeric = kind.isin("value_differs", "type_differs") & is_finite(F.col("expected_number")) & is_finite(F.col("actual_number"))
    places = F.when(numeric, decimals_retained(F.col("expected_number")))
    day = F.rint("absolute_delta")
    whole_days = ((kind == "value_differs") & F.col("expected_number").isNull() & F.col("absolute_delta").isNotNull()
                  & (F.abs(F.col("absolute_delta") - day) < 1e-9) & day.between(1, 2))
    serial = lambda number, other: F.col(number).between(1, LAST_SERIAL) & F.col(other).isNull()
    text = F.coalesce(F.when(F.col("expected_family") == "string", F.col("expected")),
                      F.when(F.col("actual_family") == "string", F.col("actual")))
    bare = F.regexp_replace(F.regexp_replace(strip(text), "[,£$%]", ""), r"^\((.*)\)$", "$1")
    number_beside = F.coalesce("expected_number", "actual_number").isNotNull()
    text_number = (kind == "type_differs") & number_beside & bare.rlike(PLAIN_NUMBER)
    first_null = F.min_by("expected", F.when(kind == "actual_null", F.col("row")))
    return bad.agg(
        F.count_if(kind != "extra_row").alias("not_extra"),
        F.count_if(numeric).alias("numeric"),
        F.count_if(numeric & places.isNull()).alias("no_places"),
        F.max(places).alias("decimals"),
        F.max(F.when(numeric, F.abs(F.col("actual_number") - F.col("expected_number")))).alias("worst"),
        F.count_if(kind == "actual_null").alias("nulls"), first_null.alias("null_example"),
        F.count_if(kind == "non_finite").alias("non_finite"),
        F.count_if((kind == "excel_error") & F.col("expected").isin("#DIV/0!", "#NUM!")).alias("div_errors"),
        F.count_if(kind == "value_differs").alias("value_differs"),
        F.count_if(kind == "type_differs").alias("type_differs"),
        F.count_if(whole_days).alias("whole_days"),
        F.min(F.when(whole_days, day)).alias("fewest_days"), F.max(F.when(whole_days, day)).alias("most_days"),
        F.count_if((kind == "type_differs") & (serial("expected_number", "actual_number") | serial("actual_number", "expected_number"))).alias("serials"),
        F.count_if(text_number & ~F.coalesce(text.isin(ERROR_LITERALS), F.lit(False))).alias("text_numbers"),
    ).first().asDict()


def _rounding(bad: DataFrame, facts: dict, column: str) -> Diagnosis | None:
    rows, places = facts["numeric"], facts["decimals"]
    if not rows or rows != facts["not_extra"] or facts["no_places"] or places > MAX_DECIMALS:
        return None
    unit = 10.0 ** -places
    if facts["worst"] > unit * (1 + UNIT_SLACK):
        return None
    want, got = F.col("expected_number"), F.col("actual_number")
    gap = F.abs(got - want)
    odd = lambda c: F.coalesce(last_digit(c, places) % 2 == 1, F.lit(False))
    even = lambda c: F.coalesce(last_digit(c, places) % 2 == 0, F.lit(False))
    seen = bad.where(F.col("kind") != "extra_row").agg(
        F.bool_and(F.coalesce(decimals_retained(got), F.lit(0)) > places).alias("longer"),
        F.bool_and(gap <= unit * 0.5 * (1 + UNIT_SLACK)).alias("half_unit"),
        F.bool_and(gap >= unit * (1 - UNIT_SLACK)).alias("one_unit"),
        F.bool_and((F.abs(want) > F.abs(got)) & odd(want) & even(got)).alias("tie"),
        F.min_by(F.struct("row", "expected", "actual"), F.when(even(want), F.col("row"))).alias("witness"),
        F.min_by(F.struct("row", "expected", "actual"), "row").alias("first"),
    ).first()
    use = f"round_half_away(F.col({column!r}), {places})"
    scale = f"{places} decimal(s), {rows:,} row(s), worst {facts['worst']:g}"
    if seen["longer"] and seen["half_unit"]:
        return Diagnosis("rounding_not_applied", CONFIDENCE["rounding_not_applied"],
                         f"actual values keep more decimals and stay within half a unit: {scale}", f"apply {use}", rows)
    if not seen["one_unit"]:
        return Diagnosis("rounding_mode", CONFIDENCE["rounding_mode_unclear"],
                         f"within one unit of the last place: {scale}", f"round with {use}, each term where the sheet rounds it", rows)
    if seen["tie"]:
        return Diagnosis("rounding_mode", CONFIDENCE["rounding_mode"],
                         f"one unit apart, odd against even last digits, as half-to-even gives: {scale}", f"use {use}", rows)
    witness = seen["witness"] or seen["first"]
    return Diagnosis("rounding_15_digit_collapse", CONFIDENCE["rounding_15_digit_collapse"],
                     f"one unit apart but no tie, see row {witness['row']}: {witness['expected']} against {witness['actual']}",
                     f"use {use}, which judges 15 significant digits", rows)


def diagnose(cells: DataFrame, rows_compared: int, rows_expected: int = 0, rows_actual: int = 0,
             column: str = "value", limit: int = MAX_CAUSES) -> list[Diagnosis]:
    """Likely causes, most confident first. Empty when no known pattern fits."""
    bad = cells.where(F.col("kind").isNotNull())
    facts = _facts(bad)
    found = []
    rounding = _rounding(bad, facts, column)
    if rounding:
        found.append(rounding)
    nulls = facts["nulls"]
    if nulls:
        share = nulls / rows_compared if rows_compared else 1.0
        seen = f"{nulls:,} of {rows_compared:,} rows are empty where {facts['null_example']} and the like were expected"
        if share >= 0.9:
            found.append(Diagnosis("text_formatted_number", CONFIDENCE["join_matched_nothing"], seen,
                                   "a join matched nothing: bring both keys to one type with to_number()", nulls))
        found.append(Diagnosis("null_vs_empty", 0.55 if share >= 0.9 else min(0.85, 0.5 + share), seen,
                               "use add(), empty_as_zero() or sum_horizontal()", nulls))
    bad_division = facts["non_finite"] + facts["div_errors"]
    if bad_division:
        found.append(Diagnosis("divide_by_zero", CONFIDENCE["divide_by_zero"],
                               f"{facts['non_finite']:,} not finite, {facts['div_errors']:,} expected division errors",
                               "divide with div()", bad_division))
    if rows_actual > rows_expected > 0:
        found.append(Diagnosis("join_key_not_unique", CONFIDENCE["join_key_not_unique"],
                               f"{rows_actual:,} rows where {rows_expected:,} were expected",
                               "use lookup_first() or assert_unique_key() on the lookup table", rows_actual - rows_expected))
    if facts["serials"] and facts["serials"] == facts["type_differs"]:
        found.append(Diagnosis("date_serial_offset", CONFIDENCE["date_serial_unconverted"],
                               f"{facts['serials']:,} rows pair a date serial with a date", "convert with serial_to_date()", facts["serials"]))
    elif facts["whole_days"] and facts["whole_days"] == facts["value_differs"] and facts["fewest_days"] == facts["most_days"]:
        found.append(Diagnosis("date_serial_offset", CONFIDENCE["date_serial_offset"],
                               f"all {facts['whole_days']:,} dates are {int(facts['most_days'])} day(s) apart",
                               "convert with serial_to_date()", facts["whole_days"]))
    if facts["text_numbers"] and not any(d.cause == "text_formatted_number" for d in found):
        found.append(Diagnosis("text_formatted_number", CONFIDENCE["text_formatted_number"],
                               f"{facts['text_numbers']:,} rows differ in type only", "normalise with to_number()", facts["text_numbers"]))
    return sorted(found, key=lambda d: (-d.confidence, d.cause))[:limit]
