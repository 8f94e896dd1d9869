"""What each formula shape means on a whole column or table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieout.errors import ArgumentError, UnknownPatternError
from tieout.functions import aggregates, cells, sheet
from tieout.operators import lookups, ordered


def if_simple(condition: Column, then: Column, otherwise: Column) -> Column:
    """IF: an empty condition counts as false."""
    return F.when(condition, then).otherwise(otherwise)


def if_nested(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """IF chains and IFS: the first true branch wins. Without a default a miss is null (error)."""
    if not branches:
        raise ArgumentError("a nested IF needs at least one branch")
    result = F.when(*branches[0])
    for condition, outcome in branches[1:]:
        result = result.when(condition, outcome)
    return result if otherwise is None else result.otherwise(otherwise)


def sumif(condition: Column, value: Column) -> Column:
    """SUMIF with one condition over the whole column."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def averageif(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def countif(condition: Column) -> Column:
    return F.count_if(condition)


def parameter_value(parameters: DataFrame, name: str, name_column: str = "parameter",
                    value_column: str = "value") -> Column:
    """A single cell of a parameter table as a constant column. It must be there exactly once."""
    found = parameters.where(F.col(name_column) == name).select(value_column).limit(2).collect()
    if len(found) != 1:
        raise ArgumentError(f"parameter {name!r} is {'absent' if not found else 'given more than once'}")
    return F.lit(found[0][0]).cast(parameters.schema[value_column].dataType)


def subtotal(df: DataFrame, visible: Column, totals: dict[str, Column]) -> DataFrame:
    """SUBTOTAL: aggregate the visible rows only."""
    return df.where(visible).agg(*[total.alias(name) for name, total in totals.items()])


def pivot(df: DataFrame, rows: list[str], column: str, values: list, measure: Column,
          names: list[str] | None = None) -> DataFrame:
    """A wide aggregate. The column's values are named up front, so no extra pass looks for them."""
    if not values:
        raise ArgumentError("name the values that become columns")
    wide = df.groupBy(*rows).pivot(column, list(values)).agg(measure)
    return wide.toDF(*rows, *(names or [str(v) for v in values]))


def map_strict(value: Column, mapping: dict, dtype: str = "string") -> Column:
    """Dictionary mapping in which an unmapped value is an error. Null stays null."""
    if not mapping:
        raise ArgumentError("an empty mapping maps nothing")
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    found = F.try_element_at(F.create_map(*pairs), value)
    refuse = F.raise_error(F.concat(F.lit("no mapping for "), value.cast("string"))).cast(dtype)
    return F.when(value.isNull(), F.lit(None)).when(found.isNotNull(), found.cast(dtype)).otherwise(refuse)


# The shapes a formula region can take, with the operator that stands for each.
PATTERNS = {
    "arithmetic": (cells.add, cells.sub, cells.mul, cells.div, cells.sum_horizontal),
    "if_simple": (if_simple,),
    "if_nested": (if_nested,),
    "iferror": (cells.iferror,),
    "sumif": (sumif, averageif),
    "sumifs": (lookups.sumifs, lookups.averageifs),
    "countif": (countif, lookups.countifs),
    "vlookup_exact": (lookups.lookup_first,),
    "vlookup_approx": (lookups.lookup_nearest,),
    "index_match": (lookups.lookup_first,),
    "sumproduct": (aggregates.sumproduct,),
    "running_total": (ordered.running_total,),
    "prior_row": (ordered.prior_row,),
    "parameter_ref": (parameter_value,),
    "aggregate": (aggregates.sum_, aggregates.average, aggregates.count, aggregates.counta),
    "text_manipulation": (sheet.concatenate, sheet.trim, sheet.mid, sheet.substitute),
    "date_arithmetic": (sheet.date, sheet.eomonth, sheet.edate, sheet.datedif),
    "subtotal": (subtotal,),
    "literal": (F.lit,),
    "pivot": (pivot,),
}


def operators_for(pattern: str) -> tuple:
    """The operators standing for a formula shape; an unknown shape is refused, never guessed."""
    if pattern not in PATTERNS:
        raise UnknownPatternError(f"formula shape {pattern!r} has no defined column meaning")
    return PATTERNS[pattern]


# Function names with a column meaning.
FUNCTIONS = {
    "CONCATENATE": sheet.concatenate, "CONCAT": sheet.concatenate, "TEXTJOIN": sheet.textjoin,
    "LEFT": sheet.left, "RIGHT": sheet.right, "MID": sheet.mid, "TRIM": sheet.trim,
    "UPPER": F.upper, "LOWER": F.lower, "PROPER": sheet.proper, "TEXT": sheet.text,
    "SUBSTITUTE": sheet.substitute, "REPLACE": sheet.replace, "REPT": sheet.rept, "LEN": F.length,
    "FIND": sheet.find, "SEARCH": sheet.search, "VALUE": sheet.value, "CLEAN": sheet.clean,
    "DATE": sheet.date, "DATEVALUE": sheet.datevalue, "YEAR": F.year, "MONTH": F.month,
    "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second,
    "EOMONTH": sheet.eomonth, "EDATE": sheet.edate, "DATEDIF": sheet.datedif,
    "WEEKDAY": sheet.weekday, "WEEKNUM": sheet.weeknum, "WORKDAY": sheet.workday,
    "NETWORKDAYS": sheet.networkdays, "YEARFRAC": sheet.yearfrac,
    "SUM": aggregates.sum_, "AVERAGE": aggregates.average, "AVERAGEA": aggregates.averagea,
    "MIN": aggregates.minimum, "MAX": aggregates.maximum, "COUNT": aggregates.count,
    "COUNTA": aggregates.counta, "COUNTBLANK": aggregates.countblank, "PRODUCT": aggregates.product,
    "STDEV": aggregates.stdev, "STDEV.S": aggregates.stdev, "STDEV.P": aggregates.stdevp,
    "STDEVP": aggregates.stdevp, "VAR": aggregates.var, "VARP": aggregates.varp,
}


def function_for(name: str):
    """The column function behind a spreadsheet function name; volatile and unknown are refused."""
    upper = name.upper()
    if upper in sheet.VOLATILE:
        return sheet.volatile(upper)
    if upper not in FUNCTIONS:
        raise UnknownPatternError(f"function {name!r} has no defined column meaning")
    return FUNCTIONS[upper]
