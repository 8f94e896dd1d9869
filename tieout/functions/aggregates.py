"""The aggregate functions spreadsheet formulas use.

Plain column aggregates come first. MODE, LARGE, SMALL, MEDIAN and PERCENTILE need more than one
step to hold up when one group is huge, and live in :mod:`tieout.operators.ranked`.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tieout.functions.cells import parse_plain, strip


def sum_(value: Column) -> Column:
    """SUM: empty cells are ignored."""
    return F.sum(value)


def average(value: Column) -> Column:
    return F.avg(value)


def averagea(value: Column) -> Column:
    """AVERAGEA over text cells: numbers count as they are, TRUE as 1, other text as 0."""
    as_text = F.lower(strip(value.cast("string")))
    number = (F.when(as_text == "true", F.lit(1.0)).when(as_text == "false", F.lit(0.0))
              .otherwise(F.coalesce(parse_plain(as_text), F.lit(0.0))))
    return F.avg(F.when(value.isNotNull(), number))


def count(value: Column) -> Column:
    """COUNT: cells that hold a number."""
    return F.count(parse_plain(strip(value.cast("string"))))


def counta(value: Column) -> Column:
    """COUNTA: cells that hold anything."""
    return F.count(value)


def countblank(value: Column) -> Column:
    """COUNTBLANK: empty cells and empty text."""
    return F.count_if(F.coalesce(value.cast("string"), F.lit("")) == "")


def minimum(value: Column) -> Column:
    return F.min(value)


def maximum(value: Column) -> Column:
    return F.max(value)


def stdev(value: Column) -> Column:
    return F.stddev_samp(value)


def stdevp(value: Column) -> Column:
    return F.stddev_pop(value)


def var(value: Column) -> Column:
    return F.var_samp(value)


def varp(value: Column) -> Column:
    return F.var_pop(value)


def product(value: Column) -> Column:
    return F.product(value)


def sumproduct(a: Column, b: Column, mask: Column | None = None) -> Column:
    """SUMPRODUCT, optionally over the rows a condition picks."""
    pair = a.cast("double") * b.cast("double")
    return F.coalesce(F.sum(pair if mask is None else F.when(mask, pair)), F.lit(0.0))
