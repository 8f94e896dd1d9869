"""Compute an adjustment, hand it over as statements, and verify what came back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tieout.functions.cells import empty_as_zero
from tieout.functions.numeric import round_half_away
from tieout.functions.sqltext import statement_text
from tieout.functions.text import note_text
from tieout.operators.frames import scope
from tieout.operators.status import Tolerance
from tieout.operators.verify import Verification, verify


@dataclass(frozen=True)
class Adjustment:
    """What to change: rows in scope, the amount to uplift and by how much."""

    key: str
    amount: str
    include: dict[str, list]
    exclude: dict[str, object]
    rate: float
    carry: tuple[str, ...] = ()
    note: str | None = None
    note_column: str | None = None
    digits: int = 2


def adjust(df: DataFrame, plan: Adjustment) -> DataFrame:
    """Before, uplift and after per row in scope; an empty amount counts as zero."""
    columns = list(dict.fromkeys([plan.key, *plan.carry, plan.amount, *([plan.note_column] if plan.note_column else [])]))
    rows = scope(df, plan.include, plan.exclude, columns)
    before = empty_as_zero(F.col(plan.amount))
    out = rows.select(
        plan.key, *plan.carry, before.alias("before"),
        round_half_away(before * plan.rate, plan.digits).alias("uplift"),
        round_half_away(before * (1 + plan.rate), plan.digits).alias("after"),
        *([note_text(plan.note, F.col(plan.note_column)).alias("note")] if plan.note else []))
    return out


def totals(adjusted: DataFrame, digits: int = 2) -> DataFrame:
    """Rows and rounded sums, for the person signing off."""
    rounded = lambda name: round_half_away(F.sum(name), digits).alias(name)
    return adjusted.agg(F.count(F.lit(1)).alias("rows"), rounded("before"), rounded("uplift"), rounded("after"))


def with_statements(adjusted: DataFrame, template: str) -> DataFrame:
    return adjusted.withColumn("statement", statement_text(adjusted, template))


def verify_adjustment(adjusted: DataFrame, returned: DataFrame, plan: Adjustment,
                      tolerance: Tolerance = Tolerance()) -> Verification:
    """The returned rows in scope must hold the predicted amounts, key by key."""
    predicted = adjusted.select(plan.key, F.col("after").alias(plan.amount))
    actual = scope(returned, plan.include, plan.exclude, [plan.key, plan.amount])
    return verify(predicted, actual, [plan.key], [plan.amount], tolerance)
