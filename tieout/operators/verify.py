"""Keyed verification: does a delivery hold what was predicted, row for row?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tieout.functions.numeric import is_number_type, numbers_agree, signed_delta
from tieout.naming import col as _col
from tieout.operators.status import Status, Tolerance
from tieout.session import cut_lineage

SHOWN = 50


@dataclass
class Verification:
    """Exact counts, and DataFrames of all breaks, missing and unexpected keys."""

    status: Status
    keys: list[str]
    compared_columns: list[str]
    reason: str | None = None
    rows_predicted: int = 0
    rows_actual: int = 0
    matched: int = 0
    break_count: int = 0
    missing_count: int = 0
    unexpected_count: int = 0
    breaks: DataFrame | None = None
    missing: DataFrame | None = None
    unexpected: DataFrame | None = None
    tolerance: Tolerance = Tolerance()

    def __bool__(self) -> bool:
        return bool(self.status)

    def summary_line(self) -> str:
        if self.status is Status.NOT_RECONCILED:
            return f"Not verified: {self.reason}"
        if self:
            return f"Verified: all {self.matched:,} rows match within {self.tolerance.describe()}"
        return (f"Not verified: {self.matched:,} of {self.rows_predicted:,} rows match, {self.break_count:,} value(s) differ, "
                f"{self.missing_count:,} missing, {self.unexpected_count:,} unexpected")

    def shown_breaks(self, count: int = SHOWN) -> list:
        return self.breaks.orderBy(*self.keys, "column").limit(count).collect() if self.breaks is not None else []


def _disagrees(want: Column, got: Column, want_type: T.DataType, got_type: T.DataType, tolerance: Tolerance) -> Column:
    if is_number_type(want_type) and is_number_type(got_type):
        agree = numbers_agree(want, got, want_type, got_type, tolerance.absolute, tolerance.relative)
    elif type(want_type) is type(got_type):
        agree = want == got
    else:
        agree = F.lit(False)
    return F.when(want.isNull() & got.isNull(), False).when(want.isNull() | got.isNull(), True).otherwise(~agree)


def matched_rows(predicted: DataFrame, actual: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Both sides by key: values in ``__p0``.. and ``__a0``.., rows per key in ``__np`` and ``__na``.

    Each side is grouped by key first. That finds repeated keys, combines a key that fills much of
    the table before it is shuffled, and leaves the join on the partitioning the grouping made.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        values = [F.first(_col(c)).alias(f"__{tag}{i}") for i, c in enumerate(columns)]
        return df.groupBy(*[_col(k) for k in keys]).agg(F.count(F.lit(1)).alias(f"__n{tag}"), *values)
    return side(predicted, "p").join(side(actual, "a"), keys, "full")


def row_breaks(matched: DataFrame, keys: list[str], columns: list[str], types: list[tuple], tolerance: Tolerance) -> DataFrame:
    """One row per differing value of rows both sides hold."""
    items, any_break = [], F.lit(False)
    for i, (name, (want_type, got_type)) in enumerate(zip(columns, types)):
        want, got = F.col(f"__p{i}"), F.col(f"__a{i}")
        broken = _disagrees(want, got, want_type, got_type, tolerance)
        any_break = any_break | broken
        items.append(F.when(broken, F.struct(
            F.lit(name).alias("column"), want.cast("string").alias("predicted"), got.cast("string").alias("actual"),
            signed_delta(want, got, want_type, got_type).alias("delta"))))
    both = matched.where(F.col("__np").isNotNull() & F.col("__na").isNotNull() & any_break)
    return both.select(*[_col(k) for k in keys], F.inline(F.array_compact(F.array(*items))))


def verify(predicted: DataFrame, actual: DataFrame, keys: list[str], columns: list[str] | None = None,
           tolerance: Tolerance = Tolerance()) -> Verification:
    """Compare a prediction with what came back, by key, with one join.

    Whatever cannot be compared at all (no keys, a key absent, an empty side, repeated keys, no
    common value column) is NOT_RECONCILED with a reason, never a pass.
    """
    keys = list(keys)
    def refused(reason: str, **facts) -> Verification:
        return Verification(Status.NOT_RECONCILED, keys, [], reason, tolerance=tolerance, **facts)
    if not keys:
        return refused("no key columns were given")
    for label, df in (("prediction", predicted), ("delivery", actual)):
        absent = [k for k in keys if k not in df.columns]
        if absent:
            return refused(f"the {label} has no column {', '.join(absent)}")
    if columns is not None:
        chosen = [c for c in columns if c not in keys]
        unknown = [c for c in chosen if c not in predicted.columns or c not in actual.columns]
        if unknown:
            return refused(f"not on both sides: {', '.join(unknown)}")
    else:
        chosen = [c for c in predicted.columns if c in actual.columns and c not in keys]
    if not chosen:
        return refused("the two sides share no value column")
    types = [(predicted.schema[c].dataType, actual.schema[c].dataType) for c in chosen]
    # Joined once, into the checkpoint folder: the counters and the three frames of the report read it from there.
    matched = cut_lineage(matched_rows(predicted, actual, keys, chosen))
    broken = F.lit(0)
    for i, (want_type, got_type) in enumerate(types):
        broken = broken + _disagrees(F.col(f"__p{i}"), F.col(f"__a{i}"), want_type, got_type, tolerance).cast("int")
    here, there = F.col("__np").isNotNull(), F.col("__na").isNotNull()
    counted = matched.agg(
        F.coalesce(F.sum("__np"), F.lit(0)).alias("predicted"), F.coalesce(F.sum("__na"), F.lit(0)).alias("actual"),
        F.coalesce(F.sum(F.col("__np") - 1), F.lit(0)).alias("repeated_predicted"),
        F.coalesce(F.sum(F.col("__na") - 1), F.lit(0)).alias("repeated_actual"),
        F.count_if(here & there & (broken == 0)).alias("matched"),
        F.coalesce(F.sum(F.when(here & there, broken)), F.lit(0)).alias("breaks"),
        F.count_if(here & ~there).alias("missing"), F.count_if(~here & there).alias("unexpected"),
    ).first()
    facts = {"rows_predicted": counted["predicted"], "rows_actual": counted["actual"]}
    for label in ("predicted", "actual"):
        side = "prediction" if label == "predicted" else "delivery"
        if counted[label] == 0:
            return refused(f"the {side} is empty", **facts)
        if counted[f"repeated_{label}"]:
            return refused(f"the {side} repeats {counted[f'repeated_{label}']:,} key(s) on {', '.join(keys)}", **facts)
    clean = not (counted["breaks"] or counted["missing"] or counted["unexpected"]) and counted["matched"] > 0
    key_columns = [_col(k) for k in keys]
    return Verification(
        Status.PASSED if clean else Status.FAILED, keys, chosen, None, matched=counted["matched"],
        break_count=counted["breaks"], missing_count=counted["missing"], unexpected_count=counted["unexpected"],
        breaks=row_breaks(matched, keys, chosen, types, tolerance),
        missing=matched.where(here & ~there).select(*key_columns),
        unexpected=matched.where(~here & there).select(*key_columns), tolerance=tolerance, **facts)
