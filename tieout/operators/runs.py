"""Compressing cells that follow one pattern into runs, and finding what breaks a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieout.naming import col as _col
from tieout.operators.ordered import HOT, SLICE, add_prior, add_running, sliced

# Rows a run may skip, and typed-over values that make an override block.
GAP = 3
OVERRIDE_BLOCK = 3


def number_runs(df: DataFrame, partition: list[str], pattern: str, position: str, gap: int = GAP) -> DataFrame:
    """Each patterned cell with ``run``, counting from 1 within (partition, pattern), and ``prior``."""
    cells = df.where(_col(pattern).isNotNull())
    base = add_prior(sliced(cells, [*partition, pattern], [position]), {"prior": position})
    starts = F.when(F.col("prior").isNull() | (_col(position) - F.col("prior") > gap), 1).otherwise(0)
    return add_running(base, starts.cast("bigint"), "run").df.drop(SLICE, HOT)


def compress_runs(df: DataFrame, partition: list[str], pattern: str, position: str, gap: int = GAP) -> DataFrame:
    """One row per run: anchor, end and number of cells. Cells up to ``gap`` apart belong together."""
    numbered = number_runs(df, partition, pattern, position, gap)
    return numbered.groupBy(*[_col(c) for c in partition], _col(pattern), "run").agg(
        F.min(_col(position)).alias("anchor"), F.max(_col(position)).alias("last"), F.count(F.lit(1)).alias("cells"))


def find_breaks(df: DataFrame, partition: list[str], pattern: str, position: str, value: str, gap: int = GAP) -> DataFrame:
    """Cells standing inside a run without following its pattern; blank cells do not count.

    A cell is inside a run when it lies between two neighbouring cells of that run. Neighbours are
    at most ``gap`` apart, so the positions between them are few, and one equi-join finds the cells.
    """
    numbered = number_runs(df, partition, pattern, position, gap)
    holes = numbered.where(_col(position) - F.col("prior") <= gap).where(_col(position) - F.col("prior") > 1).select(
        *[_col(c) for c in partition], _col(pattern).alias("expected_pattern"), "run",
        F.explode(F.sequence(F.col("prior") + 1, _col(position) - 1)).alias(position))
    filled = df.where(_col(pattern).isNotNull() | _col(value).isNotNull()).select(
        *[_col(c) for c in partition], _col(position), _col(pattern).alias("actual_pattern"), _col(value).alias("actual_value"))
    return holes.join(filled, [*partition, position])


def override_blocks(breaks: DataFrame, partition: list[str], at_least: int = OVERRIDE_BLOCK) -> DataFrame:
    """Runs in which that many cells were typed over with bare values."""
    typed = breaks.where(F.col("actual_pattern").isNull())
    return typed.groupBy(*[_col(c) for c in partition], "expected_pattern", "run").agg(
        F.count(F.lit(1)).alias("typed_over")).where(F.col("typed_over") >= at_least)
