"""Row-order operators that survive one group holding a large part of the table.

A window over a group puts that group into one task. Groups above a row threshold are therefore
cut into slices along their order; the window runs per slice, and what a slice needs from the rows
before it is taken from one summary row per earlier slice. Groups below the threshold keep slice 0
and cost nothing extra.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tieout.errors import ArgumentError
from tieout.naming import col as _col

HOT_ROWS_SETTING = "spark.tieout.hotRows"
HOT_ROWS = 2_000_000
# Upper bound on groups cut and on slices made, hence on everything broadcast here.
MAX_SLICES = 1 << 17
POINTS_PER_SLICE = 16

SLICE, HOT = "__slice", "__hot"


@dataclass
class Sliced:
    """A frame with its slice column, and whether any group had to be cut."""

    df: DataFrame
    group: list[str]
    order: list[str]
    cut: bool

    def window(self):
        return Window.partitionBy(*[_col(c) for c in self.group], F.col(SLICE)).orderBy(
            *[_col(c) for c in self.order])

    def carried(self, per_slice: Column, over_earlier) -> DataFrame:
        """One row per slice of a cut group, with what the slices before it amount to."""
        summary = (
            self.df.where(F.col(HOT))
            .groupBy(*[_col(c) for c in self.group], F.col(SLICE))
            .agg(per_slice.alias("__own"))
        )
        across = Window.partitionBy(*[_col(c) for c in self.group]).orderBy(SLICE)
        return summary.withColumn("__carry", over_earlier(F.col("__own"), across)).drop("__own")

    def with_carry(self, framed: DataFrame, carried: DataFrame) -> DataFrame:
        # At most MAX_SLICES plus one row per cut group: small enough to send everywhere.
        names = {c: f"__k{i}" for i, c in enumerate([*self.group, SLICE])}
        right = F.broadcast(carried.select(
            *[_col(c).alias(k) for c, k in names.items()], F.col("__carry")))
        match = F.lit(True)
        for c, k in names.items():
            match = match & _col(c).eqNullSafe(F.col(k))
        return framed.join(right, match, "left").drop(*names.values())


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))


def hot_groups(df: DataFrame, group: list[str]) -> list:
    """The groups above the threshold, largest first. One count with map-side combine."""
    counted = df.groupBy(*[_col(c) for c in group]).agg(F.count(F.lit(1)).alias("__n"))
    return (counted.where(F.col("__n") > hot_rows(df)).orderBy(F.desc("__n"))
            .limit(MAX_SLICES).collect())


def _bounds(df: DataFrame, group: list[str], order: list[str], hot: list) -> DataFrame:
    """Cut points of every large group, from a hash-chosen sample of its order values."""
    spark = df.sparkSession
    rows_per_slice = max(hot_rows(df), math.ceil(sum(r["__n"] for r in hot) / MAX_SLICES))
    stride = max(1, rows_per_slice // POINTS_PER_SLICE)
    fields = [df.schema[c] for c in group]
    named = [T.StructField(f"__k{i}", f.dataType, True) for i, f in enumerate(fields)]
    large = spark.createDataFrame([tuple(r[c] for c in group) + (1,) for r in hot],
                                  T.StructType([*named, T.StructField("__one", T.IntegerType())]))
    match = F.lit(True)
    for i, c in enumerate(group):
        match = match & _col(c).eqNullSafe(F.col(f"__k{i}"))
    keys = [f"__k{i}" for i in range(len(group))]
    points = (
        df.join(F.broadcast(large), match)
        .where(F.pmod(F.xxhash64(*[_col(c) for c in order]), F.lit(stride)) == 0)
        .select(*keys, F.struct(*[_col(c) for c in order]).alias("__point"))
        .distinct()
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("__point")).alias("__points"))
    )
    cuts = F.filter("__points", lambda p, i: i % POINTS_PER_SLICE == POINTS_PER_SLICE - 1)
    found = points.select(*keys, cuts.alias("__cuts")).where(F.size("__cuts") > 0).collect()
    nested = []
    for row in found:
        step = max(1, math.isqrt(len(row["__cuts"])))
        chunks = [row["__cuts"][i:i + step] for i in range(0, len(row["__cuts"]), step)]
        nested.append(tuple(row[k] for k in keys) + (chunks, step))
    point_type = T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in order])
    schema = T.StructType([*named,
                           T.StructField("__chunks", T.ArrayType(T.ArrayType(point_type))),
                           T.StructField("__step", T.IntegerType())])
    return spark.createDataFrame(nested, schema)


def slice_position(chunks: Column, step: Column, key: Column) -> Column:
    """How many cut points lie at or below the key: pick the chunk, then the place within."""
    chunk = F.size(F.filter(chunks, lambda c: c[0] <= key))
    inside = F.size(F.filter(F.element_at(chunks, F.greatest(chunk, F.lit(1))), lambda p: p <= key))
    return F.when(chunk == 0, F.lit(0)).otherwise((chunk - 1) * step + inside)


def sliced(df: DataFrame, group: list[str], order: list[str]) -> Sliced:
    """Attach the slice column. ``order`` must settle the order of rows within a group."""
    if not order:
        raise ArgumentError("rows of a DataFrame have no order of their own: name order columns")
    hot = hot_groups(df, group)
    bounds = _bounds(df, group, order, hot) if hot else None
    if bounds is None or not bounds.take(1):
        plain = df.withColumns({SLICE: F.lit(0), HOT: F.lit(False)})
        return Sliced(plain, group, order, cut=False)
    match = F.lit(True)
    for i, c in enumerate(group):
        match = match & _col(c).eqNullSafe(F.col(f"__k{i}"))
    key = F.struct(*[_col(c) for c in order])
    placed = (
        # One row per cut group, at most MAX_SLICES cut points in all.
        df.join(F.broadcast(bounds), match, "left")
        .withColumn(HOT, F.col("__chunks").isNotNull())
        .withColumn(SLICE, F.when(F.col(HOT), slice_position(F.col("__chunks"), F.col("__step"), key))
                    .otherwise(F.lit(0)))
        .drop("__chunks", "__step", *[f"__k{i}" for i in range(len(group))])
    )
    return Sliced(placed, group, order, cut=True)


def add_running(base: Sliced, value: Column, into: str) -> Sliced:
    """Cumulative sum over the rows of each group, as a column of the sliced frame."""
    upto = base.window().rowsBetween(Window.unboundedPreceding, 0)
    out = base.df.withColumn("__v", value)
    out = out.withColumn(into, F.coalesce(F.sum("__v").over(upto), F.lit(0)))
    if base.cut:
        carried = Sliced(out, base.group, base.order, True).carried(
            F.sum("__v"), lambda own, w: F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        out = base.with_carry(out, carried)
        out = out.withColumn(into, _col(into) + F.coalesce(F.col("__carry"), F.lit(0))).drop("__carry")
    return Sliced(out.drop("__v"), base.group, base.order, base.cut)


def add_prior(base: Sliced, columns: dict[str, str]) -> Sliced:
    """Values of the row above, as columns of the sliced frame."""
    above = F.struct(*[_col(source).alias(new) for new, source in columns.items()])
    out = base.df.withColumn("__above", F.lag(above).over(base.window()))
    if base.cut:
        out = out.withColumn("__first", F.row_number().over(base.window()) == 1)
        place = F.struct(*[_col(c) for c in base.order])
        carried = base.carried(F.max_by(above, place), lambda own, w: F.lag(own).over(w))
        out = base.with_carry(out, carried)
        out = out.withColumn("__above", F.when(F.col("__first") & F.col(HOT), F.col("__carry"))
                             .otherwise(F.col("__above"))).drop("__carry", "__first")
    out = out.withColumns({new: F.col("__above")[new] for new in columns}).drop("__above")
    return Sliced(out, base.group, base.order, base.cut)


def running_total(df: DataFrame, group: list[str], order: list[str], value: Column | str,
                  into: str = "running_total") -> DataFrame:
    """Cumulative sum in row order within each group, empty cells as zero."""
    amount = _col(value) if isinstance(value, str) else value
    return add_running(sliced(df, group, order), amount, into).df.drop(SLICE, HOT)


def row_rank(df: DataFrame, group: list[str], order: list[str], into: str = "rank") -> DataFrame:
    """1-based position of each row within its group."""
    return running_total(df, group, order, F.lit(1).cast("bigint"), into)


def prior_row(df: DataFrame, group: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Values of the row above, as ``{new column: source column}``."""
    return add_prior(sliced(df, group, order), columns).df.drop(SLICE, HOT)


def fill_forward(df: DataFrame, group: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """Latest non-null ``value`` at or above each row."""
    base = sliced(df, group, order)
    upto = base.window().rowsBetween(Window.unboundedPreceding, 0)
    out = base.df.withColumn("__local", F.last(_col(value), ignorenulls=True).over(upto))
    if base.cut:
        place = F.struct(*[_col(c) for c in order])
        latest = F.max_by(_col(value), F.when(_col(value).isNotNull(), place))
        carried = base.carried(
            latest,
            lambda own, w: F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        out = base.with_carry(out, carried)
        return out.withColumn(into, F.coalesce("__local", "__carry")).drop("__local", "__carry", SLICE, HOT)
    return out.withColumn(into, F.col("__local")).drop("__local", SLICE, HOT)
