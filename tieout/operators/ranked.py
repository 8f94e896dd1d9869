"""Aggregates that depend on ranks or frequencies, safe for very large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieout.errors import ArgumentError
from tieout.naming import col as _col
from tieout.operators.ordered import running_total


def _keys(group: list[str]) -> list[Column]:
    return [_col(c) for c in group]


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rows per group and non-null value as ``__value``, ``__n``."""
    return (df.where(_col(value).isNotNull())
            .groupBy(*_keys(group), _col(value).alias("__value"))
            .agg(F.count(F.lit(1)).alias("__n")))


def mode_by(df: DataFrame, group: list[str], value: str, into: str = "mode") -> DataFrame:
    """MODE: the most frequent value of each group; the smallest one wins a tie."""
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__value").alias("v")))
    return value_counts(df, group, value).groupBy(*_keys(group)).agg(best["v"].alias(into))


#: Up to this rank Spark limits the rows of a group before it shuffles them.
FEW_RANKS = 1000


def kth_value(df: DataFrame, group: list[str], value: str, k: int, largest: bool = True,
              into: str = "kth") -> DataFrame:
    """LARGE and SMALL. For small k Spark keeps only k rows per group and task before the shuffle; for
    others the values are counted and the counts added up, so no group is sorted in one task."""
    if k < 1:
        raise ArgumentError("k counts from 1")
    if k > FEW_RANKS:
        counts = value_counts(df, group, value)
        place = "__place"
        if largest:
            total = counts.groupBy(*_keys(group)).agg(F.sum("__n").alias("__rows"))
            names = {c: f"__g{i}" for i, c in enumerate(group)}
            total = total.select(*[_col(c).alias(n) for c, n in names.items()], "__rows")
            match = F.lit(True)
            for c, n in names.items():
                match = match & _col(c).eqNullSafe(F.col(n))
            upto = running_total(counts, group, ["__value"], "__n", "__upto").join(total, match)
            upto = upto.withColumn(place, F.col("__rows") - k + 1)
        else:
            upto = running_total(counts, group, ["__value"], "__n", "__upto").withColumn(place, F.lit(k))
        here = (F.col("__upto") >= F.col(place)) & (F.col("__upto") - F.col("__n") < F.col(place)) & (F.col(place) > 0)
        return upto.where(here).select(*_keys(group), F.col("__value").alias(into))
    column = _col(value)
    order = column.desc() if largest else column.asc()
    ranked = df.where(column.isNotNull()).select(*_keys(group), column).withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*_keys(group)).orderBy(order)))
    return ranked.where(F.col("__rank") == k).select(*_keys(group), column.alias(into))


def percentiles_by(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """PERCENTILE with linear interpolation, exact, for several shares (new column to share) at once.

    Works on value counts and their running total, so no group is held in memory at once.
    """
    if not all(0 <= share <= 1 for share in shares.values()):
        raise ArgumentError("a share lies between 0 and 1")
    counts = value_counts(df, group, value)
    upto = running_total(counts, group, ["__value"], "__n", "__upto")
    names = {c: f"__g{i}" for i, c in enumerate(group)}
    totals = counts.groupBy(*[_col(c).alias(k) for c, k in names.items()]).agg(
        F.sum("__n").alias("__rows"))
    match = F.lit(True)
    for c, k in names.items():
        match = match & _col(c).eqNullSafe(F.col(k))
    if not group:
        # The whole table is one group: its size is a single number.
        rows = totals.first()["__rows"] or 0
        placed = upto.withColumn("__rows", F.lit(rows))
    else:
        placed = upto.join(totals, match)
    results = []
    for into, share in shares.items():
        at = (F.col("__rows") - 1) * F.lit(float(share))
        low = F.min(F.when(F.col("__upto") > F.floor(at), F.col("__value").cast("double")))
        high = F.min(F.when(F.col("__upto") > F.ceil(at), F.col("__value").cast("double")))
        results.append((low + (high - low) * F.max(at - F.floor(at))).alias(into))
    return placed.groupBy(*_keys(group)).agg(*results)


def percentile_by(df: DataFrame, group: list[str], value: str, share: float,
                  into: str = "percentile") -> DataFrame:
    """PERCENTILE for one share."""
    return percentiles_by(df, group, value, {into: share})


def median_by(df: DataFrame, group: list[str], value: str, into: str = "median") -> DataFrame:
    """MEDIAN: the middle value, or the mean of the two middle values."""
    return percentile_by(df, group, value, 0.5, into)


def quartile_by(df: DataFrame, group: list[str], value: str, quarter: int,
                into: str = "quartile") -> DataFrame:
    """QUARTILE 0 to 4."""
    return percentile_by(df, group, value, quarter / 4, into)


def textjoin_by(df: DataFrame, group: list[str], value: str, separator: str, order: list[str],
                into: str = "joined", max_length: int | None = None) -> DataFrame:
    """TEXTJOIN down a group, in row order, empty cells skipped.

    The whole text is returned, however long; with ``max_length``, a group beyond it is refused instead
    (a sheet's cell holds 32,767 characters).
    """
    text = _col(value).cast("string")
    kept = df.where(F.coalesce(text, F.lit("")) != "")
    if max_length is not None:
        size = F.sum(F.length(text)) + (F.count(F.lit(1)) - 1) * len(separator)
        long = kept.groupBy(*_keys(group)).agg(size.alias("__size")).where(F.col("__size") > max_length).first()
        if long is not None:
            raise ArgumentError(f"{tuple(long[c] for c in group)} joins to {long['__size']:,} characters, above {max_length:,}")
    item = F.struct(*[_col(c).alias(f"o{i}") for i, c in enumerate(order)], text.alias("text"))
    return kept.groupBy(*_keys(group)).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), separator).alias(into))
