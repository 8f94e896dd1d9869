"""Whole-table row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tieout.errors import ArgumentError
from tieout.naming import col as _col
from tieout.session import cut_lineage

ROW_BITS = 33


def with_ordinal(df: DataFrame, order: list[str], into: str = "ordinal") -> DataFrame:
    """Number all rows 1..n in the given (ascending) order.

    Rows are range-partitioned and sorted within partitions; a partition's first number is the
    row count of the partitions before it. The sorted rows are written to the checkpoint folder
    once, so the counts and the rows always describe the same partitions. Rows equal on ``order``
    are told apart by a hash of the whole row, and spread even when they are exact copies.
    """
    if not order:
        raise ArgumentError("rows of a DataFrame have no order of their own: name order columns")
    names = df.columns
    keyed = df.withColumns({
        "__tie": F.xxhash64(*[_col(c) for c in names]),
        "__copy": F.monotonically_increasing_id(),
    })
    keys = [*[_col(c) for c in order], F.col("__tie"), F.col("__copy")]
    placed = cut_lineage(
        keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .drop("__tie", "__copy")
        .withColumn("__id", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned(F.col("__id"), ROW_BITS).cast("int")
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).collect()
    offsets, total = [], 0
    for row in sorted(counts, key=lambda r: r["__part"]):
        offsets.append((row["__part"], total))
        total += row["__n"]
    schema = T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__before", T.LongType())])
    # One row per partition of the sort.
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, schema))
    local = F.col("__id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (placed.withColumn("__part", part).join(starts, "__part")
            .select(*[_col(c) for c in names], (local + F.col("__before") + 1).alias(into)))
