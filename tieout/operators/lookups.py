"""Lookups and conditional totals brought back to the rows that ask for them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tieout.errors import ArgumentError
from tieout.functions.numeric import is_date_type, is_number_type
from tieout.naming import col as _col
from tieout.operators.ordered import fill_forward, slice_position

# A lookup table of at most this many rows is searched as a constant inside the projection.
BAND_ROWS = 500


def lookup_first(probe: DataFrame, table: DataFrame, probe_key: list[str], table_key: list[str],
                 returns: dict[str, str], order: list[str]) -> DataFrame:
    """VLOOKUP exact, XLOOKUP, INDEX/MATCH(...,0): the first hit in ``order``, null on a miss.

    The table is cut to one row per key before the join, so rows never multiply, and a key that
    fills much of the table is combined before it is shuffled.
    """
    if not order:
        raise ArgumentError("first hit needs an order over the lookup table")
    if len(probe_key) != len(table_key):
        raise ArgumentError("both sides need the same number of key columns")
    usable = F.lit(True)
    for name in table_key:
        usable = usable & _col(name).isNotNull()
    hit = F.min_by(F.struct(*[_col(c).alias(n) for n, c in returns.items()]),
                   F.struct(*[_col(c) for c in order]))
    keys = [f"__key{i}" for i in range(len(table_key))]
    first = (table.where(usable)
             .groupBy(*[_col(c).alias(k) for c, k in zip(table_key, keys)])
             .agg(hit.alias("__hit")))
    match = F.lit(True)
    for p, k in zip(probe_key, keys):
        match = match & (_col(p) == F.col(k))
    joined = probe.join(first, match, "left")
    return joined.withColumns({n: F.col("__hit")[n] for n in returns}).drop("__hit", *keys)


def lookup_nearest(probe: DataFrame, table: DataFrame, probe_key: str, table_key: str,
                   returns: dict[str, str], by: list[str] = (), order: list[str] = ()) -> DataFrame:
    """VLOOKUP approximate: the row with the largest key at or below the probe's.

    ``by`` names columns both sides share and must agree on. ``order`` settles which of several
    table rows with one key counts as the last, nulls first. Keys are compared in a type that holds both
    sides' values. A small table without ``by`` becomes a constant; otherwise both sides are merged in key
    order and the latest table row is carried forward, with the same result.
    """
    by, order = list(by), list(order)
    present = table.where(_col(table_key).isNotNull())
    if not by:
        kept = present.select(_col(table_key).alias("__key"),
                              F.struct(*[_col(c).alias(n) for n, c in returns.items()]).alias("__hit"),
                              *[_col(c).alias(f"__o{i}") for i, c in enumerate(order)])
        rows = kept.orderBy("__key", *[f"__o{i}" for i in range(len(order))]).limit(BAND_ROWS + 1).collect()
        if len(rows) <= BAND_ROWS:
            return _search_constant(probe, kept, rows, probe_key, list(returns))
    ties = [f"__o{i}" for i in range(len(order))]
    key_type = _common_type(probe, probe_key, table.schema[table_key].dataType)
    hit_type = present.select(F.struct(*[_col(c).alias(n) for n, c in returns.items()]).alias("h")).schema["h"].dataType
    # Each key is looked up once, however many rows ask for it; the join back is one that Spark can split.
    asked = probe.where(_col(probe_key).isNotNull()).select(
        *[_col(c) for c in by], _col(probe_key).cast(key_type).alias("__key")).distinct()
    left = asked.withColumns({"__side": F.lit(1), "__hit": F.lit(None).cast(hit_type), **{
        tie: F.lit(None).cast(table.schema[source].dataType) for tie, source in zip(ties, order)}})
    right = present.select(
        *[_col(c) for c in by], _col(table_key).cast(key_type).alias("__key"), F.lit(0).alias("__side"),
        F.struct(*[_col(c).alias(n) for n, c in returns.items()]).alias("__hit"),
        *[_col(c).alias(t) for c, t in zip(order, ties)])
    filled = fill_forward(left.unionByName(right), by, ["__key", "__side", *ties], "__hit", "__found")
    names = {c: f"__b{i}" for i, c in enumerate(by)}
    found = filled.where(F.col("__side") == 1).select(
        *[_col(c).alias(n) for c, n in names.items()], F.col("__key").alias("__at"), "__found")
    match = _col(probe_key).cast(key_type) == F.col("__at")
    for c, n in names.items():
        match = match & (_col(c) == F.col(n))  # an empty group key never matches
    return probe.join(found, match, "left").select(
        *[_col(c) for c in probe.columns], *[F.col("__found")[n].alias(n) for n in returns])


def _common_type(probe: DataFrame, probe_key: str, key_type: T.DataType) -> T.DataType:
    """The type in which Spark compares both keys; the table's where they are of different families."""
    own = probe.schema[probe_key].dataType
    for family in (is_number_type, is_date_type):
        if family(own) and family(key_type):
            both = F.coalesce(F.lit(None).cast(own), F.lit(None).cast(key_type))
            return probe.sparkSession.range(0).select(both.alias("k")).schema["k"].dataType
    return key_type


def _search_constant(probe: DataFrame, kept: DataFrame, rows: list, probe_key: str, names: list[str]) -> DataFrame:
    by_key = {row["__key"]: row["__hit"] for row in rows}  # sorted, so the last of equal keys stays
    hit_type = kept.schema["__hit"].dataType
    if not by_key:
        return probe.withColumns({n: F.lit(None).cast(hit_type[n].dataType) for n in names})
    step = max(1, math.isqrt(len(by_key)))
    ordered = list(by_key)
    key_type = _common_type(probe, probe_key, kept.schema["__key"].dataType)
    chunks = F.array(*[F.array(*[F.lit(k).cast(key_type) for k in ordered[i:i + step]])
                       for i in range(0, len(ordered), step)])
    hits = F.array(*[F.struct(*[F.lit(hit[n]).cast(hit_type[n].dataType).alias(n) for n in names])
                     for hit in by_key.values()])
    place = slice_position(chunks, F.lit(step), _col(probe_key).cast(key_type))
    found = F.when(_col(probe_key).isNotNull() & (place > 0), F.try_element_at(hits, place))
    return probe.withColumn("__found", found).withColumns({n: F.col("__found")[n] for n in names}).drop("__found")


def totals_by_criteria(target: DataFrame, source: DataFrame, criteria: dict[str, str],
                       totals: dict[str, Column], where: Column | None = None,
                       no_match: dict[str, object] | None = None) -> DataFrame:
    """SUMIFS, COUNTIFS, AVERAGEIFS: aggregate ``source`` per criteria and bring it to ``target``.

    ``criteria`` pairs target columns with source columns. Totals with no matching row take their
    ``no_match`` value (0 for sums and counts), the others stay null, as an error would.
    """
    rows = source if where is None else source.where(where)
    keys = {t: f"__key{i}" for i, t in enumerate(criteria)}
    for column in criteria.values():
        rows = rows.where(_col(column).isNotNull())
    grouped = rows.groupBy(*[_col(s).alias(keys[t]) for t, s in criteria.items()]).agg(
        *[total.alias(name) for name, total in totals.items()])
    match = F.lit(True)
    for t, key in keys.items():
        match = match & (_col(t) == F.col(key))
    joined = target.join(grouped, match, "left").drop(*keys.values())
    for name, default in (no_match or {}).items():
        joined = joined.withColumn(name, F.coalesce(_col(name), F.lit(default)))
    return joined


def sumifs(target: DataFrame, source: DataFrame, criteria: dict[str, str], value: Column,
           into: str, where: Column | None = None) -> DataFrame:
    """No match gives 0."""
    return totals_by_criteria(target, source, criteria, {into: F.sum(value)}, where, {into: 0})


def countifs(target: DataFrame, source: DataFrame, criteria: dict[str, str], into: str,
             where: Column | None = None) -> DataFrame:
    """No match gives 0."""
    return totals_by_criteria(target, source, criteria, {into: F.count(F.lit(1))}, where, {into: 0})


def averageifs(target: DataFrame, source: DataFrame, criteria: dict[str, str], value: Column,
               into: str, where: Column | None = None) -> DataFrame:
    """No match is an error, hence null."""
    return totals_by_criteria(target, source, criteria, {into: F.avg(value)}, where)
