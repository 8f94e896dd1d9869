"""Tidying delivered tables: headers, blanks, totals rows, keys and rounding residuals."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tieout.errors import ArgumentError, DuplicateKeyError
from tieout.functions.cells import strip
from tieout.naming import col as _col
from tieout.operators.ordered import row_rank
from tieout.operators.ordinal import with_ordinal


def clean_headers(names: list[str]) -> list[str]:
    """Lower case, runs of other characters as ``_``, repeats numbered from ``_2``."""
    plain = ["_".join(re.findall("[0-9a-z]+", name.lower())) or "column" for name in names]
    repeats = [plain[:i].count(name) for i, name in enumerate(plain)]
    return [name if not before else f"{name}_{before + 1}" for name, before in zip(plain, repeats)]


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_headers(df.columns))


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns with no value in any row, found in one pass over the table."""
    if not df.columns:
        return df
    filled = df.agg(*[F.count(_col(c)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if filled[str(i)] == 0])


def strip_totals_rows(df: DataFrame, key: str, markers: list[str] = ()) -> DataFrame:
    """Drop rows whose key is empty or reads total, totals or grand total, wherever they stand."""
    words = sorted({"total", "totals", "grand total", *[m.lower() for m in markers]})
    label = F.lower(strip(_col(key).cast("string")))
    return df.where(_col(key).isNotNull() & ~label.isin(words))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return (df.groupBy(*[_col(k) for k in keys]).agg(F.count(F.lit(1)).alias("occurrences"))
            .where(F.col("occurrences") > 1))


def assert_unique_key(df: DataFrame, keys: list[str] | str, label: str = "frame") -> DataFrame:
    """Return the frame unchanged, or raise naming the five worst keys."""
    names = [keys] if isinstance(keys, str) else list(keys)
    worst = duplicate_keys(df, names).orderBy(F.desc("occurrences"), *[_col(k) for k in names]).limit(5).collect()
    if worst:
        shown = "; ".join(f"{tuple(r[k] for k in names)} x{r['occurrences']}" for r in worst)
        raise DuplicateKeyError(f"{label}: {', '.join(names)} does not identify a row: {shown}")
    return df


def _allocated(units: Column, shortfall: Column, rows: Column, rank: Column, digits: int) -> Column:
    """Every row moves by the whole share of the shortfall; the first ranks move one unit more."""
    size, sign = F.abs(shortfall), F.signum(shortfall).cast("bigint")
    every = F.floor(size / rows).cast("bigint")
    extra = F.when(rank <= size - every * rows, 1).otherwise(0)
    return (units + sign * (every + extra)).cast("double") / F.lit(float(10 ** digits))


def allocate_residual(df: DataFrame, column: str, total: float, order: list[str], digits: int = 2,
                      into: str | None = None) -> DataFrame:
    """Round a column so that it sums to ``total``, by largest remainder.

    Rows with the largest discarded fraction change first; ``order`` settles ties.
    """
    step = float(10 ** digits)
    scaled = _col(column).cast("double") * step
    prepared = df.withColumns({"__units": F.floor(scaled).cast("bigint"),
                               "__rest": -(scaled - F.floor(scaled))})
    facts = prepared.agg(F.sum("__units").alias("units"), F.count(F.lit(1)).alias("rows"),
                         F.count("__units").alias("filled")).first()
    if facts["filled"] < facts["rows"]:
        raise ArgumentError(f"{column} has empty cells, which cannot be allocated to")
    target = into or column
    if facts["rows"] == 0:
        return df.withColumn(target, _col(column).cast("double"))
    shortfall = round(total * step) - facts["units"]
    if abs(shortfall) % facts["rows"] == 0:
        ranked = prepared.withColumn("__rank", F.lit(1).cast("bigint"))
    else:
        ranked = with_ordinal(prepared, ["__rest", *order], "__rank")
    share = _allocated(F.col("__units"), F.lit(shortfall), F.lit(facts["rows"]), F.col("__rank"), digits)
    return ranked.withColumn(target, share).drop("__units", "__rest", "__rank")


def allocate_residual_by(df: DataFrame, column: str, totals: DataFrame, group: list[str],
                         order: list[str], digits: int = 2, into: str | None = None,
                         total_column: str = "total") -> DataFrame:
    """:func:`allocate_residual` within each group, against a table of group totals.

    Null is a group like any other. A group without a total or with several, or with empty cells, is refused.
    """
    step = float(10 ** digits)
    scaled = _col(column).cast("double") * step
    prepared = df.withColumns({"__units": F.floor(scaled).cast("bigint"),
                               "__rest": -(scaled - F.floor(scaled))})
    facts = prepared.groupBy(*[_col(g) for g in group]).agg(
        F.sum("__units").alias("__sum"), F.count(F.lit(1)).alias("__rows"), F.count("__units").alias("__filled"))
    keys = [f"__g{i}" for i in range(len(group))]
    wanted = totals.groupBy(*[_col(g).alias(k) for g, k in zip(group, keys)]).agg(
        F.max(_col(total_column)).alias("__total"), F.count(F.lit(1)).alias("__given"))
    facts = facts.join(wanted, _same(group, keys), "left").drop(*keys).withColumn(
        "__short", F.rint(F.col("__total") * step).cast("bigint") - F.col("__sum"))
    problem = (F.when(F.col("__total").isNull(), "has no total").when(F.col("__given") > 1, "has several totals")
               .when(F.col("__filled") < F.col("__rows"), "has empty cells"))
    wrong = facts.select(*[_col(g) for g in group], problem.alias("__why")).where("__why is not null").limit(5).collect()
    if wrong:
        raise ArgumentError("; ".join(f"{tuple(r[g] for g in group)} {r['__why']}" for r in wrong))
    ranked = row_rank(prepared, group, ["__rest", *order], "__rank")
    placed = ranked.join(facts.select(*[_col(g).alias(k) for g, k in zip(group, keys)], "__short", "__rows"),
                         _same(group, keys), "left")
    share = _allocated(F.col("__units"), F.col("__short"), F.col("__rows"), F.col("__rank"), digits)
    return placed.withColumn(into or column, share).select(*df.columns, *([into] if into and into not in df.columns else []))


def _same(group: list[str], keys: list[str]) -> Column:
    """Both sides hold the same group, null included."""
    match = F.lit(True)
    for g, k in zip(group, keys):
        match = match & _col(g).eqNullSafe(F.col(k))
    return match


@dataclass(frozen=True)
class Preview:
    rows: list
    total: int
    omitted: int
    text: str


def capped_preview(df: DataFrame, rows: int = 100, max_bytes: int = 32768) -> Preview:
    """The first whole rows that fit, and exactly how many are left out."""
    held = df.limit(rows).collect()
    total = df.count()
    kept, used = [], 0
    for row in held:
        size = len(str(row).encode()) + 1
        if used + size > max_bytes:
            break
        kept.append(row)
        used += size
    omitted = total - len(kept)
    lines = [str(r) for r in kept] + ([f"... {omitted:,} more row(s) omitted"] if omitted else [])
    return Preview(kept, total, omitted, "\n".join(lines))


def duplicate_headers(headers: DataFrame, file: str, header: str) -> DataFrame:
    """Labels standing more than once on one header row, case ignored, for any number of files."""
    label = F.lower(strip(_col(header)))
    return (headers.where(label != "").groupBy(_col(file), label.alias("label"))
            .agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1))


# How a totals row starts.
TOTAL_START = r"(?Ui)^\s*(grand\s+|sub[\s-]*)?total"


def embedded_totals(df: DataFrame, ordinal: str) -> DataFrame:
    """Rows reading total in one of the first three columns, above the last two populated rows."""
    first = [c for c in df.columns if c != ordinal][:3]
    texts = [c for c in first if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return df.where(F.lit(False))
    filled = F.lit(False)
    for c in df.columns:
        if c != ordinal:
            filled = filled | _col(c).isNotNull()
    last = df.where(filled).agg(F.max(_col(ordinal))).first()[0]
    reads_total = F.lit(False)
    for c in texts:
        reads_total = reads_total | F.coalesce(_col(c).rlike(TOTAL_START), F.lit(False))
    return df.where(reads_total & (_col(ordinal) < F.lit(last) - 1))


def scope(df: DataFrame, include: dict[str, list], exclude: dict[str, object], columns: list[str]) -> DataFrame:
    """Filter to listed values, without excluded ones, keeping the named columns."""
    kept = df
    for name, values in include.items():
        kept = kept.where(_col(name).isin(list(values)))
    for name, unwanted in exclude.items():
        kept = kept.where(_col(name) != F.lit(unwanted))
    return kept.select(*[_col(c) for c in columns])
