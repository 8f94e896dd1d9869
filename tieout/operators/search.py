"""Case-insensitive substring search with small integer weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Weights by where the query is found, and the default number of hits.
NAME_WEIGHT, CHILD_WEIGHT, DESCRIPTION_WEIGHT = 3, 2, 1
DEFAULT_LIMIT = 8


def _has(value: Column, query: str) -> Column:
    return F.coalesce(F.contains(F.lower(value), F.lit(query)), F.lit(False))


def _best(scored: DataFrame, key: str, limit: int) -> DataFrame:
    return scored.where(F.col("score") > 0).orderBy(F.desc("score"), key).limit(limit)


def search_documents(df: DataFrame, query: str, key: str, title: str, text: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Documents by weight of key or title, any heading line, body. A blank query finds nothing."""
    wanted = (query or "").strip().lower()
    if not wanted:
        return df.withColumn("score", F.lit(0)).where(F.lit(False))
    body = F.col(text)
    lines = F.filter(F.split(body, r"\R"), lambda line: line.startswith("#"))
    heading = F.exists(lines, lambda line: F.contains(F.lower(line), F.lit(wanted)))
    # Headings are looked at only where the body holds the query at all.
    in_body = _has(body, wanted)
    score = (
        F.when(_has(F.col(key).cast("string"), wanted) | _has(F.col(title).cast("string"), wanted), NAME_WEIGHT).otherwise(0)
        + F.when(in_body, DESCRIPTION_WEIGHT + F.when(heading, CHILD_WEIGHT).otherwise(0)).otherwise(0)
    )
    return _best(df.withColumn("score", score), key, limit)


def search_tables(columns: DataFrame, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Tables of a catalogue with one row per (table_name, table_description, column_name, column_description)."""
    wanted = (query or "").strip().lower()
    if not wanted:
        return columns.groupBy("table_name").agg(F.lit(0).alias("score")).where(F.lit(False))
    name = F.max(F.when(_has(F.col("table_name"), wanted), NAME_WEIGHT).otherwise(0))
    description = F.max(F.when(_has(F.col("table_description"), wanted), DESCRIPTION_WEIGHT).otherwise(0))
    children = F.sum(F.when(_has(F.col("column_name"), wanted), CHILD_WEIGHT)
                     .when(_has(F.col("column_description"), wanted), DESCRIPTION_WEIGHT).otherwise(0))
    return _best(columns.groupBy("table_name").agg((name + description + children).cast("int").alias("score")), "table_name", limit)
