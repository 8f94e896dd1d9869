"""Helpers shared by the operators: words, row keys, written intermediate tables."""

from __future__ import annotations

import string
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.session import drop_scratch, scratch_folder, write_scratch

__all__ = ["BLANKS", "ascii_lower", "drop_scratch", "free_name", "scratch_folder", "slices", "whole_text", "words_between",
           "write_scratch"]

BLANKS = r"[\x20\x09-\x0D]+"


def whole_text(text: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; by way of ``lower`` where that leaves other characters alone."""
    others = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(others) == others, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_between(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of separators, as an array."""
    return F.array_remove(F.split(text, separators), "")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of the frame is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Cut Arrow batches into short ones, so that few texts are Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
