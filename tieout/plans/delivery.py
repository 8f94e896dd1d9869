"""Receive a delivery, look for drift, then check its contract. Drift comes first: it explains more."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieout.operators.contract import Contract, Validation, infer_contract, validate
from tieout.operators.drift import DeliveryShape, DriftReport, compare_shape, shape_of
from tieout.operators.profile import profile
from tieout.sources.delivery import Layout, read_data
from tieout.sources.files import content_hashes, list_files
from tieout.sources.receipts import last_accepted, store_shape


@dataclass
class Checked:
    data: DataFrame
    layout: Layout
    shape: DeliveryShape
    drift: DriftReport
    validation: Validation | None


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file. Several files give a digest of how many there are and of the sums of theirs, so
    their order does not count but how often a content occurs does."""
    hashed = content_hashes(list_files(spark, path))
    sums = [F.sum(F.conv(F.substring("sha256", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"p{i}") for i in range(8)]
    found = hashed.agg(F.count(F.lit(1)).alias("files"), F.min("sha256").alias("one"), *sums).first()
    if found["files"] < 2:
        return found["one"] or ""
    parts = [found["files"], *(found[f"p{i}"] for i in range(8))]
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def check_drift(spark: SparkSession, df: DataFrame, layout: Layout, store: str, sha256: str = "", exact: bool | list[str] = True,
                redact: list[str] = ()) -> tuple[DeliveryShape, DriftReport]:
    """Profile, keep the shape, compare with the last accepted one. Accepts nothing."""
    shape = shape_of(profile(df, exact=exact, redact=redact), sha256, preamble_rows=layout.preamble_rows,
                     has_totals_row=layout.totals_row_excluded)
    store_shape(spark, store, shape)
    return shape, compare_shape(last_accepted(spark, store), shape)


def check_delivery(spark: SparkSession, path: str, store: str, contract: Contract | None = None,
                   redact: list[str] = ()) -> Checked:
    sha256 = file_hash(spark, path)
    keep = [c.name for c in contract.columns if c.dtype == "String"] if contract else []
    data, layout = read_data(spark, path, contract.header_row if contract else None, keep_as_text=keep)
    shape, drift = check_drift(spark, data, layout, store, sha256, redact=redact)
    validation = validate(data, contract, sha256, layout.notes()) if contract else None
    return Checked(data, layout, shape, drift, validation)


def draft_contract(spark: SparkSession, path: str, name: str) -> tuple[Contract, dict[str, list[str]]]:
    """A contract drafted from one file, with notes on every guess and every converted column."""
    data, layout = read_data(spark, path)
    contract, notes = infer_contract(data, name, file_hash(spark, path), path)
    for coercion in layout.coercions:
        notes.setdefault(coercion.column, []).append(coercion.note())
    return contract, notes
