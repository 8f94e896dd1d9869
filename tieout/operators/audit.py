"""The run log: an append-only table of deliveries used, decisions made and parameters set."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieout.errors import ArgumentError
from tieout.naming import col as _col
from tieout.sources import ledger

SCHEMA = "run_id string, step string, kind string, value string, note string, at timestamp"
KINDS = ["handin", "decision", "parameter"]


def record_event(spark: SparkSession, path: str, run_id: str, step: str, kind: str, value: str,
                 note: str = "", at: dt.datetime | None = None) -> None:
    """Append one event; nothing recorded is ever overwritten."""
    if kind not in KINDS:
        raise ArgumentError(f"kind is one of {', '.join(KINDS)}")
    when = at or dt.datetime.now(dt.timezone.utc)
    ledger.append(spark, path, spark.createDataFrame([(run_id, step, kind, value, note, when)], SCHEMA).coalesce(1))


def record_parameters(spark: SparkSession, path: str, run_id: str, **values) -> None:
    """Parameters as events; the latest value of a name wins."""
    when = dt.datetime.now(dt.timezone.utc)
    rows = [(run_id, name, "parameter", json.dumps(value, default=str), "", when) for name, value in values.items()]
    ledger.append(spark, path, spark.createDataFrame(rows, SCHEMA).coalesce(1))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return ledger.read(spark, path, SCHEMA)


def latest_per_step(events: DataFrame, group: list[str] = ("run_id", "step", "kind"), at: str = "at",
                    tie: list[str] = ()) -> DataFrame:
    """The newest event of each group, by partial aggregation rather than a sort per group."""
    others = [c for c in events.columns if c not in group]
    newest = F.max_by(F.struct(*[_col(c) for c in others]), F.struct(at, *tie))
    return events.groupBy(*group).agg(newest.alias("__newest")).select(*group, *[F.col("__newest")[c].alias(c) for c in others])


def audit_trail(*logs: DataFrame, at: str = "at") -> DataFrame:
    """All logs together in order of time."""
    whole = logs[0]
    for log in logs[1:]:
        whole = whole.unionByName(log, allowMissingColumns=True)
    return whole.orderBy(at)


def steps_reached(events: DataFrame, step: str = "step", at: str = "at", group: list[str] = ()) -> DataFrame:
    """Steps with the time each was first seen."""
    return events.groupBy(*group, step).agg(F.min(at).alias("first_seen"))


def steps_completed(steps: DataFrame, events: DataFrame, step: str = "step") -> DataFrame:
    """The given steps with a flag telling whether any event reached them."""
    seen = events.select(step).distinct().withColumn("completed", F.lit(True))
    return steps.join(seen, step, "left").withColumn("completed", F.coalesce("completed", F.lit(False)))
