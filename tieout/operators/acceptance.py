"""Accept a translation once, then cite that acceptance on later, different deliveries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession, functions as F

from tieout.operators.compare import Report
from tieout.operators.status import Status
from tieout.sources import ledger

SCHEMA = ("process string, delivery_sha256 string, accepted_at timestamp, status string, regions_passed bigint, "
          "regions_claimed bigint, regions_declared bigint, rows_compared bigint, tolerance string, headline string")


@dataclass(frozen=True)
class TranslationCheck:
    """Truthy only when a live comparison passed; a citation alone never is."""

    live: Report | None
    cited: Row | None
    reason: str

    @property
    def status(self) -> Status:
        return self.live.status if self.live is not None else Status.NOT_RECONCILED

    def __bool__(self) -> bool:
        return bool(self.status)

    @property
    def translation_accepted(self) -> bool:
        if self.live is not None:
            return bool(self.live.having(Status.PASSED)) and not self.live.having(Status.FAILED)
        return self.cited is not None and self.cited["status"] in ("checked", Status.PASSED.value)


def record_acceptance(spark: SparkSession, path: str, process: str, report: Report, delivery_sha256: str | None) -> None:
    """Append one row. Earlier acceptances stay."""
    passed, failed = report.having(Status.PASSED), report.having(Status.FAILED)
    declared = report.declared_not_reproduced
    row = (process, delivery_sha256, "checked" if passed and not failed else report.status.value, len(passed),
           len(report.regions) - len(declared), len(declared), report.rows_compared, report.tolerance.describe(), report.headline())
    names = [part.strip().split()[0] for part in SCHEMA.split(",")]
    without_time = ", ".join(part.strip() for part in SCHEMA.split(",") if "accepted_at" not in part)
    ledger.append(spark, path, spark.createDataFrame([row], without_time).withColumn("accepted_at", F.current_timestamp())
                  .select(*names).coalesce(1))


def latest_acceptance(spark: SparkSession, path: str, process: str) -> Row | None:
    table = ledger.read(spark, path, SCHEMA)
    rows = table.where(F.col("process") == process).orderBy(F.desc("accepted_at")).limit(1).collect()
    return rows[0] if rows else None


def check_or_cite(spark: SparkSession, path: str, process: str, delivery_sha256: str | None,
                  compare: Callable[[], Report]) -> TranslationCheck:
    """Compare when never accepted or on the accepted delivery; otherwise cite without comparing."""
    accepted = latest_acceptance(spark, path, process)
    same_data = accepted is not None and delivery_sha256 is not None and accepted["delivery_sha256"] == delivery_sha256
    if accepted is not None and not same_data:
        return TranslationCheck(None, accepted, "this run holds other data than the accepted delivery, so nothing was compared")
    report = compare()
    if report.having(Status.PASSED) and not report.having(Status.FAILED):
        record_acceptance(spark, path, process, report, delivery_sha256)
    return TranslationCheck(report, accepted, "first comparison" if accepted is None else "same delivery as accepted")
