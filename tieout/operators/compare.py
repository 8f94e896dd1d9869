"""Positional tie-out: expected values against actual ones, row by row in reading order."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tieout.errors import ArgumentError
from tieout.functions.cells import ERROR_LITERALS
from tieout.functions.numeric import is_date_type, is_finite, is_number_type, micros_of, signed_delta, numbers_agree
from tieout.naming import col as _col
from tieout.operators.diagnose import Diagnosis, diagnose
from tieout.operators.frames import duplicate_keys
from tieout.operators.ordinal import with_ordinal
from tieout.operators.status import Status, Tolerance, worst

REPORTED_MISMATCHES = 50


def _family(dtype: T.DataType) -> str:
    if is_number_type(dtype):
        return "number"
    if is_date_type(dtype):
        return "moment"
    return dtype.typeName()


def _number_or_null(value: Column, dtype: T.DataType) -> Column:
    return value.cast("double") if is_number_type(dtype) else F.lit(None).cast("double")


def _cell_kind(want: Column, got: Column, want_type: T.DataType, got_type: T.DataType,
               tolerance: Tolerance) -> Column:
    """Why a pair of values differs; null when they agree. ``want`` is not null here."""
    kind = None
    if isinstance(want_type, T.StringType):
        kind = F.when(want.isin(ERROR_LITERALS), "excel_error")
    empty = got.isNull()
    kind = kind.when(empty, "actual_null") if kind is not None else F.when(empty, "actual_null")
    families = _family(want_type), _family(got_type)
    if families == ("number", "number"):
        agree = numbers_agree(want, got, want_type, got_type, tolerance.absolute, tolerance.relative)
        return kind.when(~is_finite(got), "non_finite").when(~agree, "value_differs")
    if families == ("moment", "moment"):
        return kind.when(micros_of(want) != micros_of(got), "value_differs")
    if families[0] == families[1]:
        return kind.when(want != got, "value_differs")
    return kind.otherwise("type_differs")


def paired_cells(expected: DataFrame, actual: DataFrame, expected_column: str, actual_column: str,
                 tolerance: Tolerance = Tolerance(), ordinal: str | None = None,
                 order: list[str] | None = None) -> DataFrame:
    """Every row position of either side with its verdict in ``kind``.

    Rows pair by ``ordinal``, a column holding 1..n on both sides, or by position under ``order``.
    """
    if ordinal is None:
        if not order:
            raise ArgumentError("a positional comparison needs an ordinal column or an order")
        ordinal = "__ordinal"
        # Only the order and the compared column are sorted and written.
        expected, actual = (
            with_ordinal(side.select(*[_col(c) for c in dict.fromkeys([*order, column])]), order, ordinal)
            for side, column in ((expected, expected_column), (actual, actual_column)))
    left_type = expected.schema[expected_column].dataType
    right_type = actual.schema[actual_column].dataType
    left = expected.select(_col(ordinal).cast("bigint").alias("row"), F.lit(True).alias("in_expected"),
                           _col(expected_column).alias("want"))
    right = actual.select(_col(ordinal).cast("bigint").alias("row"), F.lit(True).alias("in_actual"),
                          _col(actual_column).alias("got"))
    both = left.join(right, "row", "full")
    want, got = F.col("want"), F.col("got")
    here, there = F.coalesce("in_expected", F.lit(False)), F.coalesce("in_actual", F.lit(False))
    missing = here & want.isNull()
    compared = here & there & want.isNotNull()
    kind = (F.when(missing, F.lit(None))
            .when(here & ~there, "missing_row").when(~here, "extra_row")
            .otherwise(_cell_kind(want, got, left_type, right_type, tolerance)))
    delta = F.when(compared, F.abs(signed_delta(want, got, left_type, right_type)))
    want_number, got_number = _number_or_null(want, left_type), _number_or_null(got, right_type)
    relative = F.when((want_number != 0), delta / F.abs(want_number)) if is_number_type(left_type) else F.lit(None).cast("double")
    return both.select(
        "row", here.alias("in_expected"), there.alias("in_actual"), missing.alias("missing_baseline"),
        compared.alias("compared"), kind.alias("kind"),
        want.cast("string").alias("expected"), got.cast("string").alias("actual"),
        want_number.alias("expected_number"), got_number.alias("actual_number"),
        F.lit(_family(left_type)).alias("expected_family"), F.lit(_family(right_type)).alias("actual_family"),
        delta.alias("absolute_delta"), relative.alias("relative_delta"))


def comparison_counts(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counters of one comparison, or of many told apart by ``by``, from one aggregation."""
    differs = F.col("kind").isNotNull()
    at_worst = F.max(F.when(F.col("absolute_delta").isNotNull(), F.struct("absolute_delta", (-F.col("row")).alias("place"))))
    aggregates = [
        F.count_if("in_expected").alias("rows_expected"),
        F.count_if("in_actual").alias("rows_actual"),
        F.count_if("compared").alias("rows_compared"),
        F.count_if(F.col("compared") & ~differs).alias("rows_matched"),
        F.count_if(differs).alias("rows_differing"),
        F.count_if("missing_baseline").alias("rows_missing_baseline"),
        F.max("relative_delta").alias("worst_relative_delta"),
        at_worst.alias("__worst"),
    ]
    counted = cells.groupBy(*by).agg(*aggregates) if by else cells.agg(*aggregates)
    return counted.withColumns({
        "worst_absolute_delta": F.col("__worst.absolute_delta"),
        "worst_at": -F.col("__worst.place"),
        "status": region_status(),
        "reason": region_reason(),
    }).drop("__worst")


def region_status() -> Column:
    return (F.when(F.col("rows_compared") == 0, Status.NOT_RECONCILED.value)
            .when(F.col("rows_differing") > 0, Status.FAILED.value)
            .when(F.col("rows_missing_baseline") > 0, Status.NOT_RECONCILED.value)
            .otherwise(Status.PASSED.value))


def region_reason() -> Column:
    return (F.when(F.col("rows_expected") == 0, "baseline_range_empty")
            .when(F.col("rows_compared") == 0, F.when(F.col("rows_actual") == 0, "no_actual_values").otherwise("no_cached_values"))
            .when((F.col("rows_differing") == 0) & (F.col("rows_missing_baseline") > 0), "partial_cached_values"))


def baseline_status(expected: DataFrame | None, column: str) -> str:
    """present, partial, absent, empty or unreadable."""
    if expected is None or column not in expected.columns:
        return "unreadable"
    counted = expected.agg(F.count(F.lit(1)).alias("rows"), F.count(_col(column)).alias("filled")).first()
    if counted["rows"] == 0:
        return "empty"
    if counted["filled"] == 0:
        return "absent"
    return "present" if counted["filled"] == counted["rows"] else "partial"


@dataclass(frozen=True)
class Region:
    """One column to tie out. ``expected`` None stands for a baseline that cannot be read."""

    id: str
    expected: DataFrame | None
    expected_column: str
    actual_column: str
    actual: DataFrame | None = None
    variable: str | None = None
    ordinal: str | None = None
    order: tuple[str, ...] = ()
    truncated: bool = False


@dataclass(frozen=True)
class RegionResult:
    id: str
    status: Status
    reason: str | None = None
    rows_expected: int = 0
    rows_actual: int = 0
    rows_compared: int = 0
    rows_matched: int = 0
    rows_differing: int = 0
    rows_missing_baseline: int = 0
    worst_absolute_delta: float | None = None
    worst_relative_delta: float | None = None
    worst_at: int | None = None
    detail: str = ""
    diagnoses: tuple[Diagnosis, ...] = ()

    def __post_init__(self) -> None:
        if self.status is Status.PASSED and (self.rows_compared <= 0 or self.rows_differing or self.reason):
            raise ValueError(f"region {self.id} cannot pass on this evidence")
        if self.status is Status.NOT_RECONCILED and not self.reason:
            raise ValueError(f"region {self.id} must say why it was not reconciled")


@dataclass
class Report:
    """All regions of a run, with the cells behind them for a closer look."""

    regions: list[RegionResult] = field(default_factory=list)
    cells: DataFrame | None = None
    tolerance: Tolerance = Tolerance()

    @property
    def status(self) -> Status:
        return worst(r.status for r in self.regions)

    @property
    def rows_compared(self) -> int:
        return sum(r.rows_compared for r in self.regions)

    def having(self, status: Status) -> list[RegionResult]:
        return [r for r in self.regions if r.status is status]

    @property
    def declared_not_reproduced(self) -> list[RegionResult]:
        return [r for r in self.regions if r.reason == "not_reproduced"]

    def mismatches(self, region: str | None = None) -> DataFrame:
        """Every differing row. Whole, not a sample."""
        rows = self.cells.where(F.col("kind").isNotNull())
        return rows if region is None else rows.where(F.col("region") == region)

    def headline(self) -> str:
        if not self.regions:
            return "NOT RECONCILED: no regions were compared"
        counts = (f"{len(self.having(Status.PASSED))} passed, {len(self.having(Status.FAILED))} failed, "
                  f"{len(self.having(Status.NOT_RECONCILED))} not reconciled")
        return f"{self.status.value.replace('_', ' ').upper()}: {counts}; {self.rows_compared:,} rows within {self.tolerance.describe()}"

    def to_frame(self, spark: SparkSession) -> DataFrame:
        schema = ("region string, status string, reason string, rows_expected bigint, rows_actual bigint, "
                  "rows_compared bigint, rows_matched bigint, rows_differing bigint, rows_missing_baseline bigint, "
                  "worst_absolute_delta double, worst_relative_delta double, worst_at bigint")
        return spark.createDataFrame(
            [(r.id, r.status.value, r.reason, r.rows_expected, r.rows_actual, r.rows_compared, r.rows_matched,
              r.rows_differing, r.rows_missing_baseline, r.worst_absolute_delta, r.worst_relative_delta, r.worst_at)
             for r in self.regions], schema)


def find_actual(frames: Mapping[str, DataFrame], region: Region) -> DataFrame | None:
    """The named frame, else the one holding the column whose height equals the region's."""
    if region.variable:
        return frames.get(region.variable)
    holding = [f for n, f in frames.items() if not n.startswith("_") and region.actual_column in f.columns]
    if len(holding) < 2 or region.expected is None:
        return holding[0] if holding else None
    wanted = region.expected.count()
    return next((f for f in holding if f.count() == wanted), holding[0])


def reconcile_many(regions: list[Region], frames: Mapping[str, DataFrame] = {},
                   tolerance: Tolerance = Tolerance(), not_reproduced: Mapping[str, str] = {},
                   explain: bool = True) -> Report:
    """Tie out several regions in one job; differing regions also get a diagnosis.

    Rows that an ``order`` leaves tied have no position, so such a region is not reconciled.
    """
    early, parts, by_region, settled = {}, None, {}, {}

    def settles(frame: DataFrame, order: tuple[str, ...]) -> bool:
        """Whether the order tells all rows of the frame apart, found once for each frame and order."""
        if (id(frame), order) not in settled:
            settled[id(frame), order] = not duplicate_keys(frame, list(order)).take(1)
        return settled[id(frame), order]

    for region in regions:
        if region.expected is None or region.expected_column not in region.expected.columns:
            early[region.id] = RegionResult(region.id, Status.NOT_RECONCILED, "baseline_range_unreadable")
            continue
        actual = region.actual if region.actual is not None else find_actual(frames, region)
        if actual is None or region.actual_column not in actual.columns:
            declared = not_reproduced.get(region.id)
            early[region.id] = RegionResult(region.id, Status.NOT_RECONCILED,
                                            "not_reproduced" if declared else "no_actual_values", detail=declared or "")
            continue
        if region.ordinal is None and region.order and not all(
                settles(side, tuple(region.order)) for side in (region.expected, actual)):
            early[region.id] = RegionResult(region.id, Status.NOT_RECONCILED, "order_not_unique",
                                            detail=f"{', '.join(region.order)} does not tell rows apart")
            continue
        part = paired_cells(region.expected, actual, region.expected_column, region.actual_column, tolerance,
                            region.ordinal, list(region.order)).withColumn("region", F.lit(region.id))
        by_region[region.id] = part
        parts = part if parts is None else parts.unionByName(part)
    counted = {}
    if parts is not None:
        counted = {r["region"]: r for r in comparison_counts(parts, ["region"]).collect()}
    results = []
    for region in regions:
        if region.id in early:
            results.append(early[region.id])
            continue
        row = counted.get(region.id)
        if row is None:
            results.append(RegionResult(region.id, Status.NOT_RECONCILED, "baseline_range_empty"))
            continue
        status, reason = Status(row["status"]), row["reason"]
        if status is Status.PASSED and region.truncated:
            status, reason = Status.NOT_RECONCILED, "baseline_truncated"
        facts = {k: row[k] for k in ("rows_expected", "rows_actual", "rows_compared", "rows_matched", "rows_differing",
                                     "rows_missing_baseline", "worst_absolute_delta", "worst_relative_delta", "worst_at")}
        causes = ()
        if explain and status is Status.FAILED:
            causes = tuple(diagnose(by_region[region.id], facts["rows_compared"],
                                    facts["rows_expected"], facts["rows_actual"], region.actual_column))
        results.append(RegionResult(region.id, status, None if status is Status.FAILED else reason, diagnoses=causes, **facts))
    return Report(results, parts, tolerance)


def reconcile_region(region: Region, tolerance: Tolerance = Tolerance(), **options) -> RegionResult:
    return reconcile_many([region], tolerance=tolerance, **options).regions[0]
