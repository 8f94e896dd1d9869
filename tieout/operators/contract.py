"""Data contracts: draft one from a delivery, loosen it, keep it as JSON, check deliveries against it."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tieout.errors import ContractError
from tieout.functions.cells import parse_plain
from tieout.naming import col as _col
from tieout.operators.profile import CATEGORY_MAX_VALUES, CATEGORY_MIN_ROWS, column_counters, distinct_values, top_values, value_frequencies
from tieout.types import FLOAT_NAMES, INTEGER_NAMES, dtype_name, dtype_satisfies

PASS, FAIL, WARN, SKIP = "PASS", "FAIL", "WARN", "SKIP"
LISTED_VALUES = 5
CHECKSUM_MODES = ["ignore", "warn", "require"]


@dataclass
class ColumnContract:
    name: str
    dtype: str = "Any"
    required: bool = True
    nullable: bool = True
    unique: bool = False
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: list[str] | None = None
    description: str | None = None

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise ContractError("a column contract needs a name")


@dataclass
class Contract:
    name: str
    columns: list[ColumnContract] = field(default_factory=list)
    allow_extra_columns: bool = True
    require_column_order: bool = False
    min_rows: int | None = None
    max_rows: int | None = None
    unique_key: list[str] = field(default_factory=list)
    checksum: str | None = None
    checksum_mode: str = "warn"
    header_row: int | None = None
    description: str | None = None
    generated_from: str | None = None

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise ContractError("a contract needs a name")
        if self.checksum_mode not in CHECKSUM_MODES:
            raise ContractError(f"checksum_mode is one of {', '.join(CHECKSUM_MODES)}")
        if any(bound is not None and bound < 0 for bound in (self.min_rows, self.max_rows)):
            raise ContractError("row bounds cannot be negative")

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Contract:
        """Strict: an unknown key is an error, not something to ignore."""
        try:
            raw = json.loads(text)
            columns = [ColumnContract(**column) for column in raw.pop("columns", [])]
            return cls(columns=columns, **raw)
        except (TypeError, ValueError, AttributeError) as error:
            raise ContractError(f"not a valid contract: {error}") from error


def save_contract(contract: Contract, spark: SparkSession, path: str) -> None:
    """Append the contract to a table with one row per column beside the whole specification."""
    rows = [(contract.name, position, c.name, c.dtype, c.required, c.nullable, c.unique, contract.to_json())
            for position, c in enumerate(contract.columns)]
    schema = ("contract string, position int, column string, dtype string, required boolean, "
              "nullable boolean, is_unique boolean, specification string")
    (spark.createDataFrame(rows, schema).withColumn("saved_at", F.current_timestamp())
     .coalesce(1).write.mode("append").parquet(path))


def load_contract(spark: SparkSession, path: str, name: str) -> Contract:
    """The latest saved specification of a contract."""
    found = (spark.read.parquet(path).where(F.col("contract") == name)
             .agg(F.max_by("specification", "saved_at")).first()[0])
    if found is None:
        raise ContractError(f"no contract {name!r} in {path}")
    return Contract.from_json(found)


@dataclass(frozen=True)
class Check:
    check: str
    status: str
    column: str | None = None
    expected: str | None = None
    actual: str | None = None
    message: str = ""


@dataclass(frozen=True)
class Validation:
    contract: str
    checks: tuple[Check, ...]

    def _with(self, status: str) -> list[Check]:
        return [c for c in self.checks if c.status == status]

    @property
    def failures(self) -> list[Check]:
        return self._with(FAIL)

    @property
    def warnings(self) -> list[Check]:
        return self._with(WARN)

    @property
    def skipped(self) -> list[Check]:
        return self._with(SKIP)

    @property
    def ok(self) -> bool:
        return bool(self.checks) and not self.failures

    def raise_for_status(self) -> None:
        if not self.ok:
            raise ContractError("; ".join(c.message for c in self.failures) or "nothing was checked")

    def to_frame(self, spark: SparkSession) -> DataFrame:
        schema = ("position int, check string, status string, column string, expected string, "
                  "actual string, message string")
        return spark.createDataFrame(
            [(i, c.check, c.status, c.column, c.expected, c.actual, c.message) for i, c in enumerate(self.checks)], schema)


def _range_number(name: str, dtype: T.DataType) -> Column | None:
    if isinstance(dtype, T.NumericType):
        return _col(name).cast("double")
    return parse_plain(_col(name)) if isinstance(dtype, T.StringType) else None


def _measure(df: DataFrame, contract: Contract) -> dict:
    """Every counter the row-level checks need, from one aggregation."""
    wanted = [F.count(F.lit(1)).alias("rows")]
    for i, column in enumerate(contract.columns):
        if column.name not in df.columns:
            continue
        value, dtype = _col(column.name), df.schema[column.name].dataType
        if not column.nullable:
            wanted.append(F.count_if(value.isNull()).alias(f"nulls{i}"))
        number = _range_number(column.name, dtype)
        if (column.min_value is not None or column.max_value is not None) and number is not None:
            wanted += [F.count(number).alias(f"numbers{i}"), F.min(number).alias(f"min{i}"), F.max(number).alias(f"max{i}")]
            if column.min_value is not None:
                wanted.append(F.count_if(number < float(column.min_value)).alias(f"below{i}"))
            if column.max_value is not None:
                wanted.append(F.count_if(number > float(column.max_value)).alias(f"above{i}"))
        if column.allowed_values:
            stray = ~value.cast("string").isin(sorted(set(column.allowed_values)))
            wanted.append(F.count_if(stray).alias(f"stray{i}"))
    return df.agg(*wanted).first().asDict()


def _duplicates(df: DataFrame, keys: dict[int, list[str]], keep_null: set[int]) -> dict[int, int]:
    """Rows beyond the first per key, each key counted by its own narrow group-by."""
    parts = None
    for number, names in keys.items():
        rows = df.select(*[_col(n).alias(f"k{j}") for j, n in enumerate(names)])
        if number not in keep_null:
            rows = rows.where(F.col("k0").isNotNull())
        counted = rows.groupBy(*rows.columns).agg((F.count(F.lit(1)) - 1).alias("more"))
        part = counted.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("duplicates")).withColumn("key", F.lit(number))
        parts = part if parts is None else parts.unionByName(part)
    return {r["key"]: r["duplicates"] for r in parts.collect()} if parts is not None else {}


def _stray_values(df: DataFrame, stray: dict[int, ColumnContract]) -> dict[int, tuple[int, list[str]]]:
    """Distinct values outside the permitted set: how many, and the first few in order."""
    parts = None
    for number, column in stray.items():
        value = _col(column.name).cast("string")
        part = df.select(value.alias("value")).where(~F.col("value").isin(sorted(set(column.allowed_values))))
        part = part.select(F.lit(number).alias("column_index"), "value")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return {}
    values = parts.distinct()
    counts = {r["column_index"]: r["n"] for r in values.groupBy("column_index").agg(F.count(F.lit(1)).alias("n")).collect()}
    listed: dict[int, list[str]] = {number: [] for number in stray}
    first = top_values(values.withColumn("n", F.lit(1)), LISTED_VALUES)
    for row in first.orderBy("column_index", "place").collect():
        listed[row["column_index"]].append(row["value"])
    return {number: (counts.get(number, 0), listed[number]) for number in stray}


def _schema_checks(df: DataFrame, contract: Contract, sha256: str) -> list[Check]:
    checks = []
    if contract.checksum is not None and contract.checksum_mode != "ignore":
        same = contract.checksum == sha256
        status = PASS if same else FAIL if contract.checksum_mode == "require" else WARN
        checks.append(Check("checksum", status, None, contract.checksum[:12], sha256[:12],
                            "same bytes as recorded" if same else "not the recorded file"))
    return checks


def _column_set_checks(df: DataFrame, contract: Contract) -> list[Check]:
    present, known = df.columns, [c.name for c in contract.columns]
    required = [c.name for c in contract.columns if c.required]
    missing = [name for name in required if name not in present]
    checks = [Check("columns_present", FAIL if missing else PASS, None, ", ".join(required) or None,
                    ", ".join(present) or None,
                    f"absent: {', '.join(missing)}" if missing else "all required columns are there")]
    extra = [name for name in present if name not in known]
    if extra:
        checks.append(Check("no_extra_columns", PASS if contract.allow_extra_columns else FAIL, None, None,
                            ", ".join(extra), f"outside the contract: {', '.join(extra)}"))
    if contract.require_column_order:
        wanted = [n for n in known if n in present]
        found = [n for n in present if n in known]
        checks.append(Check("column_order", PASS if wanted == found else FAIL, None, ", ".join(wanted),
                            ", ".join(found), "in order" if wanted == found else "out of order"))
    return checks


def _dash(bound) -> str:
    return "-" if bound is None else str(bound)


def validate(df: DataFrame, contract: Contract, sha256: str = "", layout_notes: list[str] = ()) -> Validation:
    """Run every check of a contract; a failing check stops none of the others."""
    numbers = _measure(df, contract)
    rows = numbers["rows"]
    here = {i: c for i, c in enumerate(contract.columns) if c.name in df.columns}
    keys = {i: [c.name] for i, c in here.items() if c.unique}
    whole_key, key_present = len(contract.columns), all(k in df.columns for k in contract.unique_key)
    if contract.unique_key and key_present:
        keys[whole_key] = list(contract.unique_key)
    repeats = _duplicates(df, keys, {whole_key})
    strays = _stray_values(df, {i: c for i, c in here.items() if numbers.get(f"stray{i}")})

    checks = _schema_checks(df, contract, sha256)
    if layout_notes:
        checks.append(Check("layout", PASS, message="; ".join(layout_notes)))
    checks += _column_set_checks(df, contract)
    if contract.min_rows is not None or contract.max_rows is not None:
        inside = ((contract.min_rows is None or rows >= contract.min_rows)
                  and (contract.max_rows is None or rows <= contract.max_rows))
        checks.append(Check("row_count", PASS if inside else FAIL, None,
                            f"{_dash(contract.min_rows)} to {_dash(contract.max_rows)}", f"{rows:,}",
                            f"{rows:,} rows {'inside' if inside else 'outside'} the bounds"))
    for i, column in enumerate(contract.columns):
        name = column.name
        if i not in here:
            if column.required:
                checks.append(Check("dtype", SKIP, name, column.dtype, None, f"{name} is absent"))
            continue
        actual = dtype_name(df.schema[name].dataType)
        fits = dtype_satisfies(actual, column.dtype)
        hint = ("; text where a number is due matches nothing in a join"
                if actual == "String" and column.dtype in INTEGER_NAMES + FLOAT_NAMES else "")
        checks.append(Check("dtype", PASS if fits else FAIL, name, column.dtype, actual, f"{name} is {actual}{hint}"))
        if not column.nullable:
            nulls = numbers[f"nulls{i}"]
            checks.append(Check("not_null", FAIL if nulls else PASS, name, "0 nulls", f"{nulls:,} nulls", f"{name} has {nulls:,} nulls"))
        if column.unique:
            more = repeats[i]
            checks.append(Check("unique", FAIL if more else PASS, name, "all values distinct",
                                f"{more:,} duplicate value(s)", f"{name} repeats {more:,} value(s)"))
        if column.min_value is not None or column.max_value is not None:
            if not numbers.get(f"numbers{i}"):
                checks.append(Check("value_range", SKIP, name, message=f"{name} holds no numbers"))
            else:
                below, above = numbers.get(f"below{i}", 0), numbers.get(f"above{i}", 0)
                checks.append(Check("value_range", FAIL if below + above else PASS, name,
                                    f"{_dash(column.min_value)} to {_dash(column.max_value)}",
                                    f"min {numbers[f'min{i}']}, max {numbers[f'max{i}']}",
                                    f"{name}: {below:,} below, {above:,} above the range"))
        if column.allowed_values:
            count, listed = strays.get(i, (0, []))
            shown = ", ".join(listed) + (f", ... and {count - len(listed)} more" if count > len(listed) else "")
            checks.append(Check("allowed_values", FAIL if count else PASS, name,
                                ", ".join(sorted(set(column.allowed_values))), shown or None,
                                f"{name}: {count} value(s) not permitted"))
    if contract.unique_key:
        joined = " + ".join(contract.unique_key)
        if not key_present:
            gone = [k for k in contract.unique_key if k not in df.columns]
            checks.append(Check("unique_key", SKIP, message=f"key {joined} not checked: {', '.join(gone)} absent"))
        else:
            more = repeats[whole_key]
            checks.append(Check("unique_key", FAIL if more else PASS, None, f"{joined} identifies a row",
                                f"{more:,} duplicate key(s)", f"key {joined} repeats on {more:,} row(s)"))
    return Validation(contract.name, tuple(checks))


def infer_contract(df: DataFrame, name: str, checksum: str | None = None,
                   generated_from: str | None = None) -> tuple[Contract, dict[str, list[str]]]:
    """Draft a contract from one delivery, with a note on every guess. It holds on that delivery."""
    if not df.columns:
        raise ContractError("a delivery without columns describes nothing")
    counters = {r["header"]: r for r in column_counters(df).collect()}
    rows = counters[df.columns[0]]["row_count"]
    # Only a column that the sketch finds near unique, or nearly a closed set, can be either: its error is a
    # few per cent, and none for a handful of values. Those alone have their values counted.
    likely = [c for c in df.columns if (filled := rows - counters[c]["null_count"]) and (
        counters[c]["approx_distinct"] >= 0.7 * filled or counters[c]["approx_distinct"] <= 2 * CATEGORY_MAX_VALUES)]
    distinct = {r["column_index"]: r["distinct_count"]
                for r in distinct_values(value_frequencies(df, likely)).collect()} if likely else {}
    texts = [i for i, c in enumerate(df.columns) if counters[c]["dtype"] == "String"
             and rows >= CATEGORY_MIN_ROWS and 0 < distinct.get(i, 0) <= CATEGORY_MAX_VALUES]
    allowed: dict[int, list[str]] = {}
    if texts:
        closed = value_frequencies(df, [df.columns[i] for i in texts])
        for row in closed.select("column_index", "value").collect():
            allowed.setdefault(row["column_index"], []).append(row["value"])
    columns, notes = [], {}
    for i, header in enumerate(df.columns):
        facts = counters[header]
        filled, values = rows - facts["null_count"], distinct.get(i, 0)
        said = []
        if not facts["null_count"]:
            said.append(f"no nulls in {rows:,} rows, hence not-null")
        unique = filled > 0 and values == filled and rows > 1
        if unique:
            said.append(f"all {values:,} values differ, hence unique; a coincidence is possible")
        if i in allowed:
            said.append(f"{values} distinct values, hence a closed set; drop it if it is open")
        if facts["dtype"] == "String" and filled and facts["delivery_numbers"] >= 0.8 * filled:
            said.append("WARNING: looks like numbers stored as text")
        columns.append(ColumnContract(header, facts["dtype"], nullable=facts["null_count"] > 0, unique=unique,
                                      allowed_values=sorted(allowed[i]) if i in allowed else None))
        if said:
            notes[header] = said
    key = [c.name for c in columns if c.unique and not c.nullable][:1]
    contract = Contract(name, columns, min_rows=int(rows * 0.5), max_rows=int(rows * 1.5) + 1, unique_key=key,
                        checksum=checksum, checksum_mode="warn", generated_from=generated_from)
    return contract, notes


# Contract type drafted for each profiled type, loosened on purpose.
SKETCH_TYPES = {
    "integer": "Float64", "float": "Float64", "boolean": "Boolean", "string": "String",
    "date": "Any", "datetime": "Any", "time": "Any", "duration": "Any",
}
SKETCH_OMITTED = {
    "empty": "no value in any row",
    "mixed": "more than one kind of value",
    "error": "nothing but error values",
    "other": "values of no known kind",
}
SKETCH_FACTOR = 4
SKETCH_MIN_ROWS = 20

PROFILE_KINDS = {name: "integer" for name in INTEGER_NAMES} | {name: "float" for name in FLOAT_NAMES} | {
    "String": "string", "Boolean": "boolean", "Date": "date", "Datetime": "datetime", "Time": "time",
    "Duration": "duration"}


def sketch_contract(profile_rows: list, name: str, truncated: bool = False,
                    totals_row: bool = False) -> tuple[Contract, list[str]]:
    """A looser draft from a stored profile: returns the contract and what was left out, with reasons."""
    columns, omitted, key = [], [], None
    rows = max((r["row_count"] for r in profile_rows), default=0)
    for row in sorted(profile_rows, key=lambda r: r["column_index"]):
        header = " ".join((row["header"] or "").split())
        kind = PROFILE_KINDS.get(row["dtype"], row["dtype"])
        if row["row_count"] and row["null_count"] == row["row_count"]:
            kind = "empty"
        elif kind == "string" and row["row_count"] - row["null_count"] == row["error_values"] > 0:
            kind = "error"
        if not header:
            omitted.append(f"column {row['column_index'] + 1}: no header")
        elif any(c.name == header for c in columns):
            omitted.append(f"{header}: the header stands twice")
        elif kind not in SKETCH_TYPES:
            omitted.append(f"{header}: {SKETCH_OMITTED.get(kind, SKETCH_OMITTED['other'])}")
        else:
            whole = row["row_count"] > 1 and row["null_count"] == 0 and row["distinct_count"] == row["row_count"]
            is_key = key is None and kind in ("string", "integer") and whole and row["distinct_exact"]
            key = header if is_key else key
            columns.append(ColumnContract(header, SKETCH_TYPES[kind], nullable=not is_key, unique=is_key))
    if not columns:
        raise ContractError(f"no column could be described: {'; '.join(omitted) or 'none profiled'}")
    if totals_row and rows:
        rows -= 1
    low = high = None
    if rows >= SKETCH_MIN_ROWS:
        low, high = rows // SKETCH_FACTOR, None if truncated else rows * SKETCH_FACTOR
    return Contract(name, columns, min_rows=low, max_rows=high, unique_key=[key] if key else [],
                    checksum_mode="ignore"), omitted
