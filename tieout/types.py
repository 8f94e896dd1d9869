"""Names of column types as contracts and profiles spell them."""

from __future__ import annotations

from pyspark.sql import types as T

# Type names used in contracts and profiles.
INTEGER_NAMES = ["Int8", "Int16", "Int32", "Int64", "Int128", "UInt8", "UInt16", "UInt32", "UInt64"]
FLOAT_NAMES = ["Float32", "Float64", "Decimal"]
NUMBER_NAMES = INTEGER_NAMES + FLOAT_NAMES
TEMPORAL_NAMES = ["Date", "Datetime", "Time", "Duration"]
ANY_NAMES = ["Any", "any", "*"]

NAMES = {
    T.ByteType: "Int8", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64",
    T.FloatType: "Float32", T.DoubleType: "Float64", T.DecimalType: "Decimal",
    T.StringType: "String", T.BooleanType: "Boolean", T.DateType: "Date",
    T.TimestampType: "Datetime", T.TimestampNTZType: "Datetime",
    T.DayTimeIntervalType: "Duration", T.BinaryType: "Binary",
    T.ArrayType: "List", T.StructType: "Struct", T.MapType: "Map", T.NullType: "Null",
}


def dtype_name(dtype: T.DataType) -> str:
    for kind, name in NAMES.items():
        if type(dtype) is kind or (kind is T.StringType and isinstance(dtype, T.StringType)):
            return name
    return "Time" if dtype.typeName().startswith("time") else dtype.typeName().capitalize()


def dtype_satisfies(actual: str, expected: str) -> bool:
    """Exact, save that a whole number meets a float and anything meets ``Any``."""
    return (expected in ANY_NAMES or actual == expected
            or (actual in INTEGER_NAMES and expected in FLOAT_NAMES))
