import datetime as dt
import math

import pytest
from pyspark.sql import functions as F, types as T

from tieout import functions as X
from tieout.errors import ArgumentError, RenderError
from tieout.functions.sqltext import script

# What a spreadsheet shows for (value, digits).
ROUND = [(0.5, 0, 1.0), (1.5, 0, 2.0), (2.5, 0, 3.0), (-0.5, 0, -1.0), (-2.5, 0, -3.0), (2.15, 1, 2.2), (2.149, 1, 2.1),
         (-1.475, 2, -1.48), (21.5, -1, 20.0), (626.3, -3, 1000.0), (1.98, -1, 0.0), (-50.55, -2, -100.0), (2.675, 2, 2.68),
         (1.005, 2, 1.01), (0.045, 2, 0.05), (0.135, 2, 0.14), (1250.0, -2, 1300.0), (-0.2, 0, 0.0), (12345.6789, 4, 12345.6789),
         (1e15 + 0.5, 0, 1e15 + 1), (4491760.574999999, 2, 4491760.58)]
ROUNDUP = [(3.2, 0, 4.0), (76.9, 0, 77.0), (3.14159, 3, 3.142), (-3.14159, 1, -3.2), (31415.92654, -2, 31500.0), (-1.1, 0, -2.0),
           (5.0, 0, 5.0), (0.1 + 0.2, 1, 0.3)]
ROUNDDOWN = [(3.2, 0, 3.0), (76.9, 0, 76.0), (3.14159, 3, 3.141), (-3.14159, 1, -3.1), (31415.92654, -2, 31400.0), (-1.9, 0, -1.0),
             (-0.5, 0, 0.0), (2.9999999999999996, 0, 3.0)]


@pytest.mark.parametrize("function,cases", [(X.round_half_away, ROUND), (X.round_up, ROUNDUP), (X.round_down, ROUNDDOWN)])
def test_rounding_matches_the_sheet(spark, function, cases):
    frame = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(cases)], "n int, x double")
    for digits in {d for _, d, _ in cases}:
        got = {r["n"]: r["y"] for r in frame.select("n", function(F.col("x"), digits).alias("y")).collect()}
        for i, (value, d, want) in enumerate(cases):
            if d == digits:
                assert got[i] == want, (value, d)
                assert math.copysign(1, got[i]) == 1 or got[i] != 0


def test_rounding_keeps_null_and_very_large_whole_numbers(values):
    assert values([None, 1e20, -1e20, 2.0**53 + 2], "double", X.round_half_away) == [None, 1e20, -1e20, 2.0**53 + 2]


@pytest.mark.parametrize("digits", [16, -16, True, 1.0])
def test_rounding_refuses_odd_digits(spark, digits):
    with pytest.raises(ArgumentError):
        X.round_half_away(F.lit(1.0), digits)


# A, b, a+b, a-b, a*b with empty cells.
EMPTY = [(1.0, 2.0, 3.0, -1.0, 2.0), (1.0, None, 1.0, 1.0, 0.0), (None, 3.0, 3.0, -3.0, 0.0), (None, None, 0.0, 0.0, 0.0), (-4.5, None, -4.5, -4.5, 0.0)]
DIVISION = [(6.0, 2.0, 3.0), (6.0, 0.0, None), (0.0, 0.0, None), (6.0, None, None), (None, 2.0, 0.0), (None, None, None), (1.0, float("nan"), None)]


def test_arithmetic_with_empty_cells(spark):
    frame = spark.createDataFrame([r[:2] for r in EMPTY], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in frame.select("a", "b", X.add(a, b), X.sub(a, b), X.mul(a, b)).collect()]
    assert got == EMPTY
    assert [r[0] for r in frame.select(X.sum_horizontal("a", b)).collect()] == [r[2] for r in EMPTY]


def test_division_never_gives_infinity(spark):
    frame = spark.createDataFrame([r[:2] for r in DIVISION], "a double, b double")
    assert [r[0] for r in frame.select(X.div(F.col("a"), F.col("b"))).collect()] == [r[2] for r in DIVISION]


def test_text_that_is_no_number_is_not_an_empty_cell(values):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        values(["abc"], "string", X.empty_as_zero)


def test_a_bare_string_is_no_operand():
    with pytest.raises(ArgumentError):
        X.add("a", 1)


# Displayed text and the number it stands for.
TEXT = [("1", 1.0), ("-7", -7.0), ("+8", 8.0), ("1e3", 1000.0), (" 3 ", 3.0), (" 5 ", 5.0), (" 6", 6.0), ("1,234.56", 1234.56),
        ("$5.00", 5.0), ("£1,000.50", 1000.5), ("€9", 9.0), ("12%", 0.12), ("-50%", -0.5), ("(6)", -6.0), ("($20.00)", -20.0), ("(6", None),
        ("6)", None), ("abc", None), ("", None), (None, None), ("1.2.3", None), ("#DIV/0!", None), ("12-34", None), ("12 345", 12345.0),
        ("5$", 5.0), ("1d", None), ("NaN", None), ("inf", None), ("(", None), ("()", None), ("%", None)]


def test_text_numbers(values):
    assert values([t for t, _ in TEXT], "string", X.to_number) == [n for _, n in TEXT]


def test_errors(values):
    assert values([None, 1.0, float("nan"), float("inf")], "double", X.is_error) == [True, False, True, True]
    assert values([None, "1.5", "x", "1d"], "string", X.is_error) == [True, False, True, True]
    assert values([None, 1.0, float("nan")], "double", lambda c: X.iferror(c, 0.0)) == [0.0, 1.0, 0.0]
    assert values(["#N/A", "7", None], "string", X.error_text_to_null) == [None, "7", None]


def test_decimals_and_last_digit(values):
    assert values([4491760.58, 120.0, 0.0, 1e-7, 1e15, None, float("inf"), 0.1 + 0.2], "double", X.decimals_retained) == [2, 0, 0, None, None, None, None, 1]
    assert values([1.27, -1.24, 2.0**53, None], "double", lambda c: X.last_digit(c, 2)) == [7, 4, None, None]


def test_tolerance(spark):
    frame = spark.createDataFrame([(1.0, 1.0 + 1e-7), (1.0, 1.1), (0.0, 1e-3), (100.0, 100.5), (1.0, None), (1.0, float("nan")), (float("inf"), float("inf"))], "e double, a double")
    assert [r[0] for r in frame.select(X.within_tolerance(F.col("e"), F.col("a"), 1e-6, 0.01)).collect()] == [True, False, False, True, False, False, False]


def test_signed_delta_of_dates_is_in_days(spark):
    frame = spark.createDataFrame([(dt.date(2024, 1, 1), dt.datetime(2024, 1, 2, 12))], "e date, a timestamp_ntz")
    assert frame.select(X.signed_delta(F.col("e"), F.col("a"), T.DateType(), T.TimestampNTZType())).first()[0] == 1.5
    assert frame.select(X.signed_delta(F.lit(True), F.lit(1), T.BooleanType(), T.IntegerType())).first()[0] is None


# Serials of the 1900 date system.
SERIALS = [(1.0, dt.date(1900, 1, 1)), (59.0, dt.date(1900, 2, 28)), (60.0, None), (61.0, dt.date(1900, 3, 1)), (25569.0, dt.date(1970, 1, 1)),
           (45000.9, dt.date(2023, 3, 15)), (2958465.0, dt.date(9999, 12, 31)), (2958466.0, None), (0.0, None), (-1.0, None), (None, None)]


def test_serial_dates(values):
    assert values([s for s, _ in SERIALS], "double", X.serial_to_date) == [d for _, d in SERIALS]
    assert values([dt.date(1900, 2, 28), dt.date(1900, 3, 1), dt.date(1899, 12, 31), None], "date", X.date_to_serial) == [59, 61, None, None]
    assert values([45000.25, 59.5, 60.5, 0.5, None], "double", X.serial_to_datetime) == [
        dt.datetime(2023, 3, 15, 6), dt.datetime(1900, 2, 28, 12), None, None, None]


def test_serials_go_there_and_back(values):
    serials = [float(s) for s in [*range(1, 60), *range(61, 400), 40000, 2958465]]
    assert values(serials, "double", lambda c: X.date_to_serial(X.serial_to_date(c))) == [int(s) for s in serials]


def test_zoned_timestamps_become_naive_utc(spark):
    frame = spark.createDataFrame([(1,)], "n int").select(F.to_timestamp(F.lit("2024-06-01 12:00:00+02:00")).alias("t"), F.lit(1).alias("n"))
    assert X.to_naive_utc(frame).first()["t"] == dt.datetime(2024, 6, 1, 10)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert X.to_naive_utc(frame).first()["t"] == dt.datetime(2024, 6, 1, 10)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_value_shapes(values):
    assert values(["1,234", "(5%)", "x", "-", "", None, "£ 7_000"], "string", X.looks_numeric) == [True, True, False, False, False, None, True]
    assert values(["1,234.50", "12,34", "£5", "1e5", "5 apples"], "string", X.numeric_text_shape) == [True, False, True, True, False]
    assert values(["2024-01-31", "31/01/2024", "31.1.24", "31 Jan 2024", "January 31, 2024", "soon"], "string", X.date_text_layout) == [
        "iso", "slash", "dotted", "named-month", "month-first", None]
    assert values(["#n/a", "text", None, " #DIV/0! "], "string", lambda c: X.value_kind(c, T.StringType())) == ["error", "string", "empty", "error"]


def test_hash_is_stable(values):
    assert values(["a", None], "string", X.hash_value) == ["sha256:ca978112ca1b", "sha256:null"]
    with pytest.raises(ArgumentError):
        X.hash_value(F.lit("a"), 3)


MASKED = [
    ("Server=db;Password=hunter2;Timeout=5", "Server=db;Password=***REDACTED***;Timeout=5"),
    ("Jet OLEDB:Database Password={a;b};X=1", "Jet OLEDB:Database Password=***REDACTED***;X=1"),
    ("Client-Secret = abc", "Client-Secret=***REDACTED***"),
    ("https://h/p?sig=abc&x=1", "https://h/p?sig=***REDACTED***&x=1"),
    ("Authorization: Bearer abcdefghij", "Authorization: Bearer ***REDACTED***"),
    ("ftp://joe:pw@host/x", "ftp://***REDACTED***@host/x"),
    ("monkey business", "monkey business"), (None, None), ("", "")]


def test_secrets_are_masked(values):
    assert values([t for t, _ in MASKED], "string", X.mask_secrets) == [m for _, m in MASKED]


def test_sql_literals(spark):
    row = (None, True, 7, 1234567.5, 1e-7, 1.5e22, dt.date(2026, 6, 30), dt.datetime(2026, 6, 30, 1, 2, 3), "O'Brien")
    frame = spark.createDataFrame([row], "a string, b boolean, c int, d double, e double, f double, g date, h timestamp_ntz, i string")
    frame = frame.withColumns({"j": F.lit("12.30").cast("decimal(9,2)"), "k": F.lit("0.00000001").cast("decimal(12,8)")})
    got = frame.select([X.sql_literal(F.col(f.name), f.dataType) for f in frame.schema.fields]).first()
    assert list(got) == ["NULL", "TRUE", "7", "1234567.5", "0.0000001", "15000000000000000000000", "DATE '2026-06-30'",
                         "TIMESTAMP '2026-06-30 01:02:03'", "'O''Brien'", "12.30", "0.00000001"]
    with pytest.raises(RenderError):
        X.sql_literal(F.col("x"), T.ArrayType(T.IntegerType()))
    with pytest.raises(Exception, match="non-finite"):
        spark.createDataFrame([(float("nan"),)], "x double").select(X.sql_literal(F.col("x"), T.DoubleType())).collect()


def test_statements(spark):
    frame = spark.createDataFrame([(1, "it's")], "id int, note string")
    assert X.render_statements(frame, "SET n={note} WHERE id={id}").first()[0] == "SET n='it''s' WHERE id=1"
    with pytest.raises(RenderError, match="nope"):
        X.render_statements(frame, "{nope}")
    with pytest.raises(RenderError, match="more than 2"):
        X.render_statements(spark.range(3).withColumn("note", F.lit("x")), "{id}", limit=2)
    assert script(["a", "b;"], header="one\n\ntwo") == "-- one\n--\n-- two\na;\nb;"


def test_note_text_passes_null_on(spark):
    frame = spark.createDataFrame([("Acme",), (None,)], "n string")
    assert [r[0] for r in frame.select(X.note_text("uplift for {}!", F.col("n"))).collect()] == ["uplift for Acme!", None]


def test_naive_timestamps_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 does not exist on this day in that zone.
        frame = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 0, 500000), dt.datetime(2024, 3, 10, 4, 30, 0, 500000))], "a timestamp_ntz, b timestamp_ntz")
        kind = T.TimestampNTZType()
        row = frame.select(X.signed_delta(F.col("a"), F.col("b"), kind, kind), X.sql_literal(F.col("a"), kind),
                           X.date_to_serial(F.col("a")), X.serial_to_datetime(F.lit(45361.5))).first()
        assert tuple(row) == (2 / 24, "TIMESTAMP '2024-03-10 02:30:00.500000'", 45361, dt.datetime(2024, 3, 10, 12))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
