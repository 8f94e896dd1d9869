import datetime as dt

import pytest
from pyspark.sql import functions as F

from tieout.errors import ArgumentError, UnknownPatternError
from tieout.functions import aggregates as A, sheet as S
from tieout.operators import formulas, ranked

D = dt.date


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def day(year, month, number):
    return F.lit(D(year, month, number))


def test_text(spark):
    assert one(spark, S.proper(F.lit("o'NEIL-smith 2nd"))) == "O'Neil-Smith 2Nd"
    assert one(spark, S.trim(F.lit("  a   b "))) == "a b"
    assert one(spark, S.text(F.lit(1234.565), "#,##0.00")) == "1,234.57"
    assert one(spark, S.text(F.lit(0.125), "0%")) == "13%"
    assert one(spark, S.text(day(2024, 2, 3), "dd/mm/yyyy")) == "03/02/2024"
    assert one(spark, S.find("z", F.lit("abc"))) is None
    assert one(spark, S.search("B", F.lit("abc"))) == 2
    assert one(spark, S.replace(F.lit("abcdef"), 2, 3, "*")) == "a*ef"
    assert one(spark, S.clean(F.lit("a\tb\x07"))) == "ab"
    assert one(spark, S.textjoin("-", F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == "a-b"
    with pytest.raises(UnknownPatternError):
        S.text(F.lit(1), "[Red]0")


def test_dates(spark):
    assert one(spark, S.date(F.lit(2024), F.lit(14), F.lit(0))) == D(2025, 1, 31)
    assert one(spark, S.date(F.lit(108), F.lit(1), F.lit(2))) == D(2008, 1, 2)
    assert one(spark, S.eomonth(day(2024, 1, 31), 1)) == D(2024, 2, 29)
    assert one(spark, S.datedif(day(2024, 1, 31), day(2024, 2, 29), "M")) == 0
    assert one(spark, S.datedif(day(2020, 2, 29), day(2024, 2, 28), "Y")) == 3
    assert one(spark, S.datedif(day(2024, 2, 1), day(2024, 1, 1), "D")) is None
    assert one(spark, S.weeknum(day(2024, 1, 6))) == 1
    assert one(spark, S.weeknum(day(2024, 1, 7))) == 2
    assert one(spark, S.datevalue(F.lit("nope"))) is None


def reference_workday(start, count, holidays):
    step, at = (1 if count > 0 else -1), start
    while count:
        at += dt.timedelta(step)
        if at.weekday() < 5 and at not in holidays:
            count -= step
    return at


def test_workdays_against_counting(spark):
    holidays = [D(2024, 1, 1), D(2024, 3, 29), D(2024, 4, 1), D(2024, 5, 4)]
    starts = [D(2024, 1, 1) + dt.timedelta(3 * i) for i in range(45)]
    frame = spark.createDataFrame([(s,) for s in starts], "d date")
    for count in (-12, -1, 0, 1, 7, 30):
        got = [r[1] for r in frame.select("d", S.workday(F.col("d"), count, holidays)).orderBy("d").collect()]
        assert got == [reference_workday(s, count, holidays) for s in starts], count
    got = [r[1] for r in frame.select("d", S.networkdays(F.col("d"), F.date_add("d", 40), holidays)).orderBy("d").collect()]
    assert got == [sum((s + dt.timedelta(i)).weekday() < 5 and (s + dt.timedelta(i)) not in holidays for i in range(41)) for s in starts]
    assert one(spark, S.networkdays(day(2024, 1, 5), day(2024, 1, 1))) == -5


def test_yearfrac(spark):
    a, b = day(2012, 1, 1), day(2012, 7, 30)
    assert one(spark, S.yearfrac(a, b)) == pytest.approx(0.58055556)
    assert one(spark, S.yearfrac(a, b, 1)) == pytest.approx(0.57650273)
    assert one(spark, S.yearfrac(a, b, 3)) == pytest.approx(0.57808219)
    with pytest.raises(UnknownPatternError):
        S.yearfrac(a, b, 9)


def test_aggregates_over_cells(spark):
    frame = spark.createDataFrame([("1",), ("2.5",), ("x",), ("TRUE",), ("",), (None,)], "c string")
    got = frame.agg(A.count(F.col("c")), A.counta(F.col("c")), A.countblank(F.col("c")), A.averagea(F.col("c"))).first()
    assert list(got) == [2, 5, 2, pytest.approx(4.5 / 5)]


def test_ranked_aggregates(spark, hot):
    import random

    random.seed(5)
    rows = [("big" if i % 3 else "small", float(random.randint(1, 60))) for i in range(900)]
    frame = spark.createDataFrame(rows, "g string, v double")
    for threshold in (10**9, 10):
        hot(threshold)
        got = {r["g"]: r["p"] for r in ranked.percentile_by(frame, ["g"], "v", 0.37, "p").collect()}
        for name in ("big", "small"):
            ordered = sorted(v for g, v in rows if g == name)
            at = 0.37 * (len(ordered) - 1)
            low = ordered[int(at)]
            assert got[name] == pytest.approx(low + (ordered[int(at) + 1] - low) * (at - int(at)))
    ties = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("a", 1), ("a", 9), ("a", None)], "g string, v int")
    assert ranked.mode_by(ties, ["g"], "v").first()["mode"] == 1
    assert ranked.kth_value(ties, ["g"], "v", 2).first()["kth"] == 2
    assert ranked.kth_value(ties, [], "v", 5, largest=False).first()["kth"] == 9
    with pytest.raises(ArgumentError):
        ranked.kth_value(ties, ["g"], "v", 0)


def test_textjoin_is_whole_unless_a_length_is_asked_for(spark):
    frame = spark.range(400).select((F.col("id") % 2).alias("g"), "id", F.when(F.col("id") % 2 == 0, F.repeat(F.lit("x"), 200)).otherwise("y").alias("t"))
    got = {r["g"]: r["joined"] for r in ranked.textjoin_by(frame, ["g"], "t", ",", ["id"]).collect()}
    assert got[0] == ",".join(["x" * 200] * 200) and got[1] == ",".join("y" * 200)
    with pytest.raises(ArgumentError, match="40,199 characters"):
        ranked.textjoin_by(frame, ["g"], "t", ",", ["id"], max_length=32_767)


def test_ranks_beyond_the_few_that_spark_limits(spark):
    frame = spark.range(6000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 4).alias("v"))
    low = {r["g"]: r["kth"] for r in ranked.kth_value(frame, ["g"], "v", 1501, largest=False).collect()}
    high = {r["g"]: r["kth"] for r in ranked.kth_value(frame, ["g"], "v", 1501).collect()}
    values = sorted(i // 4 for i in range(0, 6000, 2))
    assert low == {0: values[1500], 1: values[1500]} and high == {0: values[-1501], 1: values[-1501]}
    assert ranked.kth_value(frame, ["g"], "v", 3001).count() == 0 == ranked.kth_value(frame, ["g"], "v", 3001, largest=False).count()


def test_pivot_parameters_and_mapping(spark):
    frame = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "r string, c string, v int")
    assert sorted(map(tuple, formulas.pivot(frame, ["r"], "c", ["x", "y"], F.sum("v")).collect())) == [("a", 1, 2), ("b", 3, None)]
    parameters = spark.createDataFrame([("rate", 0.5), ("twice", 1.0), ("twice", 2.0)], "parameter string, value double")
    assert one(spark, formulas.parameter_value(parameters, "rate")) == 0.5
    for name in ("none", "twice"):
        with pytest.raises(ArgumentError):
            formulas.parameter_value(parameters, name)
    assert one(spark, formulas.map_strict(F.lit("x"), {"x": "1"})) == "1"
    with pytest.raises(Exception, match="no mapping for q"):
        one(spark, formulas.map_strict(F.lit("q"), {"x": "1"}))


def test_unknown_shapes_and_functions_are_refused():
    with pytest.raises(UnknownPatternError):
        formulas.operators_for("unknown")
    for name in ("LAMBDA", "NOW", "rand"):
        with pytest.raises(UnknownPatternError):
            formulas.function_for(name)
    assert formulas.function_for("trim") is S.trim
    assert formulas.operators_for("prior_row")
