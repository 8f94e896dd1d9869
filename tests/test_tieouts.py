import datetime as dt

import pytest
from pyspark.sql import functions as F

from tieout.functions.numeric import round_half_away
from tieout.operators import acceptance, compare as C
from tieout.operators.diagnose import diagnose
from tieout.operators.status import Status, Tolerance, worst
from tieout.operators.verify import verify
from tieout.plans import signoff


def side(spark, rows, dtype="double"):
    return spark.createDataFrame(list(enumerate(rows, 1)), f"n bigint, v {dtype}")


def cells(spark, want, got, want_type="double", got_type="double", **options):
    return C.paired_cells(side(spark, want, want_type), side(spark, got, got_type), "v", "v", ordinal="n", **options)


def kinds(frame):
    return [(r["row"], r["kind"]) for r in frame.where("kind is not null").orderBy("row").collect()]


def region(spark, want, got, want_type="double", got_type="double", **options):
    return C.reconcile_region(C.Region("r", side(spark, want, want_type), "v", "v", actual=side(spark, got, got_type), ordinal="n", **options))


def causes(result):
    return [(d.cause, d.confidence) for d in result.diagnoses]


def test_only_passed_is_true():
    assert Status.PASSED and not Status.FAILED and not Status.NOT_RECONCILED
    assert worst([]) is Status.NOT_RECONCILED
    assert worst([Status.PASSED, Status.NOT_RECONCILED]) is Status.NOT_RECONCILED
    assert worst([Status.FAILED, Status.NOT_RECONCILED]) is Status.FAILED
    with pytest.raises(ValueError):
        C.RegionResult("r", Status.PASSED)
    with pytest.raises(ValueError):
        C.RegionResult("r", Status.NOT_RECONCILED)
    with pytest.raises(ValueError):
        Tolerance(-1)


def test_each_kind_of_difference(spark):
    assert kinds(cells(spark, [1.0, 2.0, 3.0, None, 5.0], [1.0, 2.1, None, 4.0, float("inf")])) == [(2, "value_differs"), (3, "actual_null"), (5, "non_finite")]
    assert kinds(cells(spark, [1.0], [1.0, 2.0])) == [(2, "extra_row")]
    assert kinds(cells(spark, [1.0, 2.0, None], [1.0])) == [(2, "missing_row")]
    assert kinds(cells(spark, ["#DIV/0!", "a", "b"], ["#DIV/0!", "a", "c"], "string", "string")) == [(1, "excel_error"), (3, "value_differs")]
    assert kinds(cells(spark, [1.0], ["1"], "double", "string")) == [(1, "type_differs")]
    assert kinds(cells(spark, [True, True], [True, False], "boolean", "boolean")) == [(2, "value_differs")]
    assert kinds(cells(spark, [True], [1.0], "boolean", "double")) == [(1, "type_differs")]
    assert kinds(cells(spark, [dt.date(2024, 1, 1)] * 2, [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)], "date", "timestamp_ntz")) == [(2, "value_differs")]


def test_the_worst_row_includes_matching_ones_and_the_first_of_equals(spark):
    counts = C.comparison_counts(cells(spark, [1.0, 2.0, 4.0], [1.5, 2.5, 4.0], tolerance=Tolerance(1.0))).first()
    assert (counts["status"], counts["worst_absolute_delta"], counts["worst_at"], counts["worst_relative_delta"]) == ("passed", 0.5, 1, 0.5)


def test_nothing_compared_is_never_a_pass(spark):
    assert region(spark, [None, None], [1.0, 2.0]).reason == "no_cached_values"
    assert region(spark, [], []).reason == "baseline_range_empty"
    assert region(spark, [1.0, None], [1.0, 2.0]).reason == "partial_cached_values"
    assert region(spark, [1.0], [1.0], truncated=True).reason == "baseline_truncated"
    assert region(spark, [1.0], [1.0]).status is Status.PASSED
    report = C.reconcile_many([])
    assert report.status is Status.NOT_RECONCILED and "no regions" in report.headline()


def test_regions_find_their_values_and_declare_what_they_do_not_reproduce(spark):
    want = side(spark, [1.0, 2.0])
    frames = {"short": side(spark, [1.0]), "_hidden": want, "right": side(spark, [1.0, 2.0])}
    report = C.reconcile_many([C.Region("a", want, "v", "v", ordinal="n"), C.Region("b", want, "v", "w", ordinal="n"), C.Region("c", None, "v", "v"),
                               C.Region("d", want, "v", "v", variable="short", ordinal="n")], frames, not_reproduced={"b": "on purpose"})
    assert [(r.id, r.status.value, r.reason) for r in report.regions] == [
        ("a", "passed", None), ("b", "not_reconciled", "not_reproduced"), ("c", "not_reconciled", "baseline_range_unreadable"), ("d", "failed", None)]
    assert [r.id for r in report.declared_not_reproduced] == ["b"]
    assert report.mismatches("d").count() == 1


# Exact ties at two decimals, and values just under one.
TIES = [2.625, 0.125, 5.625, 8.125, -2.625]
UNDER = [4491760.575 - 1e-9, 12345.675 - 1e-11, 1234.565 - 1e-12]


def rounded_sides(spark, operands, naive):
    frame = side(spark, operands).withColumns({"want": round_half_away(F.col("v"), 2), "got": naive})
    return C.reconcile_region(C.Region("r", frame, "want", "got", actual=frame, ordinal="n"))


def test_rounding_causes(spark):
    v = F.col("v")
    assert causes(rounded_sides(spark, TIES, F.bround(v, 2))) == [("rounding_mode", 0.9)]
    naive = F.floor(F.abs(v) * 100 + 0.5) / 100 * F.signum(v)
    assert causes(rounded_sides(spark, UNDER, naive)) == [("rounding_15_digit_collapse", 0.8)]
    assert causes(rounded_sides(spark, [1.2345, 7.8912], v)) == [("rounding_not_applied", 0.9)]
    assert causes(region(spark, [1.25, 2.5], [1.26, 2.505])) == [("rounding_mode", 0.6)]
    assert causes(region(spark, [1.25, 2.5], [7.0, 9.0])) == []


def test_other_causes(spark):
    assert causes(region(spark, [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, None])) == [("null_vs_empty", 0.75)]
    assert causes(region(spark, [1.0, 2.0], [None, None])) == [("text_formatted_number", 0.75), ("null_vs_empty", 0.55)]
    assert causes(region(spark, [1.0, 2.0], [float("inf"), float("nan")])) == [("divide_by_zero", 0.9)]
    assert causes(region(spark, ["#DIV/0!"], ["1"], "string", "string")) == [("divide_by_zero", 0.9)]
    assert causes(region(spark, [1.0], [1.0, 1.0, 2.0])) == [("join_key_not_unique", 0.85)]
    assert causes(region(spark, [1.0, 2.0], ["1", "2"], "double", "string")) == [("text_formatted_number", 0.85), ("date_serial_offset", 0.8)]
    days = [dt.date(2024, 1, 1), dt.date(2024, 5, 5)]
    assert causes(region(spark, days, [d + dt.timedelta(1) for d in days], "date", "date")) == [("date_serial_offset", 0.85)]
    assert causes(region(spark, days, [days[0] + dt.timedelta(1), days[1] + dt.timedelta(2)], "date", "date")) == []
    assert causes(region(spark, [45000.0], [dt.date(2023, 3, 15)], "double", "date")) == [("date_serial_offset", 0.8)]


def test_text_beside_number(spark):
    found = causes(region(spark, [1234.0, 3e9], ["1,234", "(3000000000)"], "double", "string"))
    assert ("text_formatted_number", 0.85) in found


def test_no_mismatches_no_causes(spark):
    assert diagnose(cells(spark, [1.0], [1.0]), 1, 1, 1) == []


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k string, amount double, note string")


BASE = [("a", 1.0, "x"), ("b", 2.0, None), ("c", 3.0, "z")]


def test_verify_passes_counts_and_breaks(spark):
    good = verify(keyed(spark, BASE), keyed(spark, BASE), ["k"])
    assert good and good.matched == 3 and good.compared_columns == ["amount", "note"]
    bad = verify(keyed(spark, BASE), keyed(spark, [("a", 1.5, "y"), ("b", None, None), ("d", 9.0, "q")]), ["k"])
    assert bad.status is Status.FAILED
    assert (bad.matched, bad.break_count, bad.missing_count, bad.unexpected_count) == (0, 3, 1, 1)
    assert [(r["k"], r["column"], r["predicted"], r["actual"], r["delta"]) for r in bad.shown_breaks()] == [
        ("a", "amount", "1.0", "1.5", 0.5), ("a", "note", "x", "y", None), ("b", "amount", "2.0", None, None)]
    assert [r[0] for r in bad.missing.collect()] == ["c"] and [r[0] for r in bad.unexpected.collect()] == ["d"]


@pytest.mark.parametrize("change,reason", [
    (dict(keys=[]), "no key"), (dict(keys=["zz"]), "no column zz"), (dict(columns=["nope"]), "not on both sides"),
    (dict(predicted=[]), "prediction is empty"), (dict(actual=[]), "delivery is empty"), (dict(actual=BASE + BASE[:1]), "repeats 1"),
    (dict(predicted=BASE + [(None, 1.0, ""), (None, 2.0, "")]), "repeats 1"), (dict(columns=["k"]), "share no value column")])
def test_verify_refuses_what_it_cannot_compare(spark, change, reason):
    v = verify(keyed(spark, change.get("predicted", BASE)), keyed(spark, change.get("actual", BASE)), change.get("keys", ["k"]), change.get("columns"))
    assert v.status is Status.NOT_RECONCILED and reason in v.reason and not v


def test_an_empty_key_matches_nothing(spark):
    rows = BASE + [(None, 5.0, "n")]
    v = verify(keyed(spark, rows), keyed(spark, rows), ["k"])
    assert (v.status, v.missing_count, v.unexpected_count) == (Status.FAILED, 1, 1)


def test_acceptance_is_cited_not_repeated(spark, tmp_path):
    path, calls = str(tmp_path / "acceptance"), []
    good = C.Region("r", side(spark, [1.0]), "v", "v", actual=side(spark, [1.0]), ordinal="n")
    def compare():
        calls.append(1)
        return C.reconcile_many([good])
    first = acceptance.check_or_cite(spark, path, "p", "sha-a", compare)
    other = acceptance.check_or_cite(spark, path, "p", "sha-b", compare)
    again = acceptance.check_or_cite(spark, path, "p", "sha-a", compare)
    assert first and again and not other and len(calls) == 2
    assert other.translation_accepted and other.status is Status.NOT_RECONCILED


def test_a_failed_comparison_is_not_accepted(spark, tmp_path):
    path = str(tmp_path / "acceptance")
    bad = C.Region("r", side(spark, [1.0]), "v", "v", actual=side(spark, [9.0]), ordinal="n")
    check = acceptance.check_or_cite(spark, path, "p", "a", lambda: C.reconcile_many([bad]))
    assert not check.translation_accepted and acceptance.latest_acceptance(spark, path, "p") is None


def test_worked_process(spark):
    plan = signoff.Adjustment("id", "amount", {"entity": ["E1"]}, {"state": "CANCELLED"}, 0.045, ("entity",), "uplift for {}", "entity")
    rows = [(1, "E1", "OPEN", 100.0), (2, "E1", "CANCELLED", 100.0), (3, "E2", "OPEN", 100.0), (4, "E1", "OPEN", None)]
    before = spark.createDataFrame(rows, "id int, entity string, state string, amount double")
    adjusted = signoff.adjust(before, plan)
    assert [(r["id"], r["before"], r["after"], r["note"]) for r in adjusted.orderBy("id").collect()] == [(1, 100.0, 104.5, "uplift for E1"), (4, 0.0, 0.0, "uplift for E1")]
    assert tuple(signoff.totals(adjusted).first()) == (2, 100.0, 4.5, 104.5)
    after = spark.createDataFrame([(1, "E1", "OPEN", 104.5), (4, "E1", "OPEN", None)], before.schema)
    v = signoff.verify_adjustment(adjusted, after, plan)
    assert (v.matched, v.break_count) == (1, 1)
