"""Inputs on which rows or digits must not be lost without a word."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tieout.errors import ArgumentError
from tieout.functions.text import MASK, mask_secrets
from tieout.operators import frames, lookups
from tieout.operators.compare import Region, reconcile_region
from tieout.operators.profile import profile
from tieout.operators.status import Status
from tieout.operators.verify import verify
from tieout.plans.delivery import file_hash
from tieout.sources import receipts
from tieout.sources.delivery import infer_types
from tieout.sources.files import list_files
from tieout.streaming.watch import watch


def test_grouped_allocation_keeps_null_groups_and_refuses_missing_totals(spark):
    rows = spark.createDataFrame([("a", 1, 1.004), ("a", 2, 2.004), (None, 3, 0.5), (None, 4, 0.6)], "g string, i int, v double")
    totals = spark.createDataFrame([("a", 3.01), (None, 1.11)], "g string, total double")
    got = frames.allocate_residual_by(rows, "v", totals, ["g"], ["i"])
    assert got.count() == 4 and sorted((r["g"] or "", r["s"]) for r in got.groupBy("g").agg(F.round(F.sum("v"), 2).alias("s")).collect()) == [("", 1.11), ("a", 3.01)]
    for bad in (totals.where("g = 'a'"), totals.unionByName(totals)):
        with pytest.raises(ArgumentError, match="total"):
            frames.allocate_residual_by(rows, "v", bad, ["g"], ["i"])
    with pytest.raises(ArgumentError, match="empty cells"):
        frames.allocate_residual_by(rows.withColumn("v", F.when(F.col("i") > 1, F.col("v"))), "v", totals, ["g"], ["i"])


def test_long_numbers_stay_text(spark):
    frame = spark.createDataFrame([("12345678901234567890", "1.5", "123456789012345678", "0.1234567890123456"),
                                   ("12345678901234567891", "2e3", "1", "1.0")], "a string, b string, c string, d string")
    assert [t for _, t in infer_types(frame).dtypes] == ["string", "double", "bigint", "string"]


@pytest.mark.parametrize("limit", [500, 0])
def test_probes_are_not_rounded_to_the_tables_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(lookups, "BAND_ROWS", limit)
    probe = spark.createDataFrame([(-2.5,), (1.999,), (2.0,)], "x double")
    whole = spark.createDataFrame([(-3, "c"), (-2, "b"), (2, "a")], "k int, v string")
    got = {r["x"]: r["v"] for r in lookups.lookup_nearest(probe, whole, "x", "k", {"v": "v"}).collect()}
    assert got == {-2.5: "c", 1.999: "b", 2.0: "a"}
    exact = spark.createDataFrame([(Decimal("1.00"), "one"), (Decimal("2.00"), "two")], "k decimal(5,2), v string")
    fine = spark.createDataFrame([(Decimal("1.999"),)], "x decimal(10,3)")
    assert lookups.lookup_nearest(fine, exact, "x", "k", {"v": "v"}).first()["v"] == "one"
    tied = spark.createDataFrame([(1, None, "null tie"), (1, 3, "last"), (1, 2, "middle")], "k int, o int, v string")
    one = spark.createDataFrame([(1,)], "x int")
    assert lookups.lookup_nearest(one, tied, "x", "k", {"v": "v"}, order=["o"]).first()["v"] == "last"


def test_an_order_with_ties_is_not_reconciled(spark):
    side = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 7.0)], "o int, v double")
    region = Region("r", side, "v", "v", actual=side, order=("o",))
    found = reconcile_region(region)
    assert found.status is Status.NOT_RECONCILED and found.reason == "order_not_unique"
    assert reconcile_region(Region("r", side, "v", "v", actual=side, order=("o", "v"))).status is Status.PASSED


def test_wide_whole_numbers_and_decimals_are_compared_exactly(spark):
    left = spark.createDataFrame([(1, 2**53, Decimal("9007199254740992.01"))], "k int, n long, d decimal(20,2)")
    right = spark.createDataFrame([(1, 2**53 + 1, Decimal("9007199254740992.02"))], "k int, n long, d decimal(20,2)")
    report = verify(left, right, ["k"])
    assert report.status is Status.FAILED and report.break_count == 2
    assert {r["column"]: r["delta"] for r in report.shown_breaks()} == {"n": 1.0, "d": 0.01}
    assert verify(left, left, ["k"]).status is Status.PASSED


def test_folders_that_hold_files_twice_have_hashes_of_their_own(spark, tmp_path):
    for folder, text in (("a", "1"), ("b", "2"), ("c", "1")):
        (tmp_path / folder).mkdir()
        for n in range(2 if folder != "c" else 3):
            (tmp_path / folder / f"{n}.csv").write_text(text)
    assert len({file_hash(spark, str(tmp_path / f)) for f in "abc"}) == 3


def test_a_batch_run_again_hands_on_its_receipts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text("a,b\n1,2\n")
    files, store = list_files(spark, str(tmp_path / "in")), str(tmp_path / "store")
    when = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    first = receipts.receive(spark, files, store, batch="one", received_at=when).collect()
    again = receipts.receive(spark, files, store, batch="one", received_at=when).collect()
    assert first == again and len(first) == 1 and receipts.receive(spark, files, store).count() == 0
    handed = []

    def fails_once(added):
        handed.append(added.count())
        if len(handed) == 1:
            raise RuntimeError("callback")

    options = {"once": True, "on_received": fails_once}
    with pytest.raises(Exception, match="callback"):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "other"), str(tmp_path / "progress"), **options).awaitTermination()
    watch(spark, str(tmp_path / "in"), str(tmp_path / "other"), str(tmp_path / "progress"), **options).awaitTermination()
    assert handed == [1, 1]


def test_masking_stops_at_the_quote_around_it(values):
    rows = ['Extended Properties="a;Password=x";Y=1', "Password='a;b';Y=1", "pwd=se'cret;Y", 'x;token={a;b};Y=2', "Authorization: Bearer abcdefgh1=",
            "https://me:pw@host/x", "see api key = abc, please", None, "no secrets"]
    assert values(rows, "string", mask_secrets) == [
        f'Extended Properties="a;Password={MASK}";Y=1', f"Password={MASK};Y=1", f"pwd={MASK};Y", f"x;token={MASK};Y=2",
        f"Authorization: Bearer {MASK}", f"https://{MASK}@host/x", f"see api key={MASK}", None, "no secrets"]


def test_a_profile_means_the_same_at_every_size(spark):
    frame = spark.range(30_000).select("id", (F.col("id") % 3).alias("few"))
    rows = {r["header"]: r for r in profile(frame).collect()}
    assert rows["id"]["distinct_count"] == 30_000 and rows["id"]["distinct_exact"] and len(rows["id"]["top_k"]) == 10
    sketched = {r["header"]: r for r in profile(frame, exact=["few"]).collect()}
    assert not sketched["id"]["distinct_exact"] and sketched["id"]["top_k"] is None
    assert sketched["few"]["distinct_exact"] and len(sketched["few"]["top_k"]) == 3
