"""Profiles from hashes against counts of the values themselves, and profiles of cell tables."""

import random

import pytest
from pyspark.sql import functions as F

from tieout.operators import profile as P


@pytest.mark.parametrize("ties", [1000, 2])
def test_ranks_and_distinct_counts_from_hashes(spark, monkeypatch, ties):
    monkeypatch.setattr(P, "FEW_TIES", ties)
    rng = random.Random(ties)
    rows = [(rng.choice(["a", "A ", "b", None, "", "é"]), f"k{n:04d}", rng.choice([0.0, -0.0, 1.5, 2.5, None]), bytearray(b"x" * (n % 3)),
             f"v{min(n, 399) // 2}", "hot" if n < 150 else f"z{399 - n}", None) for n in range(400)]
    frame = spark.createDataFrame(rows, "few string, id string, num double, raw binary, twice string, skew string, none string").repartition(5)
    names = frame.columns
    counts = P.hash_counts(frame, names)
    plain = P.value_frequencies(frame, names)
    want = sorted(map(tuple, P.top_values(plain).select("column_index", "place", "value", "n").collect()))
    assert sorted(map(tuple, P.top_from_hashes(frame, names, counts).select("column_index", "place", "value", "n").collect())) == want
    distinct = ["column_index", "distinct_count", "filled", "case_variants"]
    assert sorted(map(tuple, P.distinct_from_hashes(counts).select(*distinct).collect())) == sorted(
        map(tuple, P.distinct_values(plain).select(*distinct).collect()))


def test_smallest_values_are_sought_until_enough_share_the_place(spark, monkeypatch):
    monkeypatch.setattr(P, "FEW_TIES", 2)
    # The values that stand twice come behind a thousand that stand once, so the first look finds none of them.
    rows = [(f"a{n:05d}",) for n in range(3000)] + [(f"z{n:05d}",) for n in range(40)] * 2
    frame = spark.createDataFrame(rows, "v string")
    top = P.top_from_hashes(frame, ["v"], P.hash_counts(frame, ["v"])).orderBy("place").collect()
    assert [(r["value"], r["n"]) for r in top] == [(f"z{n:05d}", 2) for n in range(10)]


def test_profile_of_an_empty_table_and_of_nulls(spark):
    empty = P.profile(spark.createDataFrame([], "a string, b int"), redact=["^b$"]).collect()
    assert [(r["row_count"], r["distinct_count"], r["top_k"]) for r in empty] == [(0, 0, None)] * 2
    nulls = P.profile(spark.createDataFrame([(None, 1)], "a string, b int")).orderBy("column_index").collect()
    assert [(r["distinct_count"], r["top_k"] and r["top_k"][0]["value"]) for r in nulls] == [(0, None), (1, "1")]


def test_cells_of_mixed_kinds(spark):
    rows = ([("x", "date", "2026-01-31")] * 3 + [("x", "string", "31/01/2026")] * 2 + [("x", "empty", None), ("x", None, None)]
            + [("y", "integer", "4"), ("y", "float", "-0.5"), ("y", "string", " n/a "), ("y", "error", "#N/A")]
            + [("z", "string", "1,200"), ("z", "string", "a b"), ("z", "string", "")] + [("w", "float", "inf"), ("w", "integer", "0")])
    found = {r["part"]: r for r in P.cell_profile(spark.createDataFrame(rows, "part string, kind string, value string"), ["part"]).collect()}
    assert found["x"]["dtype"] == "mixed" and found["x"]["null_count"] == 2 and found["x"]["kinds"] == {"date": 3, "string": 2}
    assert found["x"]["format_anomalies"] == ["mixed types: 3 date, 2 string", "text dates alongside real dates (beside 3 real ones)"]
    assert found["y"]["numeric"]["min"] == -0.5 and found["y"]["numeric"]["negative_count"] == 1 and found["y"]["dtype"] == "mixed"
    assert found["z"]["numeric"] is None and [a.split(" (")[0] for a in found["z"]["format_anomalies"]] == [
        "numbers stored as text", "non-breaking spaces", "empty strings"]
    assert found["w"]["numeric"]["max"] == 0.0 and found["w"]["numeric"]["zero_count"] == 1
