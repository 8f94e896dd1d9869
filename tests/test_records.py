"""Records over several lines, across splits, and typed columns that are filtered."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tieout.errors import ReadError
from tieout.functions.text import mask_secrets
from tieout.sources import records as R
from tieout.sources.delivery import read_data, read_delimited


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made_up(rng, rows):
    def cell():
        parts = [rng.choice(["a", "b c", '"', ",", "\n", "\n\n", "long " * 30, ""]) for _ in range(rng.randrange(4))]
        return "".join(parts) or "x"
    return [[str(n), cell(), f"v{n}", cell()] for n in range(rows)]


def write(path, rows, quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=quoting).writerows(rows)
    path.write_text(out.getvalue())


@pytest.mark.parametrize("seed", range(3))
def test_records_across_splits_are_those_of_one_reader(spark, tmp_path, small_splits, seed):
    rng, want = random.Random(seed), []
    for n in range(3):
        rows = made_up(rng, 120)
        want += rows
        head = [["a title\nof two lines", "", "", ""]] if n == 1 else []
        write(tmp_path / f"{n}.csv", [*head, ["n", "left", "v", "right"], *rows])
    lines = R.placed_lines(spark, str(tmp_path))
    assert lines.select("file", "block").distinct().count() > 20
    rows = read_delimited(spark, str(tmp_path), header_row=None)
    assert sorted(map(tuple, rows.select("n", "left", "v", "right").collect())) == sorted(map(tuple, want))
    # Places follow the file.
    first = rows.where(F.col("__position.file").endswith("0.csv")).orderBy("__position")
    assert [r["n"] for r in first.collect()] == [str(n) for n in range(120)]


def test_a_cell_longer_than_several_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {n}, 'of' many" for n in range(200))
    write(tmp_path / "x.csv", [["a", "b"], ["1", long], ["2", "short"], ["3", long + '"'], ["4", ""]])
    rows = read_data(spark, str(tmp_path))[0]
    assert {(r["a"], r["b"]) for r in rows.collect()} == {(1, long), (2, "short"), (3, long + '"'), (4, None)}


def test_open_quotes_and_endless_cells_are_refused(spark, tmp_path, small_splits):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n" + "1,x\n" * 200 + '2,"y\n' + "3,z\n" * 200)
    with pytest.raises(ReadError, match="quote open.*2,\"y"):
        read_data(spark, str(tmp_path))
    path.write_text('a,b\n1,"x\n' + "line\n" * 50 + '"\n')
    with pytest.raises(ReadError, match="goes on for 51 lines"):
        R.records(R.placed_lines(spark, str(path)), most_lines=50)
    path.write_text('a,b\n1,5" pipe\n2,7" pipe\n')
    with pytest.raises(ReadError, match="quote inside a cell"):
        read_data(spark, str(tmp_path))


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n")
    assert read_data(spark, str(tmp_path))[0].count() == 0
    (tmp_path / "y.csv").write_text('"a\nb",c\n')
    assert read_data(spark, str(tmp_path / "y.csv"))[0].columns == ["a\nb", "c"]


def test_typed_columns_can_be_filtered_joined_and_checked(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"{part}.csv").write_text("name,EAD,flag\n" + "".join(f"c{n},{n}.5,{str(n % 2 == 0).lower()}\n" for n in range(part * 20, part * 20 + 20)))
    rows = read_data(spark, str(tmp_path))[0]
    assert dict(rows.dtypes) == {"name": "string", "EAD": "double", "flag": "boolean"}
    assert rows.where("EAD > 49").count() == 11 and rows.where("EAD is not null and flag").count() == 30
    assert rows.dropna().count() == 60 and rows.groupBy("EAD").count().where("count > 1").count() == 0
    keys = spark.createDataFrame([(3.5, "three")], "EAD double, word string")
    assert [r["name"] for r in rows.join(keys, "EAD").collect()] == ["c3"]


def test_long_texts_are_masked(values):
    plain = "x" * 1_000_000
    got = values([f"key={plain};a=1", f"a=1;pwd='{plain}", 'p="' * 300_000, f"{plain} token=abc", f"https://{'u' * 9000}@h {plain}",
                  "token = " + "' " * 100_000, ";" + " " * 20_000 + "x", "a-" * 50_000 + "://u@h"], "string", mask_secrets)
    assert got[0] == "key=***REDACTED***;a=1" and got[1] == "a=1;pwd=***REDACTED***"
    assert got[3] == f"{plain} token=***REDACTED***" and got[4] == f"https://***REDACTED***@h {plain}"
    assert got[5].startswith("token =***REDACTED***") or got[5].startswith("token=***REDACTED***")
    assert values(["1-https://me:pw@h", "x://a b@c", "http://h/u@x"], "string", mask_secrets) == [
        "1-https://***REDACTED***@h", "x://a b@c", "http://h/u@x"]


def test_records_are_put_together_once_and_by_split(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("".join(f'{n},"x\ny {n}"\n' for n in range(400)))
    monkeypatch.setattr(R, "write_scratch", lambda df, name, write=R.write_scratch: (plans.update({name: df}), write(df, name))[1])
    plans = {}
    whole = R.records(R.placed_lines(spark, str(tmp_path)))
    assert whole.count() == 400
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # Whoever reads the records reads the written pieces; they are shuffled by split alone.
    assert "Window" not in text(whole) and "Window" in text(plans["pieces"])
    planned = plans["pieces"]._jdf.queryExecution().sparkPlan().toString() + plans["pieces"]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(split" in planned and "SortMergeJoin" not in planned and planned.count("Exchange hashpartitioning") == 1
