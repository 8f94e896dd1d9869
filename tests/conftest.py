import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tieout.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", shuffle_partitions=4, driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Lower the row count from which a group is cut into slices."""
    def lower(rows: int) -> None:
        spark.conf.set("spark.tieout.hotRows", str(rows))
    yield lower
    spark.conf.unset("spark.tieout.hotRows")


@pytest.fixture
def values(spark):
    """Evaluate an expression over a one-column frame, in order."""
    def run(rows, dtype, expression):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame(list(enumerate(rows)), f"n int, x {dtype}")
        return [r["y"] for r in frame.select("n", expression(F.col("x")).alias("y")).orderBy("n").collect()]
    return run
