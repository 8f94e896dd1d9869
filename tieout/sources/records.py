"""Records of delimited text files whose quoted cells may hold line breaks, found in parallel.

A line break ends a record unless a quote is open there, and whether one is open depends on all text before it.
Every line of a split says only whether it turns that state, so the state at the start of each split is the parity
of what the splits before it add up to: a prefix sum over one row a split. With it each split finds its own records in
a second pass; a record that begins in an earlier split is named by the last record start before. Lines are written
once with their place, so that both passes, and whoever reads the records, speak of the same lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.errors import ReadError
from tieout.session import write_scratch

#: Where a line stands: its file, the offset of its split, and its number, which rises within a split.
PLACE = ["file", "block", "line"]
#: Lines of one record; beyond that a stray quote is taken for more likely.
MOST_LINES = 1_000_000


def placed_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``value, file, block, line, turns`` of every line, written once; ``turns`` is 1 where the quotes are odd."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return write_scratch(spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), (quotes % 2).cast("int").alias("turns")), "lines")


def below(lines: DataFrame, skip: int) -> DataFrame:
    """The lines without the first ``skip`` of every file."""
    if skip <= 0:
        return lines
    # Splits keep the order of lines, and only a file's first split can hold its first lines. One row a file, written, so
    # that Spark knows its size before it shuffles the lines.
    starts = write_scratch(lines.where("block = 0").groupBy(F.col("file").alias("first_file")).agg(F.min("line").alias("start")), "starts")
    return lines.join(starts, F.col("file") == F.col("first_file")).where(
        (F.col("block") > 0) | (F.col("line") - F.col("start") >= skip)).drop("first_file", "start")


def split_states(lines: DataFrame) -> DataFrame:
    """``file, block, open, turns`` for every split: whether a quote is open at its start, and how often it turns."""
    splits = lines.groupBy("file", "block").agg(F.sum("turns").alias("turns"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("file", "block", "turns", (F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2).alias("open"))


def _pieces(lines: DataFrame, states: DataFrame, most_lines: int) -> DataFrame:
    """``split, line, n, value``: the part of every record that stands in one split, under the line it begins with, null
    for the one that a split goes on with from earlier ones; ``n`` counts lines, of which ``most_lines`` at most are kept."""
    splits = states.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "split", "open")
    placed = lines.join(splits, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).select(
        "split", "open", "line", "turns", "value")
    within = Window.partitionBy("split").orderBy("line")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    up_to = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = (F.col("open") + F.coalesce(F.sum("turns").over(earlier), F.lit(0))) % 2 == 0
    started = placed.withColumns({"begins": begins, "number": F.row_number().over(within)}).withColumn(
        "start", F.max(F.when(F.col("begins"), F.struct("line", "number"))).over(up_to))
    kept = F.col("number") - F.coalesce("start.number", F.lit(0)) < most_lines
    # Rows stay where the window has put them: all lines of a record's piece are of one split.
    return started.groupBy("split", F.col("start.line").alias("line")).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(kept, F.struct(F.col("line").alias("at"), "value")))).alias("lines")).select(
        "split", "line", "n", F.array_join("lines.value", "\n").alias("value"))


def _refuse_open(lines: DataFrame, states: DataFrame) -> None:
    """Raise if a file ends with a quote open."""
    left = states.groupBy("file").agg(F.sum("turns").alias("n")).where("n % 2 = 1").agg(F.min("file")).first()[0]
    if left is not None:
        turning = lines.where((F.col("file") == left) & (F.col("turns") == 1))
        last = turning.orderBy(F.desc("block"), F.desc("line")).select("value").first()
        raise ReadError(f"{left}: a line leaves a quote open that no later one closes, the last to turn it is: {last['value'][:120]}")


def records(lines: DataFrame, most_lines: int = MOST_LINES) -> DataFrame:
    """``value, file, block, line`` of every record, placed where it begins; its line breaks are newlines.

    Where no line leaves a quote open this is the lines as they are. A file that ends with a quote open is refused, and
    so is a record of more than ``most_lines`` lines. An empty table gives an empty one.
    """
    states = write_scratch(split_states(lines).withColumn("split", F.monotonically_increasing_id()), "splits")
    if not states.where("turns > 0").take(1):
        return lines.select("value", *PLACE)
    _refuse_open(lines, states)
    quoted = write_scratch(states.where("turns > 0").select("file").distinct(), "quoted-files")
    pieces = write_scratch(_pieces(lines.join(quoted, "file", "left_semi"), states, most_lines), "pieces")
    # Of every split that goes on with a record, the last record start of the splits before.
    tops = states.join(pieces.groupBy("split").agg(F.max("line").alias("last"), F.count_if(F.col("line").isNull()).alias("goes_on")), "split")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = write_scratch(tops.withColumn("start", F.max("last").over(before)).where("goes_on > 0").select("split", "start"), "carried")
    starts = write_scratch(carried.select(F.col("start").alias("line")).distinct(), "carried-starts")
    heads = pieces.join(starts, "line", "left_semi").select("split", F.col("line").alias("start"), "n", "value")
    parts = write_scratch(heads.unionByName(
        pieces.where("line is null").join(carried, "split").select("split", "start", "n", "value")), "carried-pieces")
    place = states.select("split", "file", "block")
    inside = pieces.where(F.col("line").isNotNull()).select((F.col("n") - 1).alias("n"), "split")
    across = parts.groupBy("start").agg((F.sum("n") - 1).alias("n"), F.max("split").alias("split"))
    longest = inside.unionByName(across.select("n", "split")).groupBy("split").agg(F.max("n").alias("n")).join(place, "split").agg(
        F.max(F.struct("n", "file")).alias("most")).first()["most"]
    if longest and longest["n"] >= most_lines:
        raise ReadError(f"{longest['file']}: a quoted cell goes on for {longest['n']:,} lines")
    joined = parts.join(place, "split").groupBy("start").agg(
        F.array_sort(F.collect_list(F.struct("block", "value", "file"))).alias("p")).select(
        F.array_join("p.value", "\n").alias("value"), F.col("p")[0]["file"].alias("file"), F.col("p")[0]["block"].alias("block"),
        F.col("start").alias("line"))
    own = pieces.where(F.col("line").isNotNull()).join(starts, "line", "left_anti").join(place, "split").select("value", *PLACE)
    plain = lines.join(quoted, "file", "left_anti").select("value", *PLACE)
    return plain.unionByName(own).unionByName(joined)
