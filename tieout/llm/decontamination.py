"""Benchmark passages in documents: a prefix-filtered join of word windows, with DataFrame expressions only.

Every 13 consecutive words of a benchmark item are a window; a window occurs where all of its shingles of four
words stand in its order. As all must occur, the rarest of them alone decides where a window can be at all:
documents are joined with that one (the necessary prefix of a containment of one), its place gives the window's
start, which must leave room for the whole window in the document, and what is left is verified word by word
through shingles that cover the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm.common import ascii_lower, whole_text, words_between, write_scratch

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 13, 4
#: A benchmark's table of at most this many rows is broadcast; larger ones are joined by a shuffle.
BROADCAST_SHINGLES = 200_000
_WORDS = ["w1", "w2", "w3", "w4"]


def item_words(text: str) -> Column:
    return words_between(ascii_lower(whole_text(text)), BREAKS)


def _following(words: Column) -> Column:
    """Each word with the three after it, null beyond the end."""
    rest = [F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - k, F.lit(0))) for k in range(1, SHINGLE)]
    return F.arrays_zip(words, *rest).cast(f"array<struct<{','.join(f'{n}:string' for n in _WORDS)}>>")


def _sized(rows: DataFrame, words: str, sizes: list[int], *kept: str) -> DataFrame:
    """Shingles of the given sizes at every place of ``words``: ``kept``, ``pos`` from 0, ``w1`` to ``w4`` and a
    hash ``h``; the words beyond the size are null."""
    names = [F.col(n) for n in _WORDS]
    placed = rows.select(*kept, F.posexplode(_following(F.col(words))).alias("pos", "at")).select(*kept, "pos", "at.*")
    if sizes != [SHINGLE]:
        none = F.lit(None).cast("string")
        cut = F.array(*(F.struct(*((c if k < size else none).alias(n) for k, (c, n) in enumerate(zip(names, _WORDS, strict=True))),
                                 F.lit(size).alias("n_here")) for size in sizes))
        placed = placed.select(*kept, "pos", F.explode(cut).alias("s")).select(*kept, "pos", "s.*")
        placed = placed.where(F.size(F.array_compact(F.array(*names))) == F.col("n_here")).drop("n_here")
    else:
        placed = placed.where(F.col("w4").isNotNull())
    return placed.withColumn("h", F.xxhash64(*_WORDS))


def windows(benchmark: DataFrame) -> DataFrame:
    """``window`` (its words joined by blanks), ``words``, ``item`` (the id as text); one row for each pair."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), item_words("text").alias("w")).where(
        F.size("w") > 0)
    parts = F.when(F.size("w") < WINDOW, F.array("w")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.slice("w", i, WINDOW)))
    return words.select("item", F.explode(parts).alias("words")).select(
        F.array_join("words", " ").alias("window"), "words", "item").distinct()


def occurrences(documents: DataFrame, passages: DataFrame,
                broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """``doc_id, mark, start, window, length`` of every place where a window stands; ``mark`` hashes the text.

    ``passages`` is a written table from ``windows``.
    """
    each = write_scratch(passages.select("window", "words").distinct(), "windows")
    sizes = sorted(r[0] for r in each.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    own = _sized(each.withColumn("size", F.least(F.size("words"), F.lit(SHINGLE))).withColumn(
        "length", F.size("words")), "words", sizes, "window", "length", "size")
    own = own.where(F.size(F.array_compact(F.array(*_WORDS))) == F.col("size"))
    sought = write_scratch(own.select("h", *_WORDS).distinct().withColumn("sid", F.monotonically_increasing_id()), "shingles")
    placed = write_scratch(own.join(sought, [own[n].eqNullSafe(sought[n]) for n in ["h", *_WORDS]]).select(
        "window", "length", "size", F.col("pos").alias("offset"), "sid"), "window-shingles")
    n_windows, n_shingles, n_placed = each.count(), sought.count(), placed.count()

    def small(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= broadcast_shingles else df

    texts = documents.select("doc_id", F.xxhash64(whole_text("text")).alias("mark"), item_words("text").alias("words"))
    found = _sized(texts.withColumn("n_words", F.size("words")), "words", sizes, "doc_id", "mark", "n_words")
    # Equal hashes meet; the words are compared in a way that keeps them out of the join's keys.
    line = F.concat_ws(" ", *_WORDS)
    right = sought.select(F.col("h").alias("sought_h"), F.concat_ws(" ", *_WORDS).alias("shingle"), "sid")
    matched = found.join(small(right, n_shingles), found["h"] == right["sought_h"]).where(
        (line <= F.col("shingle")) & (line >= F.col("shingle")))
    matched = write_scratch(matched.select("doc_id", "mark", "n_words", "pos", "sid"), "shingle-matches")

    common = matched.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("window").orderBy("n", "offset")
    prefix = placed.join(small(common, n_shingles), "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn(
        "place", F.row_number().over(rarest)).where("place = 1").select("window", "length", "size", "offset", "sid")
    possible = matched.join(small(prefix, n_windows), "sid").select(
        "doc_id", "mark", (F.col("pos") - F.col("offset")).alias("start"), "window", "length", "size", "n_words",
    ).where("start >= 0 and start + length <= n_words").drop("n_words").distinct()

    last = F.col("length") - F.col("size")
    cover = F.array_distinct(F.transform(F.sequence(F.lit(0), last + F.col("size") - 1, F.col("size")),
                                         lambda o: F.least(o, last)))
    needed = possible.withColumn("n", F.size(cover)).withColumn("offset", F.explode(cover)).join(
        small(placed.select("window", "offset", "sid"), n_placed), ["window", "offset"]).withColumn(
        "pos", F.col("start") + F.col("offset"))
    there = matched.select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "mark", "pos", "sid")))
    proven = needed.join(there, needed["doc_id"].eqNullSafe(there["_doc_id"]) & (needed["mark"] == there["_mark"])
                         & (needed["pos"] == there["_pos"]) & (needed["sid"] == there["_sid"]), "left_semi")
    return proven.groupBy("doc_id", "mark", "start", "window", "length", "n").agg(
        F.count(F.lit(1)).alias("held")).where("held = n").select("doc_id", "mark", "start", "window", "length")


def find(documents: DataFrame, benchmark: DataFrame, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """One row per document: ``doc_id, mark, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words; windows of items without an id mark words, but such items are neither
    counted nor listed. Repeated items count once for an id. Rows that share ``doc_id`` and text get equal
    rows, those that share only ``doc_id`` are judged by their own text. Without items, nothing is hit. Other
    columns are ignored. Windows, shingles and their places are each broadcast up to ``broadcast_shingles`` rows.
    """
    passages = write_scratch(windows(benchmark), "passages")
    places = write_scratch(occurrences(documents, passages, broadcast_shingles), "occurrences")
    end = F.col("start") + F.col("length")
    before = Window.partitionBy("doc_id", "mark").orderBy("start", "length", "window").rowsBetween(
        Window.unboundedPreceding, -1)
    hits = places.withColumn("seen", F.coalesce(F.max(end).over(before), F.lit(0))).groupBy("doc_id", "mark").agg(
        F.sum(F.greatest(F.lit(0), end - F.greatest("start", "seen"))).alias("n_hit"))
    items = places.select("doc_id", "mark", "window").distinct().join(
        passages.where("item is not null").select("window", "item"), "window").groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    per = hits.join(items.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "items"),
                    F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left").select(
        F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "n_hit", "items")
    counted = documents.select(
        "doc_id", F.xxhash64(whole_text("text")).alias("mark"), F.size(item_words("text")).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(per, counted["doc_id"].eqNullSafe(per["_doc"]) & (counted["mark"] == per["_mark"]), "left").select(
        "doc_id", "mark", "n_words", n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
