"""Quality rules and distance from a language's usual text, with DataFrame expressions only.

A document is compared with its language: how its characters fall into classes, and how often it uses the
language's most common words. Both references are counted over all documents, the classes once for them and for the
documents' own rows. That of the classes is a median over
cells of sources and texts: one source, or the copies of one text, fill fewer than half of the cells however many
rows they have, so they cannot make themselves usual. The distance is that of Jensen and Shannon (0: the same, 1:
nothing in common); short documents are not judged by it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm.common import whole_text, write_scratch

SYMBOLS = "[#*$%&|<>]"
#: Classes beside letters of the text's own kind and white space.
CLASSES = ["[A-Z]", "[0-9]", SYMBOLS, r"[.,;:!?'\x22()-]", r"[^\x00-\x7F]"]
#: Most of a text, and in none of the classes.
_UNCLASSED = r"[a-z \n]+"
WINDOW = 8
#: Cells of the reference of classes: sources fall into so many groups, different texts into so many.
SOURCE_GROUPS, TEXT_GROUPS = 5, 3


@dataclass(frozen=True)
class Rules:
    """A document fails with fewer than ``least_words`` words or more than ``most_repeated`` per cent of
    them in repeated windows; its verdict is a distance above ``most_classes`` with ``least_class_words``
    words or more, or above ``most_common`` with ``least_common_words``. ``common`` words per language."""

    least_words: int = 20
    most_repeated: int = 30
    common: int = 16
    least_class_words: int = 30
    most_classes: float = 0.3
    least_common_words: int = 100
    most_common: float = 0.5


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _words(text: Column) -> Column:
    """The words of a text; cut at one character, which Spark does without a pattern."""
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _with_classes(rows: DataFrame) -> DataFrame:
    """Add ``classes``, the characters of ``text`` in each class; what is in none of them is taken out first, once."""
    def count(kind: str) -> Column:
        inverse = "[" + kind[2:] if kind.startswith("[^") else "[^" + kind[1:]
        return F.length(F.regexp_replace("classed", inverse + "+", "")).cast("long")

    rows = rows.withColumn("classed", F.regexp_replace("text", _UNCLASSED, ""))
    return rows.withColumn("classes", F.array(*map(count, CLASSES))).drop("classed")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that are found twice or more in the text, the first place included.

    Windows are hashed from windows half as long, so that no words are copied for each.
    """
    count = F.size(words)

    def longer(found: Column, size: int) -> Column:
        if size == window:
            return F.slice(found, F.lit(1), F.greatest(count - (window - 1), F.lit(0)))
        step = min(size, window - size)
        return let(F.transform(found, lambda h, i: F.xxhash64(h, F.get(found, i + step))), lambda x: longer(x, size + step))

    first = min(2, window)
    short = F.transform(words, lambda word, i: F.xxhash64(word, *(F.get(words, i + k) for k in range(1, first))))
    hashes = F.when(count > window, let(short, lambda found: longer(found, first)))

    def places(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.sort_array(F.transform(F.filter(
            F.transform(s, lambda x, k: F.when(
                F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)), x["i"])),
            lambda i: i.isNotNull()), lambda i: i)))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(
            F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window)))), F.lit(0), lambda n, x: n + x)

    return F.coalesce(let(hashes, lambda found: F.when(
        F.size(F.array_distinct(found)) < F.size(found), let(places(found), covered)).otherwise(0)), F.lit(0))


def _group(value: Column, groups: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 6), 16, 10).cast("long") % groups


def measures(documents: DataFrame) -> DataFrame:
    """``doc_id, lang, line`` (the words as ``common_counts`` wants them), ``cell`` (the group of its source and that of
    its text) and the counts of each whole text. Null texts have no words, null languages are a language of their own, and
    so are null sources and all rows of a table without ``source``."""
    source = F.coalesce("source", F.lit("")) if "source" in documents.columns else F.lit("")
    text = whole_text("text")
    cell = F.struct(_group(source, SOURCE_GROUPS).alias("s"), _group(text, TEXT_GROUPS).alias("t"))
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"), cell.alias("cell"))
    rows = _with_classes(rows).withColumn("words", _words(F.col("text")))

    def repeats(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    def with_words(lines: Column) -> Column:
        return F.filter(lines, lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))

    return rows.select(
        "doc_id", "lang", "cell", F.size("words").cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"),
        let(F.split("text", "\n"), lambda lines: F.when(repeats(lines) > 0, let(with_words(lines), repeats)).otherwise(0)).cast(
            "long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"), "classes",
        F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")).alias("line"),
    ).withColumn("word_chars", F.when(F.col("n_words") > 0, F.length("line") - 2 * F.col("n_words")).otherwise(0).cast("long"))


def class_counts(rows: DataFrame) -> Column:
    """Characters per class: those of ``CLASSES``, white space, the rest."""
    named = F.aggregate("classes", F.lit(0).cast("long"), lambda n, x: n + x)
    return F.concat("classes", F.array(rows["n_chars"] - rows["word_chars"], rows["word_chars"] - named))


def common_words(documents: DataFrame, common: int = Rules.common) -> DataFrame:
    """One row per ``lang`` with words: ``common``, its most frequent ones (ties by the word), and ``counts``, over all
    documents. Repeated rows need no more; texts are read whole; an empty table gives none."""
    rows = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(_words(whole_text("text"))).alias("word"))
    ranked = rows.groupBy("lang", "word").count().withColumn(
        "place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(
        F.col("place") <= common)
    top = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "count"))).alias("top"))
    return top.select("lang", F.col("top.word").alias("common"), F.col("top.count").alias("counts"))


def references(measured: DataFrame, words: DataFrame) -> DataFrame:
    """One row per ``lang``: ``usual_classes`` (shares of characters per class) and ``usual_words`` (the counts of its common
    ``words`` and that of all others), from ``lang, cell, every, n_chars, n_words`` of all documents.

    Equal texts fall into one cell of each group of sources; a class's share is the median of its shares in the cells
    with characters, null where there are none.
    """
    kinds = range(len(CLASSES) + 2)
    cells = measured.groupBy("lang", "cell").agg(
        *(F.sum(F.get("every", F.lit(k))).alias(f"c{k}") for k in kinds), F.sum("n_words").alias("n_words"),
        F.sum("n_chars").alias("n_chars"))
    classes = cells.groupBy("lang").agg(
        F.array(*(F.median(F.when(F.col("n_chars") > 0, F.col(f"c{k}") / F.col("n_chars"))) for k in kinds)).alias("usual_classes"),
        F.sum("n_words").alias("n_words"))
    counts = F.coalesce("counts", F.array().cast("array<bigint>"))
    others = F.col("n_words") - F.aggregate(counts, F.lit(0).cast("long"), lambda n, x: n + x)
    return classes.join(words, "lang", "left").select(
        "lang", "usual_classes", F.concat(counts, F.array(others)).alias("usual_words"))


def common_counts(line: Column, n_words: Column, common: Column) -> Column:
    """How often each common word stands in a text, and all other words. ``line`` has a blank on either side of every
    word."""
    def count(line: Column, word: Column) -> Column:
        sought = F.concat(F.lit(" "), word, F.lit(" "))
        gone = F.octet_length(line) - F.octet_length(F.replace(line, sought, F.lit("")))
        return (gone / F.octet_length(sought)).cast("long")

    found = F.transform(common, lambda word: count(line, word))
    return let(found, lambda n: F.concat(n, F.array(
        n_words - F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x))))


def jensen_shannon(left: Column, right: Column) -> Column:
    """Distance of two histograms of equal length, 0 to 1; null if one of them is empty."""
    def shares(counts: Column) -> Column:
        return let(F.aggregate(counts, F.lit(0.0), lambda n, x: n + x),
                   lambda total: F.when(total > 0, F.transform(counts, lambda x: x / total)))

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    terms = F.zip_with(shares(left), shares(right), lambda p, q: term(p, q) + term(q, p))
    return let(F.aggregate(terms, F.lit(0.0), lambda n, x: n + x) / 2,
               lambda found: F.when(found <= 0, 0.0).otherwise(F.sqrt(found)))


def judge(documents: DataFrame, rules: Rules = Rules(), most_languages: int = 1000) -> DataFrame:
    """One row per document with its counts, ``class_distance``, ``common_distance``, ``base_failed`` and
    ``kept``. Rows stand alone, so ties and repeated rows need no rule; texts of any length are judged whole, null and
    empty ones have no words and fail; an empty table gives an empty one; columns beside ``doc_id, source, lang, text``
    are ignored. Texts are read twice: for the common words, and for all counts, from whose written table the references
    come. Both are broadcast if there are at most ``most_languages``, else joined by a shuffle."""
    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= most_languages else df

    words = write_scratch(common_words(documents, rules.common), "common-words")
    rows = measures(documents).join(small(words.select("lang", "common")), "lang", "left")
    none = F.array().cast("array<string>")
    measured = write_scratch(rows.select(
        "doc_id", "lang", "cell", "n_words", "n_chars", "word_chars", F.get("classes", F.lit(CLASSES.index(SYMBOLS))).alias("n_symbols"),
        "n_dup_lines", "n_repeat_words", class_counts(rows).alias("every"),
        common_counts(F.col("line"), F.col("n_words"), F.coalesce("common", none)).alias("found")), "measured")
    usual = small(write_scratch(references(measured, words), "languages"))
    judged = measured.join(usual, "lang", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        jensen_shannon(F.col("every"), F.col("usual_classes")).alias("class_distance"),
        jensen_shannon(F.col("found"), F.col("usual_words")).alias("common_distance"))
    failed = (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    odd = ((F.col("n_words") >= rules.least_class_words) & (F.col("class_distance") > rules.most_classes)) | (
        (F.col("n_words") >= rules.least_common_words) & (F.col("common_distance") > rules.most_common))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(odd, F.lit(False)))
