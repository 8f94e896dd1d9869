"""Column profiles: counts, numeric summary, frequent values, examples and format anomalies.

All counters of all columns come out of one aggregation. Exact distinct counts and the ranks of frequent values
are found from counts of 128-bit hashes, so no text is shuffled for them; the texts of the few values that a rank is
given to are fetched by a second pass. The caller says for which columns; no table is too large or too small to be
treated alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tieout.functions.cells import strip
from tieout.functions.numeric import is_finite
from tieout.functions.text import DATE_LAYOUTS, date_text_layout, looks_numeric, numeric_text_shape, value_kind
from tieout.naming import col as _col, quoted
from tieout.session import drop_scratch, write_scratch
from tieout.types import dtype_name

# Fixed values of the profile.
TOP_K = 10
EXAMPLE_ROWS = 5
SAMPLE_SEED = 1729
KEY_DISTINCT_SHARE = 0.8
CATEGORY_MIN_ROWS = 20
CATEGORY_MAX_VALUES = 12
KINDS = ["boolean", "integer", "float", "datetime", "date", "time", "duration", "error", "string", "other"]
KEY_HEADER = (
    r"(?i)\b(id|ids|code|codes|key|keys|ref|reference|no|num|number|account|counterparty|"
    r"customer|client|isin|cusip|sedol|ticker|name|desk|entity|book)\b"
)

NUMERIC = T.StructType([
    T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()), T.StructField("mean", T.DoubleType()),
    T.StructField("sum", T.DoubleType()), T.StructField("zero_count", T.LongType()), T.StructField("negative_count", T.LongType())])
COUNTERS = T.StructType([
    T.StructField("column_index", T.IntegerType()), T.StructField("header", T.StringType()), T.StructField("dtype", T.StringType()),
    T.StructField("row_count", T.LongType()), T.StructField("null_count", T.LongType()), T.StructField("approx_distinct", T.LongType()),
    T.StructField("numeric", NUMERIC),
    *[T.StructField(name, T.LongType()) for name in (
        "text_numbers", "delivery_numbers", "edge_space", "nbsp", "empty_strings", "date_layouts", "error_values")],
    T.StructField("redacted", T.BooleanType())])


def is_redacted(header: str, patterns: list[str]) -> bool:
    """Whether a header matches a pattern; a pattern that is no regular expression is taken literally."""
    for pattern in patterns:
        try:
            expression = re.compile(pattern, re.IGNORECASE)
        except re.error:
            expression = re.compile(re.escape(pattern), re.IGNORECASE)
        if pattern and expression.search(header):
            return True
    return False


def is_key_like(header: Column, distinct: Column, filled: Column) -> Column:
    """A header that names an identifier, or mostly distinct values."""
    by_share = (filled > 0) & (distinct / filled >= KEY_DISTINCT_SHARE)
    return F.coalesce(header.rlike(KEY_HEADER), F.lit(False)) | F.coalesce(by_share, F.lit(False))


def fold_kinds(counts: dict[str, Column]) -> Column:
    """One dtype for a column from the number of values of each kind."""
    def some(*kinds: str) -> Column:
        found = F.lit(False)
        for kind in kinds:
            if kind in counts:
                found = found | (counts[kind] > 0)
        return found
    plain = [k for k in KINDS if k != "error"]
    numbers, moments = ["integer", "float"], ["date", "datetime", "time"]
    none_but = lambda group: ~some(*[k for k in plain if k not in group])
    result = F.when(~some(*plain) & ~some("error"), "empty").when(~some(*plain), "error")
    result = result.when(none_but(numbers), F.when(some("float"), "float").otherwise("integer"))
    result = result.when(none_but(["time"]), "time")
    result = result.when(none_but(moments), F.when(some("datetime"), "datetime").otherwise("date"))
    for kind in plain:
        result = result.when(none_but([kind]), kind)
    return result.otherwise("mixed")


def _layout_bit(text: Column) -> Column:
    """A different bit for each date layout, null for text in none."""
    name = date_text_layout(text)
    bits = [F.lit(part) for i, layout in enumerate(DATE_LAYOUTS) for part in (layout, 1 << i)]
    return F.try_element_at(F.create_map(*bits), name)


# How a counter of parts of the table becomes the counter of the whole.
COMBINE = {"min": "min", "max": "max", "layouts": "bit_or", "approx": "hll_union_agg"}
LANES = 64
SKETCH_BITS = 10


def _column_counters(index: int, field: T.StructField, redacted: bool) -> dict[str, str]:
    """SQL of each counter of one column. One text per counter keeps wide tables quick to plan."""
    value, tag = quoted(field.name), f"c{index}_"
    made = {"filled": f"count({value})",
            "approx": f"hll_sketch_agg(if({value} is null, null, xxhash64({value})), {SKETCH_BITS})"}
    if isinstance(field.dataType, T.NumericType) and not redacted:
        number = f"cast({value} as double)"
        made |= {"min": f"min({number})", "max": f"max({number})", "sum": f"sum({number})",
                 "zero": f"count_if({number} = 0)", "negative": f"count_if({number} < 0)"}
    if isinstance(field.dataType, T.StringType):
        filled = f"{tag}bare <> ''"
        made |= {"text": f"count_if({tag}number)", "looks": f"count_if({tag}looks)", "empty": f"count_if({tag}bare = '')",
                 "space": f"count_if({filled} and {value} <> {tag}bare)", "nbsp": f"count_if({filled} and contains({value}, '\u00a0'))",
                 "error": f"count_if({tag}error)", "layouts": f"bit_or({tag}layout)"}
    return {tag + name: expression for name, expression in made.items()}


def _text_features(df: DataFrame, texts: list[int]) -> DataFrame:
    """What is asked of every text, computed in steps so that no pattern is matched twice."""
    names = df.columns
    bare, number = (lambda i: F.col(f"c{i}_bare")), (lambda i: F.col(f"c{i}_number"))
    ready = df.withColumns({f"c{i}_bare": strip(_col(names[i])) for i in texts})
    ready = ready.withColumns({f"c{i}_number": (bare(i) != "") & numeric_text_shape(bare(i)) for i in texts})
    later = {}
    for i in texts:
        later |= {f"c{i}_looks": (bare(i) != "") & looks_numeric(bare(i)),
                  f"c{i}_error": bare(i).startswith("#") & (value_kind(bare(i), T.StringType()) == "error"),
                  f"c{i}_layout": _layout_bit(F.when(~number(i), bare(i)))}
    return ready.withColumns(later)


def column_counters(df: DataFrame, redact: list[str] = ()) -> DataFrame:
    """One row per column with every counter, from one pass over the table.

    Counters are combined in a few lanes before the last step, so no single task has to take in the
    sketches of every task of a large table.
    """
    fields = df.schema.fields
    hidden = [is_redacted(f.name, list(redact)) for f in fields]
    texts = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)]
    ready = _text_features(df, texts) if texts else df
    made = {"rows": "count(1)"}
    for i, field in enumerate(fields):
        made |= _column_counters(i, field, hidden[i])
    lanes = ready.withColumn("__lane", F.spark_partition_id() % LANES).groupBy("__lane").agg(
        *[F.expr(expression).alias(name) for name, expression in made.items()])
    wide = lanes.selectExpr(*[f"{COMBINE.get(name.split('_', 1)[-1], 'sum')}({name}) as {name}" for name in made])
    finite = lambda value: f"if(isnan({value}) or abs({value}) = double('infinity'), null, {value})"
    rows = []
    for i, field in enumerate(fields):
        got = lambda name: f"coalesce(c{i}_{name}, 0)" if f"c{i}_{name}" in made else "0"
        numeric = "null"
        if f"c{i}_min" in made:
            mean = f"(c{i}_sum / nullif(c{i}_filled, 0))"
            parts = [finite(f"c{i}_min"), finite(f"c{i}_max"), finite(mean), finite(f"c{i}_sum"), got("zero"), got("negative")]
            numeric = f"named_struct({', '.join(f"'{f.name}', {p}" for f, p in zip(NUMERIC.fields, parts))})"
        header = field.name.replace("\\", "\\\\").replace("'", "\\'")
        parts = [str(i), f"'{header}'", f"'{dtype_name(field.dataType)}'", "coalesce(rows, 0)", f"coalesce(rows, 0) - {got('filled')}",
                 f"coalesce(hll_sketch_estimate(c{i}_approx), 0)", numeric, got("text"), got("looks"), got("space"), got("nbsp"),
                 got("empty"), f"bit_count({got('layouts')})", got("error"), str(hidden[i]).lower()]
        cast = [f"'{f.name}', cast({p} as {f.dataType.simpleString()})" for f, p in zip(COUNTERS.fields, parts)]
        rows.append(f"named_struct({', '.join(cast)})")
    return wide.selectExpr(f"inline(array({', '.join(rows)}))")


def _shown(df: DataFrame, name: str) -> Column:
    """A cell as the text a profile shows."""
    dtype, value = df.schema[name].dataType, _col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = F.when(value == 0, F.lit(0.0)).otherwise(value)
    return F.concat(F.lit("<"), F.length(value), F.lit(" bytes>")) if isinstance(dtype, T.BinaryType) else value.cast("string")


# Two hashes name a value: with 64 bits alone, a column of ten billion values would lose some of them.
HASHES = ["h1", "h2"]
# Values that share the last place; of more only the smallest are fetched.
FEW_TIES = 1000


def _hashed(value: Column, *names: str) -> list[Column]:
    return [F.xxhash64(value, F.lit(seed)).alias(name) for seed, name in enumerate(names)]


def hash_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_index, h1, h2, f1, f2, n``: rows for each value of each column, by hashes of the value and of the value
    without outer space and case. Empty cells are left out."""
    index = {name: i for i, name in enumerate(df.columns)}
    pairs = []
    for name in columns:
        shown = _shown(df, name)
        folded = F.lower(strip(shown)) if isinstance(df.schema[name].dataType, T.StringType) else shown
        pairs.append(F.when(shown.isNotNull(), F.struct(
            F.lit(index[name]).alias("column_index"), *_hashed(shown, *HASHES), *_hashed(folded, "f1", "f2"))))
    long = df.select(F.explode(F.array_compact(F.array(*pairs))).alias("c")).select("c.*")
    return long.groupBy("column_index", *HASHES, "f1", "f2").agg(F.count(F.lit(1)).alias("n"))


def distinct_from_hashes(counts: DataFrame) -> DataFrame:
    """As ``distinct_values``, from counts of hashes."""
    folded = counts.groupBy("column_index", "f1", "f2").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("n"))
    return folded.groupBy("column_index").agg(
        F.sum("variants").alias("distinct_count"), F.sum("n").alias("filled"), (F.sum("variants") - F.count(F.lit(1))).alias("case_variants"))


def _named(df: DataFrame, columns: list[str]) -> DataFrame:
    index = {name: i for i, name in enumerate(df.columns)}
    pairs = [F.struct(F.lit(index[n]).alias("column_index"), _shown(df, n).alias("value")) for n in columns]
    return df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def top_from_hashes(df: DataFrame, columns: list[str], counts: DataFrame, k: int = TOP_K) -> DataFrame:
    """``column_index, value, n, place``: the k most frequent values of every column, equal counts by value.

    The hashes tell which values have a place. Those are few, and only their texts are looked up, combined within
    each task before they are shuffled. Where very many values share the last place, the smallest texts of the column are
    taken, as many as are likely to hold enough of them, and more if they do not.
    """
    best = Window.partitionBy("column_index").orderBy(F.desc("n"))
    edges = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).groupBy("column_index").agg(
        F.min("n").alias("edge"))
    ranked = counts.join(F.broadcast(edges), "column_index").where("n >= edge")  # a row a column
    facts = {r["column_index"]: r for r in ranked.groupBy("column_index").agg(
        F.first("edge").alias("edge"), F.count_if(F.col("n") > F.col("edge")).alias("sure"),
        F.count_if(F.col("n") == F.col("edge")).alias("tied")).collect()}
    crowded = [i for i, r in facts.items() if r["tied"] > FEW_TIES]
    wanted = ranked.where((F.col("n") > F.col("edge")) | ~F.col("column_index").isin(crowded)).select("column_index", *HASHES)
    wanted = write_scratch(wanted, "wanted-values")  # at most k + FEW_TIES a column
    named = _named(df, columns)
    texts = named.select("*", *_hashed(F.col("value"), *HASHES)).join(F.broadcast(wanted), ["column_index", *HASHES]).groupBy(
        "column_index", "value").agg(F.count(F.lit(1)).alias("n"))
    if crowded:
        texts = texts.unionByName(_smallest_tied(df, [df.columns[i] for i in sorted(crowded)], ranked, facts, k))
    return top_values(texts, k)


def _smallest_tied(df: DataFrame, columns: list[str], ranked: DataFrame, facts: dict, k: int) -> DataFrame:
    """``column_index, value, n`` of the smallest values with the last count that has a place, enough to fill the places."""
    index = {df.columns.index(name): name for name in columns}
    tied = ranked.where((F.col("n") == F.col("edge")) & F.col("column_index").isin(list(index))).select("column_index", *HASHES, "n")
    rows = df.agg(*(F.count(_col(name)).alias(f"c{i}") for i, name in index.items())).first()
    need = {i: k - facts[i]["sure"] for i in index}
    most = max(4 * need[i] * rows[f"c{i}"] // max(1, facts[i]["tied"] * facts[i]["edge"]) + 100 for i in index)
    while True:
        small = Window.partitionBy("column_index").orderBy("value")
        first = _named(df, columns).withColumn("place", F.row_number().over(small)).where(F.col("place") <= most).select(
            "column_index", "value").distinct()
        found = write_scratch(first.select("*", *_hashed(F.col("value"), *HASHES)).join(tied, ["column_index", *HASHES]).select(
            "column_index", "value", "n"), "tied-values")
        held = {r["column_index"]: r["count"] for r in found.groupBy("column_index").count().collect()}
        if all(held.get(i, 0) >= need[i] or most >= rows[f"c{i}"] for i in index):
            return found
        drop_scratch(found)
        most *= 8


def value_frequencies(df: DataFrame, columns: list[str], hidden: list[str] = ()) -> DataFrame:
    """Rows per (column, value text), empty cells left out. ``hidden`` columns count by digest."""
    index = {name: i for i, name in enumerate(df.columns)}
    pairs = []
    for name in columns:
        shown = F.sha2(_shown(df, name), 256) if name in hidden else _shown(df, name)
        pairs.append(F.struct(F.lit(index[name]).alias("column_index"), shown.alias("value")))
    long = df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
    return long.groupBy("column_index", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(frequencies: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k most frequent values of every column; equal counts go by value."""
    place = Window.partitionBy("column_index").orderBy(F.desc("n"), "value")
    return frequencies.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def distinct_values(frequencies: DataFrame) -> DataFrame:
    """Distinct values per column, and how many differ only by case or outer space."""
    folded = F.lower(strip(F.col("value")))
    # Summing the counts keeps this and the frequent values on one shuffle of the same pairs.
    return (frequencies.groupBy("column_index", folded.alias("folded")).agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("n"))
            .groupBy("column_index")
            .agg(F.sum("variants").alias("distinct_count"), F.sum("n").alias("filled"),
                 (F.sum("variants") - F.count(F.lit(1))).alias("case_variants")))


def _examples(df: DataFrame, order: list[str], hidden: list[str]) -> dict[str, list]:
    """First, last and hash-chosen rows: fifteen rows at most, each found by a top-n."""
    shown = df.select(*[_col(c) for c in df.columns if c not in hidden],
                      *[_col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    by = [f"__o{i}" for i in range(len(order))]
    head = shown.orderBy(*by).limit(EXAMPLE_ROWS).collect()
    tail = shown.orderBy(*[F.desc(c) for c in by]).limit(EXAMPLE_ROWS).collect()[::-1]
    pick = F.xxhash64(F.lit(SAMPLE_SEED), *[F.col(c) for c in by])
    sample = shown.orderBy(pick, *by).limit(EXAMPLE_ROWS).collect()
    return {"head": head, "tail": tail, "sample": sample}


def anomalies(counters: DataFrame) -> Column:
    """Format anomalies as text, from the counters of a profile row."""
    filled = F.col("row_count") - F.col("null_count")
    def cells(label: str, count: str) -> Column:
        return F.when(F.col(count) > 0, F.concat(F.lit(f"{label} ("), F.format_number(F.col(count), 0), F.lit(" cells)")))
    share = F.when(filled > 0, F.concat(F.lit(", "), F.floor(F.col("text_numbers") * 100 / filled).cast("string"), F.lit("% of the column"))).otherwise("")
    text = F.when(F.col("text_numbers") > 0, F.concat(
        F.lit("numbers stored as text ("), F.format_number("text_numbers", 0), F.lit(" cells"), share, F.lit(")")))
    layouts = F.when(F.col("date_layouts") > 1, F.concat(
        F.lit("mixed date formats ("), F.col("date_layouts").cast("string"), F.lit(" text layouts)")))
    casing = F.when(is_key_like(F.col("header"), F.col("distinct_count"), filled) & (F.col("case_variants") > 0), F.concat(
        F.lit("inconsistent casing ("), F.format_number("case_variants", 0), F.lit(" values)")))
    found = F.array(text, layouts, cells("leading or trailing whitespace", "edge_space"),
                    cells("non-breaking spaces", "nbsp"), cells("empty strings", "empty_strings"),
                    casing, cells("Excel error values", "error_values"))
    return F.array_compact(found)


def profile(df: DataFrame, exact: bool | list[str] = True, order: list[str] | None = None,
            redact: list[str] = (), k: int = TOP_K) -> DataFrame:
    """One row per column.

    ``exact`` columns (True: all, False: none, or their names) have their distinct values counted and the
    ``k`` most frequent ranked. ``distinct_count`` of the others is a sketch's, ``distinct_exact`` says so, and
    ``top_k`` is null.
    ``order`` adds head, tail and sample values; ``redact`` lists header patterns to withhold.
    """
    counters = column_counters(df, redact)
    chosen = [c for c in df.columns if exact is True or (exact is not False and c in exact)]
    index = "column_index"
    if chosen:
        counts = write_scratch(hash_counts(df, chosen), "value-counts")
        distinct = distinct_from_hashes(counts)
        item = F.struct(F.col("value"), F.col("n"))
        open_ = [c for c in chosen if not is_redacted(c, list(redact))]
        ranks = top_from_hashes(df, open_, counts.where(F.col(index).isin([df.columns.index(c) for c in open_])), k)
        top = ranks.groupBy(index).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"]).alias("top_k"))
        rows = counters.join(distinct, index, "left").join(top, index, "left")
    else:
        rows = counters.withColumns({"distinct_count": F.lit(None).cast("bigint"),
                                     "case_variants": F.lit(None).cast("bigint"),
                                     "top_k": F.lit(None).cast("array<struct<value:string,n:bigint>>")})
    known = set(chosen)
    covered = F.col("header").isin(sorted(known)) if known else F.lit(False)
    rows = rows.withColumns({
        "distinct_exact": covered,
        "distinct_count": F.when(covered, F.coalesce("distinct_count", F.lit(0))).otherwise(F.col("approx_distinct")),
        "top_k": F.when(F.col("redacted"), F.lit(None)).otherwise(F.col("top_k")),
    })
    filled = F.col("row_count") - F.col("null_count")
    rows = rows.withColumns({
        "format_anomalies": anomalies(rows),
        "mostly_text_numbers": (F.col("dtype") == "String") & (filled > 0) & (F.col("delivery_numbers") >= filled * 0.8),
        "key_like": is_key_like(F.col("header"), F.col("distinct_count"), filled),
        "category": (F.col("dtype") == "String") & (F.col("row_count") >= CATEGORY_MIN_ROWS)
        & F.col("distinct_count").between(1, CATEGORY_MAX_VALUES),
    })
    rows = rows.drop("approx_distinct", "case_variants", "filled")
    if order:
        hidden = [c for c in df.columns if is_redacted(c, list(redact))]
        examples = _examples(df, order, hidden)
        lines = [(i, *[[None if row[c] is None else str(row[c]) for row in examples[part]] for part in ("head", "tail", "sample")])
                 for i, c in enumerate(df.columns) if c not in hidden]
        schema = "column_index int, head array<string>, tail array<string>, sample array<string>"
        rows = rows.join(df.sparkSession.createDataFrame(lines, schema), index, "left")
    return rows


def cell_profile(cells: DataFrame, group: list[str], kind: str = "kind", value: str = "value") -> DataFrame:
    """One row for each column of a cell table, whose cells have a kind of ``value_kind`` and a text.

    ``dtype`` folds the kinds and ``kinds`` counts them; ``numeric`` sums up the numbers where they are at least half of
    the filled cells, leaving out what is not finite; ``format_anomalies`` adds to those of texts what only cells can
    show: kinds that do not go together, with how many there are of each, and dates as text beside real ones.
    One aggregation, combined before the shuffle; cells that are null have no kind and count as empty.
    """
    what, text = F.coalesce(_col(kind), F.lit("empty")), _col(value)
    words = F.when(what == "string", text)
    bare = strip(words)
    shaped = F.coalesce((bare != "") & numeric_text_shape(bare), F.lit(False))
    number = F.when(what.isin("integer", "float"), text.try_cast("double"))
    finite = F.when(is_finite(number), number)
    counted = cells.groupBy(*group).agg(
        *(F.count_if(what == k).alias(f"k_{k}") for k in KINDS), F.count(F.lit(1)).alias("row_count"), F.count_if(what == "empty").alias("null_count"),
        F.count_if(shaped).alias("text_numbers"), F.bit_or(_layout_bit(F.when(~shaped, bare))).alias("layouts"),
        F.count_if((bare != "") & (words != bare)).alias("edge_space"), F.count_if((bare != "") & words.contains("\u00a0")).alias("nbsp"),
        F.count_if(bare == "").alias("empty_strings"), F.count(number).alias("numbers"),
        F.min(finite).alias("min"), F.max(finite).alias("max"), F.sum(finite).alias("sum"),
        F.count_if(finite == 0).alias("zero_count"), F.count_if(finite < 0).alias("negative_count"))
    rows = counted.withColumns({
        "dtype": fold_kinds({k: F.col(f"k_{k}") for k in KINDS}), "date_layouts": F.bit_count(F.coalesce("layouts", F.lit(0))),
        "error_values": F.col("k_error"), "header": F.lit(""), "distinct_count": F.lit(0), "case_variants": F.lit(0)})
    by_kind = F.array(*(F.struct((-F.col(f"k_{k}")).alias("n"), F.lit(k).alias("kind")) for k in KINDS))
    held = F.array_sort(F.filter(by_kind, lambda x: x["n"] < 0))
    composed = F.when(F.col("dtype") == "mixed", F.concat(F.lit("mixed types: "), F.array_join(
        F.transform(held, lambda x: F.concat(F.format_number(-x["n"], 0), F.lit(" "), x["kind"])), ", ")))
    dates = F.col("k_date") + F.col("k_datetime")
    beside = F.when((F.col("date_layouts") == 1) & (dates > 0), F.concat(
        F.lit("text dates alongside real dates (beside "), F.format_number(dates, 0), F.lit(" real ones)")))
    enough = (F.col("numbers") > 0) & (2 * F.col("numbers") >= F.col("row_count") - F.col("null_count"))
    numeric = F.when(enough, F.struct("min", "max", (F.col("sum") / F.col("numbers")).alias("mean"), "sum", "zero_count", "negative_count"))
    return rows.select(
        *group, "row_count", "null_count", "dtype", F.map_from_entries(F.transform(held, lambda x: F.struct(x["kind"], -x["n"]))).alias("kinds"),
        numeric.alias("numeric"), F.array_compact(F.concat(F.array(composed), anomalies(rows), F.array(beside))).alias("format_anomalies"))


def mixed_type_columns(cells: DataFrame, group: list[str], kind: str = "kind") -> DataFrame:
    """Columns of a cell table holding at least two dates beside two texts or numbers."""
    dates = F.count_if(F.col(kind).isin("date", "datetime"))
    others = F.count_if(F.col(kind).isin("string", "text", "integer", "float", "number"))
    return cells.groupBy(*group).agg(dates.alias("dates"), others.alias("others")).where(
        (F.col("dates") >= 2) & (F.col("others") >= 2))


def coverage(df: DataFrame, group: list[str], present: Column) -> DataFrame:
    """Share of rows with a value per group, and what that share amounts to."""
    counted = df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), F.count_if(present).alias("present"))
    share = F.col("present") / F.col("total")
    status = F.when(F.col("present") == 0, "absent").when(share >= 0.995, "present").otherwise("partial")
    return counted.withColumns({"coverage": share, "status": status})


def coverage_status(total: int, present: int) -> str:
    """The same verdict for counts already at hand; no rows at all is not applicable."""
    if total == 0:
        return "not_applicable"
    if present == 0:
        return "absent"
    return "present" if present / total >= 0.995 else "partial"
