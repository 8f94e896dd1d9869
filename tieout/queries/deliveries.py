"""Reading, profiling, drift and contracts on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieout.operators import contract as C
from tieout.operators.drift import compare_shape, shape_of
from tieout.operators.profile import cell_profile, column_counters, profile, top_values, value_frequencies
from tieout.plans.delivery import check_drift
from tieout.queries.registry import query, table
from tieout.session import ensure_checkpoint_dir
from tieout.sources import delivery, receipts
from tieout.sources.files import content_hashes, detect_delimiters, detect_layouts, list_files
from tieout.streaming.watch import watch


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "customer")
    table(spark, folder, "customer").write.option("header", "true").csv(path)
    return delivery.read_data(spark, path)[0]


@query("select 0 as header_row, 0 as preamble_rows")
def csv_layouts(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "orders")
    table(spark, folder, "orders").write.option("header", "true").csv(path)
    return detect_layouts(list_files(spark, path, "*.csv")).select("header_row", "preamble_rows").distinct()


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def parquet_delivery(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.read_data(spark, f"{folder}/orders.parquet")[0]


def _grid(spark: SparkSession, folder: str) -> str:
    """The orders as a pasted grid: header, rows, a blank line, a row count. Files keep that order."""
    path = scratch(spark, "grid")
    orders = table(spark, folder, "orders")
    line = F.concat_ws(";", "o_orderkey", F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(';"')), "o_totalprice")
    edges = orders.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit("key;priority;price").alias("line")), F.struct(F.lit(2).alias("part"), F.lit("").alias("line")),
        F.struct(F.lit(3).alias("part"), F.concat(F.lit("("), F.col("n"), F.lit(" rows affected)")).alias("line")))).alias("e")).select("e.*")
    lines = orders.select(F.lit(1).alias("part"), line.alias("line"), F.col("o_orderkey").alias("key")).unionByName(edges.withColumn("key", F.lit(0)))
    lines.repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("line").write.text(path)
    return path


@query("select ';' as delimiter")
def grid_delimiter(spark: SparkSession, folder: str) -> DataFrame:
    files = detect_delimiters(list_files(spark, _grid(spark, folder), "*.txt"))
    return files.where(F.col("delimiter").isNotNull()).select("delimiter").distinct()


@query("select cast(o_orderkey as varchar) as \"key\", o_orderpriority || ';' as priority, o_totalprice as price from orders")
def pasted_grid(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch(spark, "plain")
    delivery.normalise_delimited(spark, _grid(spark, folder), out)
    plain = spark.read.options(header="true", escape='"').schema("key string, priority string, price double").csv(out)
    return plain


@query("""
select o_orderkey, o_totalprice as price, '0' || cast(o_orderkey as varchar) as code,
  case when o_orderkey % 500 = 0 then 'n/a' else cast(o_totalprice as varchar) end as noted,
  cast(o_orderkey + 1000000000000000 as varchar) as account from orders""")
def text_numbers_typed(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    texts = table(spark, folder, "orders").select(
        "o_orderkey", F.format_number("o_totalprice", 2).alias("price"), F.concat(F.lit("0"), key.cast("string")).alias("code"),
        F.when(key % 500 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("noted"),
        (key + 1000000000000000).cast("string").alias("account"))
    return delivery.coerce_numeric_text(texts)[0]


@query("select o_custkey as place, 'customer ' || o_custkey as who, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as spent from orders group by 1")
def totals_row_dropped(spark: SparkSession, folder: str) -> DataFrame:
    spent = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent")
    orders = table(spark, folder, "orders")
    rows = orders.groupBy(F.col("o_custkey").alias("place")).agg(F.count(F.lit(1)).alias("n"), spent).select(
        "place", F.concat(F.lit("customer "), F.col("place").cast("string")).alias("who"), "n", "spent")
    last = orders.agg((F.max("o_custkey") + 1).alias("place"), F.lit(None).cast("string").alias("who"), F.count(F.lit(1)).alias("n"), spent)
    given = rows.unionByName(last)
    return delivery.drop_last_row(given, "place") if delivery.detect_totals_row(given, "place") else given


@query()
def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    found = content_hashes(list_files(spark, folder, "*.parquet"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


@query()
def received_files(spark: SparkSession, folder: str) -> DataFrame:
    """Receive the given files twice: the second time adds nothing."""
    store = scratch(spark, "store")
    receipts.receive_paths(spark, f"{folder}/*.parquet", store)
    receipts.receive_paths(spark, f"{folder}/*.parquet", store)
    return receipts.newest_receipts(receipts.receipts(spark, store)).select("original_name", "sha256", "size_bytes", "source")


@query()
def watched_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Take what lies in the folder through the file stream."""
    store = scratch(spark, "watched")
    watch(spark, folder, store, f"{store}/progress", "*.parquet", once=True).awaitTermination()
    return receipts.receipts(spark, store).select("original_name", "sha256", "size_bytes", "source")


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    parts = []
    for place, (column, dtype) in enumerate(columns.items()):
        number = dtype.startswith(("Int", "Float"))
        numeric = (f"cast(min({column}) as double) as low, cast(max({column}) as double) as high, round(avg({column}), 4) as mean, "
                   f"count(*) filter (where {column} = 0) as zeros, count(*) filter (where {column} < 0) as negatives" if number else
                   "cast(null as double) as low, cast(null as double) as high, cast(null as double) as mean, cast(null as bigint) as zeros, cast(null as bigint) as negatives")
        parts.append(f"select {place} as column_index, '{column}' as header, '{dtype}' as dtype, count(*) as row_count, "
                     f"count(*) - count({column}) as null_count, count(distinct {column}) as distinct_count, {numeric} from {name}")
    return " union all ".join(parts)


def _summary(rows: DataFrame) -> DataFrame:
    return rows.select("column_index", "header", "dtype", "row_count", "null_count", "distinct_count", F.col("numeric.min").alias("low"),
                       F.col("numeric.max").alias("high"), F.round("numeric.mean", 4).alias("mean"),
                       F.col("numeric.zero_count").alias("zeros"), F.col("numeric.negative_count").alias("negatives"))


ORDERS = {"o_orderkey": "Int64", "o_custkey": "Int64", "o_orderstatus": "String", "o_totalprice": "Float64",
          "o_orderdate": "Datetime", "o_orderpriority": "String"}
LINES = {"l_orderkey": "Int64", "l_partkey": "Int64", "l_suppkey": "Int64", "l_linenumber": "Int32", "l_quantity": "Float64",
         "l_extendedprice": "Float64", "l_discount": "Float64", "l_tax": "Float64", "l_returnflag": "String", "l_linestatus": "String",
         "l_shipdate": "Datetime"}


@query(_profile_sql("orders", ORDERS))
def profile_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(profile(table(spark, folder, "orders").select(*ORDERS), exact=True))


@query(_profile_sql("lineitem", LINES))
def profile_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(profile(table(spark, folder, "lineitem").select(*LINES), exact=True))


@query()
def profile_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The one-pass profile with sketched distinct counts, examples and anomalies; the text withheld."""
    rows = profile(table(spark, folder, "documents"), order=["doc_id"], redact=["^text$"])
    return rows.select("header", "dtype", "row_count", "null_count", "redacted", "format_anomalies", "head", "tail")


_TOP = " union all ".join(
    f"select {i} as column_index, cast({c} as varchar) as value, count(*) as n from lineitem group by 2"
    for i, c in [(4, "l_quantity"), (8, "l_returnflag"), (9, "l_linestatus")])


@query(f"""select column_index, value, n, cast(row_number() over (partition by column_index order by n desc, value) as integer) as place from ({_TOP})
  qualify row_number() over (partition by column_index order by n desc, value) <= 10""")
def frequent_values(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(*LINES)
    return top_values(value_frequencies(lines, ["l_quantity", "l_returnflag", "l_linestatus"]))


@query("""
with o as (select case o_orderkey % 9 when 0 then '' when 1 then ' ' || o_orderpriority when 2 then 'a' || chr(160) || 'b' when 3 then '#N/A'
  when 4 then cast(o_totalprice as varchar) when 5 then strftime(o_orderdate, '%Y-%m-%d') when 6 then strftime(o_orderdate, '%d/%m/%Y') else 'x' end as cell, o_orderkey % 9 as k from orders)
select 'cell' as header, count(*) filter (where k = 0) as empty_strings, count(*) filter (where k = 1) as edge_space, count(*) filter (where k = 2) as nbsp,
  count(*) filter (where k = 3) as error_values, count(*) filter (where k = 4) as text_numbers, cast(2 as bigint) as date_layouts, count(*) filter (where k = 4) as delivery_numbers from o""")
def text_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 9, F.col("o_orderdate")
    cell = (F.when(k == 0, "").when(k == 1, F.concat(F.lit(" "), F.col("o_orderpriority"))).when(k == 2, "a\u00a0b").when(k == 3, "#N/A")
            .when(k == 4, F.col("o_totalprice").cast("string")).when(k == 5, F.date_format(day, "yyyy-MM-dd"))
            .when(k == 6, F.date_format(day, "dd/MM/yyyy")).otherwise("x"))
    counters = column_counters(table(spark, folder, "orders").select(cell.alias("cell")))
    return counters.select("header", "empty_strings", "edge_space", "nbsp", "error_values", "text_numbers", "date_layouts", "delivery_numbers")


_KIND = """case when o_orderkey % 11 = 0 then 'empty' when o_custkey % 4 = 0 then 'float' when o_custkey % 4 = 1 and o_orderkey % 2 = 0 then 'date'
  when o_custkey % 4 = 1 then 'string' when o_custkey % 4 = 2 and o_orderkey % 5 < 3 then 'integer' else 'string' end"""
_CELL = """case when o_custkey % 4 = 0 then cast(o_totalprice as varchar) when o_custkey % 4 = 1 then {day} when o_orderkey % 5 < 3 then
  cast(o_orderkey - 100 as varchar) when o_orderkey % 5 = 3 then ' ' || o_orderpriority else '' end"""


@query(f"""
with c as (select o_custkey % 4 as part, {_KIND} as kind, {_CELL.format(day="strftime(o_orderdate, '%Y-%m-%d')")} as v from orders),
n as (select part, count(*) as row_count, count(*) filter (where kind = 'empty') as null_count, count(*) filter (where kind = 'string') as strings,
  count(*) filter (where kind = 'integer') as wholes, count(*) filter (where kind = 'float') as floats, count(*) filter (where kind = 'date') as dates,
  count(*) filter (where kind = 'string' and v like ' %') as spaced, count(*) filter (where kind = 'string' and v = '') as blank,
  min(case when kind in ('integer', 'float') then try_cast(v as double) end) as least, count(*) filter (where kind = 'integer' and try_cast(v as double) < 0) as below from c group by part)
select part, row_count, null_count, case part when 0 then 'float' else 'mixed' end as dtype,
  case when 2 * (wholes + floats) >= row_count - null_count then least end as least,
  case when 2 * (wholes + floats) >= row_count - null_count then below end as negative,
  case part when 1 then 'mixed types: ' || case when strings > dates then format('{{:,}} string, {{:,}} date', strings, dates)
    else format('{{:,}} date, {{:,}} string', dates, strings) end || '; text dates alongside real dates (beside ' || format('{{:,}}', dates) || ' real ones)'
  when 2 then 'mixed types: ' || format('{{:,}} integer, {{:,}} string', wholes, strings) || '; leading or trailing whitespace (' || format('{{:,}}', spaced) ||
    ' cells); empty strings (' || format('{{:,}}', blank) || ' cells)' else '' end as found
from n where part < 3""")
def cell_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of a cell table: real numbers; dates, half of them as text; whole numbers beside texts of other kinds."""
    cells = table(spark, folder, "orders").where("o_custkey % 4 < 3").select(
        F.expr("o_custkey % 4").alias("part"), F.expr(_KIND.replace("varchar", "string")).alias("kind"),
        F.expr(_CELL.format(day="date_format(o_orderdate, 'yyyy-MM-dd')").replace("varchar", "string")).alias("value"))
    rows = cell_profile(cells, ["part"])
    return rows.select("part", "row_count", "null_count", "dtype", F.col("numeric.min").alias("least"), F.col("numeric.negative_count").alias("negative"),
                       F.array_join("format_anomalies", "; ").alias("found"))


_CONTRACT = C.Contract(
    "orders", [
        C.ColumnContract("o_orderkey", "Int64", nullable=False, unique=True),
        C.ColumnContract("o_custkey", "Float64", unique=True),
        C.ColumnContract("o_orderstatus", "String", allowed_values=["F", "O", "P"]),
        C.ColumnContract("o_totalprice", "Float64", nullable=False, min_value=10000, max_value=400000),
        C.ColumnContract("o_orderpriority", "String", allowed_values=["1-URGENT", "2-HIGH", "3-MEDIUM"]),
        C.ColumnContract("o_orderdate", "String"),
        C.ColumnContract("o_comment", "String"),
    ], min_rows=1000, max_rows=2000, unique_key=["o_custkey", "o_orderdate"], require_column_order=True)


@query("""
with o as (select * replace (case when o_orderkey % 101 = 0 then null else o_totalprice end as o_totalprice) from orders),
m as (select count(*) as n, count(*) filter (where o_totalprice is null) as nulls, count(o_custkey) - count(distinct o_custkey) as more,
  count(*) filter (where o_totalprice < 10000) + count(*) filter (where o_totalprice > 400000) as outside,
  (select string_agg(p, ', ' order by p) from (select distinct o_orderpriority as p from o where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM'))) as stray,
  count(*) - count(distinct (o_custkey, o_orderdate)) as key_more from o),
s(position, "check", "column", status) as (values (0, 'columns_present', null, 'FAIL'), (1, 'column_order', null, 'FAIL'), (2, 'row_count', null, 'range'),
  (3, 'dtype', 'o_orderkey', 'PASS'), (4, 'not_null', 'o_orderkey', 'PASS'), (5, 'unique', 'o_orderkey', 'PASS'), (6, 'dtype', 'o_custkey', 'PASS'),
  (7, 'unique', 'o_custkey', 'more'), (8, 'dtype', 'o_orderstatus', 'PASS'), (9, 'allowed_values', 'o_orderstatus', 'PASS'), (10, 'dtype', 'o_totalprice', 'PASS'),
  (11, 'not_null', 'o_totalprice', 'nulls'), (12, 'value_range', 'o_totalprice', 'outside'), (13, 'dtype', 'o_orderpriority', 'PASS'),
  (14, 'allowed_values', 'o_orderpriority', 'stray'), (15, 'dtype', 'o_orderdate', 'FAIL'), (16, 'dtype', 'o_comment', 'SKIP'), (17, 'unique_key', null, 'key'))
select position, "check", "column", case status when 'range' then case when n between 1000 and 2000 then 'PASS' else 'FAIL' end
    when 'more' then case when more = 0 then 'PASS' else 'FAIL' end when 'nulls' then case when nulls = 0 then 'PASS' else 'FAIL' end
    when 'outside' then case when outside = 0 then 'PASS' else 'FAIL' end when 'stray' then case when stray is null then 'PASS' else 'FAIL' end
    when 'key' then case when key_more = 0 then 'PASS' else 'FAIL' end else status end as status,
  case status when 'range' then format('{:,}', n) when 'more' then format('{:,} duplicate value(s)', more) when 'nulls' then format('{:,} nulls', nulls)
    when 'stray' then stray when 'key' then format('{:,} duplicate key(s)', key_more) end as actual
from s, m""")
def contract_orders(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = table(spark, folder, "orders").withColumn("o_totalprice", F.when(key % 101 != 0, F.col("o_totalprice")))
    checks = C.validate(orders, _CONTRACT).to_frame(spark)
    counted = (F.col("check").isin("row_count", "unique_key") | (F.col("check") == "unique") & (F.col("column") == "o_custkey")
               | (F.col("check") == "not_null") & (F.col("column") == "o_totalprice")
               | (F.col("check") == "allowed_values") & (F.col("column") == "o_orderpriority"))
    return checks.select("position", "check", "column", "status", F.when(counted, F.col("actual")).alias("actual"))


@query(" union all ".join(
    f"""select '{c}' as column, '{t}' as dtype, count(*) > count({c}) as nullable, count({c}) > 0 and count(distinct {c}) = count({c}) and count(*) > 1 as is_unique,
    {f"case when count(*) >= 20 and count(distinct {c}) between 1 and 12 then string_agg(distinct {c}, ',' order by {c}) end" if t == 'String' else 'cast(null as varchar)'} as allowed,
    cast(floor(count(*) * 0.5) as bigint) as min_rows, cast(floor(count(*) * 1.5) as bigint) + 1 as max_rows from orders""" for c, t in ORDERS.items()))
def inferred_contract(spark: SparkSession, folder: str) -> DataFrame:
    """A contract drafted from the table; it holds on the table it came from."""
    orders = table(spark, folder, "orders").select(*ORDERS)
    drafted, _ = C.infer_contract(orders, "orders")
    C.validate(orders, drafted).raise_for_status()
    rows = [(c.name, c.dtype, c.nullable, c.unique, ",".join(c.allowed_values) if c.allowed_values else None, drafted.min_rows, drafted.max_rows)
            for c in drafted.columns]
    return spark.createDataFrame(rows, "column string, dtype string, nullable boolean, is_unique boolean, allowed string, min_rows bigint, max_rows bigint")


@query(" union all ".join(
    f"""select '{c}' as column, '{ {'Int64': 'Float64', 'Float64': 'Float64', 'String': 'String', 'Datetime': 'Any'}[t] }' as dtype, {'false' if c == 'o_orderkey' else 'true'} as nullable,
    count(*) // 4 as min_rows, count(*) * 4 as max_rows from orders""" for c, t in ORDERS.items()))
def sketched_contract(spark: SparkSession, folder: str) -> DataFrame:
    rows = profile(table(spark, folder, "orders").select(*ORDERS), exact=True).collect()
    drafted, _ = C.sketch_contract(rows, "orders")
    return spark.createDataFrame([(c.name, c.dtype, c.nullable, drafted.min_rows, drafted.max_rows) for c in drafted.columns],
                                 "column string, dtype string, nullable boolean, min_rows bigint, max_rows bigint")


@query("""
with n as (select count(*) as was, count(*) filter (where o_orderkey % 3 <> 0) as now, count(*) filter (where o_orderkey % 3 <> 0 and o_orderkey % 5 = 0) as nulls from orders)
select 'numeric_to_text' as kind, 'ERROR' as severity, 'o_custkey' as column, 'Int64' as before, 'String' as after union all
select 'column_removed', 'ERROR', 'o_orderdate', 'Datetime', null union all
select 'column_renamed', 'WARNING', 'o_totalprice_gbp', 'o_totalprice', 'o_totalprice_gbp' union all
select 'null_rate_shift', 'WARNING', 'o_orderstatus', '0.0%', format('{:.1f}%', 100.0 * nulls / now) from n union all
select 'row_count_shift', 'WARNING', null, format('{:,}', was), format('{:,}', now) from n union all
select 'column_added', 'INFO', 'loaded_on', null, 'Date'""")
def drift_orders(spark: SparkSession, folder: str) -> DataFrame:
    before = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    after = before.where(key % 3 != 0).select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.when(key % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.col("o_totalprice").alias("o_totalprice_gbp"), F.lit("2026-06-30").cast("date").alias("loaded_on"), "o_orderpriority")
    report = compare_shape(shape_of(profile(before)), shape_of(profile(after)))
    return report.to_frame(spark).select("kind", "severity", "column", "before", "after")


@query("select 'first' as delivery, 0 as items, 0 as errors union all select 'second', 1, 0")
def drift_against_accepted(spark: SparkSession, folder: str) -> DataFrame:
    """A first delivery has nothing to differ from; after it is accepted the next one is compared with it."""
    store, orders = scratch(spark, "shapes"), table(spark, folder, "orders")
    shape, first = check_drift(spark, orders, delivery.Layout(), store, "one")
    receipts.accept_shape(spark, store, shape)
    _, second = check_drift(spark, orders.withColumn("extra", F.lit(1)), delivery.Layout(), store, "two")
    return spark.createDataFrame([(n, len(r.items), len(r.errors)) for n, r in (("first", first), ("second", second))],
                                 "delivery string, items int, errors int")
