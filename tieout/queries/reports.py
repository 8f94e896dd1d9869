"""Verdicts on the given tables: refused shapes, causes of differences, contracts, layouts, run log, examples."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieout.errors import UnknownPatternError
from tieout.functions.numeric import round_half_away
from tieout.operators import audit
from tieout.operators import contract as C
from tieout.operators.compare import Region, find_actual, reconcile_many
from tieout.operators.drift import compare_shape, shape_of
from tieout.operators.formulas import function_for, operators_for
from tieout.operators.profile import profile
from tieout.queries.handed import _KEYS_A_FILE, _delivery
from tieout.queries.registry import query, table
from tieout.session import scratch_folder
from tieout.sources import receipts
from tieout.sources.files import content_hashes, list_files


def _refused(lookup, name: str) -> bool:
    try:
        lookup(name)
    except UnknownPatternError:
        return True
    return False


_SHAPES = """case o_orderkey % 7 when 0 then 'running_total' when 1 then 'pivot' when 2 then 'unknown' when 3 then 'array_' || lower(o_orderstatus)
  else 'literal' end"""


@query(f"""
select {_SHAPES} as shape, count(*) as cells, {_SHAPES} not in ('running_total', 'pivot', 'literal') as refused from orders group by all""")
def shapes_refused(spark: SparkSession, folder: str) -> DataFrame:
    """Cells by formula shape, and whether the shape has a column meaning; others are refused, not guessed."""
    counted = table(spark, folder, "orders").groupBy(F.expr(_SHAPES).alias("shape")).agg(F.count(F.lit(1)).alias("cells"))
    rows = [(r["shape"], r["cells"], _refused(operators_for, r["shape"])) for r in counted.collect()]  # a row for each shape
    return spark.createDataFrame(rows, "shape string, cells long, refused boolean")


_CALLS = "case event_id % 6 when 0 then 'SUM' when 1 then 'now' when 2 then 'TODAY' when 3 then 'Rand' when 4 then upper(event_type) else 'trim' end"


@query(f"""
select {_CALLS} as name, count(*) as calls, {_CALLS} not in ('SUM', 'trim') as refused from events group by all""")
def functions_refused(spark: SparkSession, folder: str) -> DataFrame:
    """Function names by use; those that change on every run are refused like unknown ones."""
    counted = table(spark, folder, "events").groupBy(F.expr(_CALLS).alias("name")).agg(F.count(F.lit(1)).alias("calls"))
    rows = [(r["name"], r["calls"], _refused(function_for, r["name"])) for r in counted.collect()]  # a row for each name
    return spark.createDataFrame(rows, "name string, calls long, refused boolean")


@query("""
with n as (select count(*) as n, count(*) filter (where o_orderkey % 4 = 1) as odd, count(*) filter (where o_orderkey % 7 = 0) as zero,
  count(*) filter (where o_orderkey % 10 = 3) as twice, count(*) filter (where o_orderkey % 3 = 0) as third from orders)
select 'ties' as region, 'rounding_mode' as cause, cast(0.9 as double) as confidence, odd as affected_rows from n union all
select 'digits', 'rounding_15_digit_collapse', 0.8, third from n union all
select 'zeros', 'divide_by_zero', 0.9, zero from n union all
select 'repeats', 'join_key_not_unique', 0.85, twice from n""")
def further_causes(spark: SparkSession, folder: str) -> DataFrame:
    """Differences that look like half-to-even rounding, lost digits, divisions by zero and a lookup key found twice."""
    orders, key = table(spark, folder, "orders").select("o_orderkey"), F.col("o_orderkey")
    place = (key + 1).alias("place")
    # A quarter of the values end in 0.125, of which half away from zero and half to even make two different cents.
    tie = key.cast("double") + F.when(key % 4 == 1, 0.125).otherwise(0.25)
    ties = orders.select(place, round_half_away(tie, 2).alias("want"), F.bround(tie, 2).alias("got"))
    # A cent apart, with an even last digit where one is expected: no tie can make that.
    digits = orders.select(place, F.round(key + F.lit(0.52), 2).alias("want"),
                           F.round(key + F.when(key % 3 == 0, 0.51).otherwise(0.52), 2).alias("got"))
    zeros = orders.select(place, key.cast("double").alias("want"),
                          F.when(key % 7 == 0, F.lit(float("inf"))).otherwise(key.cast("double")).alias("got"))
    once = orders.select(place, key.cast("double").alias("want"))
    # The rows a repeated key adds come behind the others.
    added = orders.where(key % 10 == 3).select((key + 10**12).alias("place"), key.cast("double").alias("want"))
    regions = [Region("ties", ties, "want", "got", actual=ties, ordinal="place"), Region("digits", digits, "want", "got", actual=digits, ordinal="place"),
               Region("zeros", zeros, "want", "got", actual=zeros, ordinal="place"),
               Region("repeats", once, "want", "want", actual=once.unionByName(added), ordinal="place")]
    rows = [(r.id, d.cause, round(d.confidence, 6), d.affected_rows) for r in reconcile_many(regions).regions for d in r.diagnoses]
    return spark.createDataFrame(rows, "region string, cause string, confidence double, affected_rows long")


@query("""
select 'by_name' as region, count(*) as height, sum(o_orderkey) as total from orders where o_orderstatus = 'F' union all
select 'by_height', count(*), sum(o_orderkey) from orders where o_orderstatus = 'O' union all select 'nowhere', null, null""")
def frames_found(spark: SparkSession, folder: str) -> DataFrame:
    """The frame a region means: the named one, else that of its height among those with the column."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    frames = {"filled": orders.where("o_orderstatus = 'F'"), "open": orders.where("o_orderstatus = 'O'"), "_hidden": orders,
              "other": orders.select("o_totalprice")}
    regions = [Region("by_name", orders, "o_orderkey", "o_orderkey", variable="filled"),
               Region("by_height", orders.where("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey", "o_orderkey"),
               Region("nowhere", orders, "o_orderkey", "no_such_column")]
    out = None
    for region in regions:
        found = find_actual(frames, region)
        sums = (orders.where("false") if found is None else found).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total")).select(
            F.lit(region.id).alias("region"), F.when(F.col("n") > 0, F.col("n")).alias("height"), "total")
        out = sums if out is None else out.unionByName(sums)
    return out


_NAMES = "(select sha256(string_agg(n_name, ',' order by n_nationkey)) as digest from nation)"


@query(f"""
select mode, case mode when 'require' then 'fail' else 'warn' end as other, 'pass' as same, substr(digest, 1, 12) as actual
from {_NAMES}, (values ('require'), ('warn')) as m(mode)""")
def checksums_checked(spark: SparkSession, folder: str) -> DataFrame:
    """A contract's checksum against the recorded bytes and against others, as a requirement and as a warning."""
    nation = table(spark, folder, "nation")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ",")
    digest = nation.agg(F.sha2(text, 256).alias("digest")).first()["digest"]
    rows = []
    for mode in ("require", "warn"):
        seen = []
        for recorded in ("0" * 64, digest):
            contract = C.Contract("nation", [C.ColumnContract("n_name", "String")], allow_extra_columns=True, checksum=recorded, checksum_mode=mode)
            seen += [c for c in C.validate(nation, contract, digest).checks if c.check == "checksum"]
        rows.append((mode, seen[0].status.lower(), seen[1].status.lower(), seen[0].actual))
    return spark.createDataFrame(rows, "mode string, other string, same string, actual string")


_COLUMNS = {"c_custkey": "Int64", "c_name": "String", "c_nationkey": "Int32", "c_acctbal": "Float64", "c_mktsegment": "String"}


@query(" union all ".join(
    f"""select '{c}' as column, '{t}' as dtype, count(*) > count({c}) as nullable,
    count({c}) > 0 and count(distinct {c}) = count({c}) and count(*) > 1 as is_unique, cast(floor(count(*) * 0.5) as bigint) as min_rows from customer"""
    for c, t in _COLUMNS.items()))
def contract_kept(spark: SparkSession, folder: str) -> DataFrame:
    """A drafted contract, saved twice, the second time changed, and loaded again."""
    path = scratch_folder(spark, "contracts")
    drafted, _ = C.infer_contract(table(spark, folder, "customer").select(*_COLUMNS), "customer")
    C.save_contract(C.Contract("customer", drafted.columns[:1]), spark, path)
    C.save_contract(drafted, spark, path)
    loaded = C.load_contract(spark, path, "customer")
    rows = [(c.name, c.dtype, c.nullable, c.unique, loaded.min_rows) for c in loaded.columns]
    return spark.createDataFrame(rows, "column string, dtype string, nullable boolean, is_unique boolean, min_rows long")




@query("""
select 'amount' as column, true as warned union all select 'label', false""")
def text_numbers_warned(spark: SparkSession, folder: str) -> DataFrame:
    """Drafting a contract warns of a text column of which nine in ten cells are numbers."""
    key, name = F.col("c_custkey"), F.col("c_name")
    amount = F.when(key % 10 < 7, F.concat(F.lit("£"), key.cast("string"), F.lit(".50"))).when(key % 10 == 7, "(12)").when(
        key % 10 == 8, "5 %").otherwise(name)
    label = F.when(key % 10 < 7, key.cast("string")).otherwise(name)
    _, notes = C.infer_contract(table(spark, folder, "customer").select(amount.alias("amount"), label.alias("label")), "cells")
    rows = [(c, any("numbers stored as text" in n for n in notes.get(c, []))) for c in ("amount", "label")]
    return spark.createDataFrame(rows, "column string, warned boolean")


@query("""
with n as (select count(*) as orders, count(*) filter (where o_orderstatus = 'P') as part from orders)
select 'sheet_changed' as kind, 'WARNING' as severity, 'Orders' as before, 'Orders of ' || part as after from n union all
select 'preamble_rows_changed', 'WARNING', cast(orders % 5 as varchar), cast(orders % 5 + 2 as varchar) from n union all
select 'totals_row_appended', 'WARNING', 'absent', 'present' union all
select 'totals_row_removed', 'INFO', 'present', 'absent'""")
def layout_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Two deliveries of the same rows that are laid out differently, compared both ways."""
    orders = table(spark, folder, "orders")
    counts = orders.agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "P").alias("part")).first()
    columns = profile(orders.select("o_orderkey", "o_orderstatus"))
    here = shape_of(columns, "a", preamble_rows=counts["orders"] % 5, sheet="Orders")
    there = shape_of(columns, "b", preamble_rows=counts["orders"] % 5 + 2, has_totals_row=True, sheet=f"Orders of {counts['part']}")
    same = shape_of(columns, "c", preamble_rows=counts["orders"] % 5 + 2, sheet=f"Orders of {counts['part']}")
    found = compare_shape(here, there).to_frame(spark).unionByName(compare_shape(there, same).to_frame(spark))
    return found.select("kind", "severity", "before", "after")


@query(f"""
with d as (select o_orderkey // {_KEYS_A_FILE} as part, 'key,status' || chr(10) || string_agg(o_orderkey || ',' || o_orderstatus || chr(10), '' order by o_orderkey) as content
  from orders group by 1),
l as (select sha256(content) as sha256, cast(octet_length(encode(content)) as bigint) as size_bytes from d order by part desc limit 1)
select 'march' as run_id, 'orders' as step, 'handin' as kind, sha256 as value, sha256 as found, size_bytes from l union all
select 'march', 'orders', 'decision', cast(count(*) as varchar) || ' files', null, null from d union all
select 'march', 'rate', 'parameter', '0.045', null, null""")
def delivery_used_before(spark: SparkSession, folder: str) -> DataFrame:
    """A run records which file it took, a decision and a parameter; the file is found again by its content."""
    store, log = scratch_folder(spark, "store"), scratch_folder(spark, "run-log")
    added = receipts.receive_paths(spark, f"{_delivery(spark, folder)}/*/*.csv", store)
    # The file with the largest keys, told by its first line of data.
    text = spark.read.text([r["path"] for r in added.select("path").collect()]).select("value", F.col("_metadata.file_path").alias("file"))
    part = F.expr(f"cast(split_part(value, ',', 1) as long) div {_KEYS_A_FILE}")
    last = text.where("value <> 'key,status'").agg(F.max(F.struct(part.alias("part"), "file")).alias("m")).first()["m"]["file"]
    name = last.rsplit("/", 1)[-1]
    taken = added.where(F.col("path").endswith(name)).first()
    at = dt.datetime(2026, 3, 31, tzinfo=dt.timezone.utc)
    audit.record_event(spark, log, "march", "orders", "handin", taken["sha256"], at=at)
    audit.record_event(spark, log, "march", "orders", "decision", f"{added.count()} files", at=at)
    audit.record_parameters(spark, log, "march", rate=0.045)
    events = audit.read_events(spark, log)
    path = receipts.previous_delivery(spark, events, "march", "orders", store)
    found = content_hashes(list_files(spark, path)).select(F.lit("handin").alias("kind"), F.col("sha256").alias("found"), F.col("length").alias("size_bytes"))
    return events.select("run_id", "step", "kind", "value").join(found, "kind", "left").select("run_id", "step", "kind", "value", "found", "size_bytes")


@query("""
with h as (select o_orderkey, o_orderpriority from orders order by o_orderkey limit 5), t as (select o_orderkey, o_orderpriority from orders order by o_orderkey desc limit 5)
select 'o_orderkey' as header, (select string_agg(o_orderkey, ',' order by o_orderkey) from h) as head, (select string_agg(o_orderkey, ',' order by o_orderkey) from t) as tail,
  5 as sampled, true as known union all
select 'o_orderpriority', (select string_agg(o_orderpriority, ',' order by o_orderkey) from h), (select string_agg(o_orderpriority, ',' order by o_orderkey) from t), 5, true""")
def example_rows(spark: SparkSession, folder: str) -> DataFrame:
    """First and last cells in order, and a sample that is drawn from the table."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    rows = profile(orders, order=["o_orderkey"])
    cells = rows.select("header", F.explode("sample").alias("cell")).distinct()
    seen = orders.select(F.lit("o_orderkey").alias("header"), F.col("o_orderkey").cast("string").alias("cell")).unionByName(
        orders.select(F.lit("o_orderpriority").alias("header"), F.col("o_orderpriority").alias("cell")))
    strange = cells.join(seen, ["header", "cell"], "left_anti").select("header").distinct().withColumn("known", F.lit(False))
    return rows.join(strange, "header", "left").select(
        "header", F.array_join("head", ",").alias("head"), F.array_join("tail", ",").alias("tail"), F.size("sample").alias("sampled"),
        F.coalesce("known", F.lit(True)).alias("known"))


@query(" union all ".join(
    f"""select '{c}' as header, {str(hidden).lower()} as redacted, count(distinct {c}) as distinct_count,
    {"null" if hidden else f"(select cast({c} as varchar) from customer group by {c} order by count(*) desc, cast({c} as varchar) limit 1)"} as commonest,
    {"cast(null as double)" if hidden or c == 'c_mktsegment' else f"cast(max({c}) as double)"} as largest from customer"""
    for c, hidden in (("c_custkey", False), ("c_name", True), ("c_acctbal", True), ("c_mktsegment", False))))
def redacted_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Columns whose headers match are counted, but none of their values is shown."""
    rows = profile(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), redact=["name$", "ACCT"])
    return rows.select("header", "redacted", "distinct_count", F.get("top_k", F.lit(0))["value"].alias("commonest"), F.col("numeric.max").alias("largest"))
