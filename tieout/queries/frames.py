"""Frame shaping on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieout.functions.numeric import round_half_away
from tieout.operators import frames
from tieout.queries.registry import query, table


@query("select c_custkey as customer_key, c_name as name, c_name as name_2, c_acctbal as balance_gbp, c_mktsegment as \"column\" from customer")
def clean_headers(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("  Customer Key "), F.col("c_name").alias("Name"), F.col("c_name").alias("Name "),
        F.col("c_acctbal").alias("Balance (GBP)"), F.col("c_mktsegment").alias("??"))
    return frames.normalise_headers(raw)


@query("select s_suppkey, s_name, case when s_suppkey % 7 = 0 then null else s_acctbal end as some_balance from supplier")
def drop_empty_columns(spark: SparkSession, folder: str) -> DataFrame:
    made = table(spark, folder, "supplier").select(
        "s_suppkey", "s_name", F.lit(None).cast("string").alias("spare"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("some_balance"),
        F.lit(None).cast("double").alias("spare_2"))
    return frames.drop_all_null_columns(made)


_WITH_TOTALS = """select o_orderkey, case when o_orderkey % 50 = 0 then ' Total ' when o_orderkey % 50 = 1 then null
  when o_orderkey % 50 = 2 then 'Grand Total' when o_orderkey % 50 = 3 then 'Carried Forward' else o_orderpriority end as label, o_totalprice from orders"""


def _with_totals(spark: SparkSession, folder: str) -> DataFrame:
    place = F.col("o_orderkey") % 50
    label = (F.when(place == 0, " Total ").when(place == 1, F.lit(None)).when(place == 2, "Grand Total")
             .when(place == 3, "Carried Forward").otherwise(F.col("o_orderpriority")))
    return table(spark, folder, "orders").select("o_orderkey", label.alias("label"), "o_totalprice")


@query(f"""select * from ({_WITH_TOTALS}) where label is not null and lower(trim(label)) not in ('total', 'totals', 'grand total', 'carried forward')""")
def strip_totals(spark: SparkSession, folder: str) -> DataFrame:
    return frames.strip_totals_rows(_with_totals(spark, folder), "label", ["Carried Forward"])


@query(f"""select * from ({_WITH_TOTALS}) where regexp_matches(label, '(?i)^\\s*(grand\\s+|sub[\\s-]*)?total')
  and o_orderkey < (select max(o_orderkey) from orders) - 1""")
def totals_in_the_middle(spark: SparkSession, folder: str) -> DataFrame:
    return frames.embedded_totals(_with_totals(spark, folder), "o_orderkey")


@query("select l_orderkey, l_linenumber, count(*) as occurrences from lineitem group by all having count(*) > 1")
def dup_keys(spark: SparkSession, folder: str) -> DataFrame:
    return frames.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_custkey from orders")
def unique_order_keys(spark: SparkSession, folder: str) -> DataFrame:
    orders = frames.assert_unique_key(table(spark, folder, "orders"), "o_orderkey", "orders")
    return orders.select("o_orderkey", "o_custkey")


@query("""
with p as (select o_orderkey, floor(o_totalprice / 7 * 100.0) as units, o_totalprice / 7 * 100.0 - floor(o_totalprice / 7 * 100.0) as rest from orders),
t as (select cast(sum(units) as bigint) + 4321 as target, count(*) as n, cast(sum(units) as bigint) as s from p),
r as (select *, row_number() over (order by rest desc, o_orderkey) as rn from p)
select o_orderkey, (units + floor((target - s) / n) + case when rn <= (target - s) % n then 1 else 0 end) / 100.0 as share from r, t""")
def allocate_total(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") / 7).alias("part"))
    units = parts.agg(F.sum(F.floor(F.col("part") * 100.0))).first()[0]
    return frames.allocate_residual(parts, "part", (units + 4321) / 100.0, ["o_orderkey"], into="share").select("o_orderkey", "share")


@query("""
with l as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice * l_tax / 3 as tax from lineitem),
p as (select *, floor(tax * 100.0) as units, tax * 100.0 - floor(tax * 100.0) as rest from l),
t as (select l_suppkey, cast(sum(units) as bigint) as s, count(*) as n, cast(sum(units) as bigint) + cast(count(*) // 3 as bigint) as target from p group by 1),
r as (select *, row_number() over (partition by l_suppkey order by rest desc, l_orderkey, l_linenumber, l_partkey, tax) as rn from p)
select l_suppkey, l_orderkey, l_linenumber, l_partkey, (units + floor((target - s) / n) + case when rn <= (target - s) % n then 1 else 0 end) / 100.0 as tax_share
from r join t using (l_suppkey)""")
def allocate_tax(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") * F.col("l_tax") / 3).alias("tax"))
    units = F.sum(F.floor(F.col("tax") * 100.0))
    totals = lines.groupBy("l_suppkey").agg(((units + F.floor(F.count(F.lit(1)) / 3)) / F.lit(100.0)).alias("total"))
    shared = frames.allocate_residual_by(lines, "tax", totals, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "tax"], into="tax_share")
    return shared.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "tax_share")


@query("""
select o_orderkey, o_totalprice, floor(o_totalprice * 0.045 * 100.0 + least(o_totalprice * 0.045 * 100.0 * 1e-15, 1e-3) + 0.5) / 100.0 as uplift
from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus <> 'P'""")
def scope_uplift(spark: SparkSession, folder: str) -> DataFrame:
    rows = frames.scope(table(spark, folder, "orders"), {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, {"o_orderstatus": "P"},
                        ["o_orderkey", "o_totalprice"])
    return rows.withColumn("uplift", round_half_away(F.col("o_totalprice") * 0.045, 2))


@query("""
with labels as (select conv_id, lower(trim(role)) as label from conversations where trim(role) <> '')
select conv_id, label, count(*) as occurrences from labels group by all having count(*) > 1""")
def repeated_labels(spark: SparkSession, folder: str) -> DataFrame:
    return frames.duplicate_headers(table(spark, folder, "conversations"), "conv_id", "role")
