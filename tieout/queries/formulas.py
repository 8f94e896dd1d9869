"""Formula shapes on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieout.functions.aggregates import sumproduct
from tieout.operators import formulas, lookups, ordered
from tieout.queries.registry import money, query, table


def _amount(name: str):
    return F.col(name).cast("decimal(18,4)")


@query("""
select p_partkey, 'GBP' as currency, case when p_size > 25 then 'large' else 'small' end as size_word,
  case when p_retailprice < 950 then 'low' when p_retailprice < 1000 then 'mid' when p_retailprice < 1050 then 'high' else 'top' end as band,
  case when p_size < 10 then 1 when p_size < 20 then 2 end as ifs_band
from part""")
def price_band(spark: SparkSession, folder: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, folder, "part").select(
        "p_partkey", F.lit("GBP").alias("currency"),
        formulas.if_simple(size > 25, F.lit("large"), F.lit("small")).alias("size_word"),
        formulas.if_nested([(price < 950, F.lit("low")), (price < 1000, F.lit("mid")), (price < 1050, F.lit("high"))], F.lit("top")).alias("band"),
        formulas.if_nested([(size < 10, F.lit(1)), (size < 20, F.lit(2))]).alias("ifs_band"))


@query(f"""
select {money("case when l_returnflag = 'R' then l_extendedprice end")} as returned,
  avg(case when l_returnflag = 'R' then l_quantity end) as returned_quantity,
  count(*) filter (where l_returnflag = 'R') as returned_lines,
  cast(coalesce(sum(cast(case when l_returnflag = 'none' then l_extendedprice end as decimal(18,4))), 0) as double) as nothing,
  cast(sum(cast(l_quantity * l_extendedprice as decimal(28,4))) as double) as product_sum,
  cast(sum(cast(case when l_tax > 0.04 then l_quantity * l_extendedprice end as decimal(28,4))) as double) as product_sum_taxed
from lineitem""")
def scalar_conditions(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    returned = F.col("l_returnflag") == "R"
    exact = (F.col("l_quantity") * F.col("l_extendedprice")).cast("decimal(28,4)")
    return lines.agg(
        formulas.sumif(returned, _amount("l_extendedprice")).cast("double").alias("returned"),
        formulas.averageif(returned, F.col("l_quantity")).alias("returned_quantity"),
        formulas.countif(returned).alias("returned_lines"),
        formulas.sumif(F.col("l_returnflag") == "none", _amount("l_extendedprice")).cast("double").alias("nothing"),
        F.sum(exact).cast("double").alias("product_sum"),
        F.sum(F.when(F.col("l_tax") > 0.04, exact)).cast("double").alias("product_sum_taxed"))


@query("""
select l_returnflag, l_linestatus, round(sum(l_quantity * l_discount), 2) as weighted,
  round(coalesce(sum(case when l_tax > 0.04 then l_quantity * l_discount end), 0), 2) as weighted_taxed
from lineitem group by all""")
def sumproduct_flags(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("l_quantity"), F.col("l_discount")
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(sumproduct(a, b), 2).alias("weighted"), F.round(sumproduct(a, b, F.col("l_tax") > 0.04), 2).alias("weighted_taxed"))


@query(f"""
with s as (select l_suppkey, l_linestatus, {money("l_extendedprice")} as supplied from lineitem where l_returnflag = 'R' group by all)
select s_suppkey, s_name, coalesce(s.supplied, 0) as returned_open from supplier
left join s on l_suppkey = s_suppkey and l_linestatus = 'O'""")
def sumifs_supplier(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier").withColumn("wanted", F.lit("O"))
    out = lookups.sumifs(suppliers, table(spark, folder, "lineitem"), {"s_suppkey": "l_suppkey", "wanted": "l_linestatus"},
                         _amount("l_extendedprice"), "total", where=F.col("l_returnflag") == "R")
    return out.select("s_suppkey", "s_name", F.col("total").cast("double").alias("returned_open"))


@query("""
select c_custkey, coalesce(n, 0) as urgent_orders from customer left join
 (select o_custkey, count(*) as n from orders where o_orderpriority = '1-URGENT' group by 1) on o_custkey = c_custkey""")
def countifs_customer(spark: SparkSession, folder: str) -> DataFrame:
    out = lookups.countifs(table(spark, folder, "customer"), table(spark, folder, "orders"), {"c_custkey": "o_custkey"},
                           "urgent_orders", where=F.col("o_orderpriority") == "1-URGENT")
    return out.select("c_custkey", "urgent_orders")


@query("""
select p_partkey, q as mean_quantity from part left join
 (select l_partkey, avg(l_quantity) as q from lineitem where l_quantity > 45 group by 1) on l_partkey = p_partkey""")
def averageifs_part(spark: SparkSession, folder: str) -> DataFrame:
    out = lookups.averageifs(table(spark, folder, "part"), table(spark, folder, "lineitem"), {"p_partkey": "l_partkey"},
                             F.col("l_quantity"), "mean_quantity", where=F.col("l_quantity") > 45)
    return out.select("p_partkey", "mean_quantity")


@query("""
select c_custkey, n_name, r_name from customer left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey""")
def vlookup_nation(spark: SparkSession, folder: str) -> DataFrame:
    named = lookups.lookup_first(table(spark, folder, "customer"), table(spark, folder, "nation"), ["c_nationkey"], ["n_nationkey"],
                                 {"n_name": "n_name", "n_regionkey": "n_regionkey"}, ["n_nationkey"])
    return lookups.lookup_first(named, table(spark, folder, "region"), ["n_regionkey"], ["r_regionkey"],
                                {"r_name": "r_name"}, ["r_regionkey"]).select("c_custkey", "n_name", "r_name")


@query("""
with first as (select * from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1)
select c_custkey, o_orderkey as first_order, o_orderpriority as first_priority from customer left join first on o_custkey = c_custkey""")
def vlookup_first_order(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.lookup_first(
        table(spark, folder, "customer"), table(spark, folder, "orders"), ["c_custkey"], ["o_custkey"],
        {"first_order": "o_orderkey", "first_priority": "o_orderpriority"}, ["o_orderdate", "o_orderkey"],
    ).select("c_custkey", "first_order", "first_priority")


@query("""
with bought as (select user_id, ts as bought_at, event_id as purchase, value as paid from events where event_type = 'purchase')
select e.event_id, b.purchase as last_purchase, b.paid as last_paid from (select * from events where event_type <> 'purchase') e
asof left join bought b on e.user_id = b.user_id and e.ts >= b.bought_at""")
def asof_purchase(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    bought = events.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("bought_at"), F.col("event_id").alias("purchase"), F.col("value").alias("paid"))
    return lookups.lookup_nearest(
        events.where(F.col("event_type") != "purchase"), bought, "ts", "bought_at",
        {"last_purchase": "purchase", "last_paid": "paid"}, by=["user_id"], order=["purchase"],
    ).select("event_id", "last_purchase", "last_paid")


@query("""
with s as (select s_acctbal, max(s_suppkey) as s_suppkey from supplier group by 1)
select c_custkey, s.s_suppkey as nearest_supplier from customer asof left join s on c_acctbal >= s.s_acctbal""")
def nearest_balance(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.lookup_nearest(
        table(spark, folder, "customer"), table(spark, folder, "supplier"), "c_acctbal", "s_acctbal",
        {"nearest_supplier": "s_suppkey"}, order=["s_suppkey"]).select("c_custkey", "nearest_supplier")


@query("""
select event_id, cast(sum(cast(value as decimal(18,4))) over (partition by user_id order by ts, event_id rows unbounded preceding) as double) as spent_so_far,
  row_number() over (partition by user_id order by ts, event_id) as place from events""")
def running_total_user(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", _amount("value").alias("amount"))
    base = ordered.sliced(events, ["user_id"], ["ts", "event_id"])
    total = ordered.add_running(base, F.col("amount"), "spent_so_far")
    place = ordered.add_running(total, F.lit(1).cast("bigint"), "place")
    return place.df.select("event_id", F.col("spent_so_far").cast("double").alias("spent_so_far"), "place")


@query("""
select event_id, lag(event_type) over w as prior_type, lag(value) over w as prior_value from events
window w as (partition by user_id order by ts, event_id)""")
def prior_event(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.prior_row(
        table(spark, folder, "events"), ["user_id"], ["ts", "event_id"],
        {"prior_type": "event_type", "prior_value": "value"}).select("event_id", "prior_type", "prior_value")


@query(f"""
select o_custkey, {money("case when o_orderstatus = 'F' then o_totalprice end")} as f_total,
  {money("case when o_orderstatus = 'O' then o_totalprice end")} as o_total,
  {money("case when o_orderstatus = 'P' then o_totalprice end")} as p_total
from orders group by 1""")
def pivot_status(spark: SparkSession, folder: str) -> DataFrame:
    return formulas.pivot(table(spark, folder, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"],
                          F.sum(_amount("o_totalprice")).cast("double"), ["f_total", "o_total", "p_total"])


@query(f"select count(*) as visible, {money('l_quantity')} as quantity, max(l_extendedprice) as dearest from lineitem where l_shipdate >= timestamp '1996-01-01'")
def subtotal_visible(spark: SparkSession, folder: str) -> DataFrame:
    return formulas.subtotal(
        table(spark, folder, "lineitem"), F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"),
        {"visible": F.count(F.lit(1)), "quantity": F.sum(_amount("l_quantity")).cast("double"), "dearest": F.max("l_extendedprice")})


@query("""
select o_orderkey, o_totalprice * (select n_nationkey from nation where n_name = (select max(n_name) from nation)) as scaled,
  case o_orderstatus when 'F' then 'finished' when 'O' then 'open' when 'P' then 'pending' end as state from orders""")
def parameters_and_mapping(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation")
    factor = formulas.parameter_value(nations, nations.agg(F.max("n_name")).first()[0], "n_name", "n_nationkey")
    state = formulas.map_strict(F.col("o_orderstatus"), {"F": "finished", "O": "open", "P": "pending"})
    return table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") * factor).alias("scaled"), state.alias("state"))
