"""Spreadsheet functions on the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieout.functions import aggregates as A, sheet as S
from tieout.operators import ranked
from tieout.queries.registry import query, table

HOLIDAYS = [dt.date(1995, 12, 25), dt.date(1995, 12, 26), dt.date(1996, 1, 1), dt.date(1996, 12, 25), dt.date(1997, 1, 1)]
_HOLIDAY_SQL = ", ".join(f"date '{d}'" for d in HOLIDAYS)


@query("""
with c as (select *, case event_id % 6 when 0 then null when 1 then '' when 2 then 'text' when 3 then 'TRUE' else cast(value as varchar) end as cell from events)
select event_type, cast(sum(cast(value as decimal(18,4))) as double) as total, round(avg(value), 6) as mean, min(value) as low, max(value) as high,
  count(*) filter (where event_id % 6 in (4, 5)) as numbers, count(cell) as filled, count(*) filter (where coalesce(cell, '') = '') as blank,
  round(sum(case event_id % 6 when 3 then 1.0 when 4 then value when 5 then value else 0 end) / count(cell), 6) as mean_with_text,
  round(stddev_samp(value), 6) as sd, round(stddev_pop(value), 6) as sdp, round(var_samp(value), 4) as v, round(var_pop(value), 4) as vp,
  round(exp(sum(ln(1 + value / 1e6))), 6) as compounded
from c group by 1""")
def aggregate_functions(spark: SparkSession, folder: str) -> DataFrame:
    kind, value = F.col("event_id") % 6, F.col("value")
    cell = (F.when(kind == 0, F.lit(None)).when(kind == 1, "").when(kind == 2, "text").when(kind == 3, "TRUE").otherwise(value.cast("string")))
    cells = table(spark, folder, "events").withColumn("cell", cell)
    cell = F.col("cell")
    return cells.groupBy("event_type").agg(
        A.sum_(value.cast("decimal(18,4)")).cast("double").alias("total"), F.round(A.average(value), 6).alias("mean"),
        A.minimum(value).alias("low"), A.maximum(value).alias("high"), A.count(cell).alias("numbers"), A.counta(cell).alias("filled"),
        A.countblank(cell).alias("blank"), F.round(A.averagea(cell), 6).alias("mean_with_text"), F.round(A.stdev(value), 6).alias("sd"),
        F.round(A.stdevp(value), 6).alias("sdp"), F.round(A.var(value), 4).alias("v"), F.round(A.varp(value), 4).alias("vp"),
        F.round(A.product(1 + value / 1e6), 6).alias("compounded"))


@query("""
select l_returnflag, quantile_cont(l_extendedprice, 0.5) as median, round(quantile_cont(l_extendedprice, 0.9), 6) as p90,
  quantile_cont(l_extendedprice, 0.25) as q1 from lineitem group by 1""")
def percentile_functions(spark: SparkSession, folder: str) -> DataFrame:
    out = ranked.percentiles_by(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice",
                                {"median": 0.5, "p90": 0.9, "q1": 0.25})
    return out.withColumn("p90", F.round("p90", 6))


@query("select quantile_cont(l_quantity, 0.5) as median, quantile_cont(l_quantity, 0.75) as q3 from lineitem")
def percentile_whole_table(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.percentiles_by(table(spark, folder, "lineitem"), [], "l_quantity", {"median": 0.5, "q3": 0.75})


@query("select p_brand, median(p_retailprice) as middle, quantile_cont(p_size, 0.75) as upper from part group by 1")
def median_by_brand(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    middle = ranked.median_by(parts, ["p_brand"], "p_retailprice", "middle")
    return middle.join(ranked.quartile_by(parts, ["p_brand"], "p_size", 3, "upper"), "p_brand")


@query("""
with counted as (select l_suppkey, l_quantity, count(*) as n from lineitem group by all),
best as (select *, row_number() over (partition by l_suppkey order by n desc, l_quantity) as rn from counted),
ranked as (select l_suppkey, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice desc) as hi,
  row_number() over (partition by l_suppkey order by l_extendedprice) as lo from lineitem)
select b.l_suppkey, b.l_quantity as usual, h.l_extendedprice as third_dearest, l.l_extendedprice as second_cheapest from best b
left join ranked h on h.l_suppkey = b.l_suppkey and h.hi = 3 left join ranked l on l.l_suppkey = b.l_suppkey and l.lo = 2 where b.rn = 1""")
def rank_functions(spark: SparkSession, folder: str) -> DataFrame:
    lines, key = table(spark, folder, "lineitem"), ["l_suppkey"]
    usual = ranked.mode_by(lines, key, "l_quantity", "usual")
    third = ranked.kth_value(lines, key, "l_extendedprice", 3, True, "third_dearest")
    second = ranked.kth_value(lines, key, "l_extendedprice", 2, False, "second_cheapest")
    return usual.join(third, key, "left").join(second, key, "left")


@query("""
select p_partkey, coalesce(p_name, '') || coalesce(p_brand, '') as joined, concat_ws('-', nullif(p_brand, ''), nullif(p_type, '')) as dashed,
  left(p_name, 4) as l4, right(p_name, 4) as r4, substr(p_name, 3, 5) as m5, trim(regexp_replace('  ' || p_name || '  x ', ' +', ' ', 'g')) as trimmed,
  upper(p_type) as up, lower(p_type) as low, replace(p_type, 'A', '-') as swapped, left(p_name, 1) || '##' || substr(p_name, 4) as replaced,
  repeat(left(p_brand, 2), 3) as rept, cast(length(p_name) as integer) as len, cast(nullif(position('B' in p_brand), 0) as integer) as found,
  cast(nullif(position('e' in lower(p_type)), 0) as integer) as searched, format('{:,.2f}', p_retailprice) as shown, format('{:.0f}', floor(p_retailprice + 0.5)) as whole,
  p_retailprice as valued, p_name || 'x' as cleaned
from part""")
def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    name, brand, kind, price = (F.col(c) for c in ("p_name", "p_brand", "p_type", "p_retailprice"))
    return table(spark, folder, "part").select(
        "p_partkey", S.concatenate(name, brand).alias("joined"), S.textjoin("-", brand, kind).alias("dashed"), S.left(name, 4).alias("l4"),
        S.right(name, 4).alias("r4"), S.mid(name, 3, 5).alias("m5"), S.trim(F.concat(F.lit("  "), name, F.lit("  x "))).alias("trimmed"),
        F.upper(kind).alias("up"), F.lower(kind).alias("low"), S.substitute(kind, "A", "-").alias("swapped"),
        S.replace(name, 2, 2, "##").alias("replaced"), S.rept(S.left(brand, 2), 3).alias("rept"), F.length(name).alias("len"),
        S.find("B", brand).alias("found"), S.search("E", kind).alias("searched"), S.text(price, "#,##0.00").alias("shown"),
        S.text(price, "0").alias("whole"), S.value(S.text(price, "#,##0.00")).alias("valued"),
        S.clean(F.concat(name, F.lit("\t\x07x"))).alias("cleaned"))


@query("""
select n_nationkey, list_aggregate(list_transform(regexp_extract_all(lower(n_name || '-o''neil 3rd'), '[a-z]+|[^a-z]+'),
  lambda x: upper(x[1]) || x[2:]), 'string_agg', '') as proper from nation""")
def proper_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select("n_nationkey", S.proper(F.concat("n_name", F.lit("-O'NEIL 3RD"))).alias("proper"))


@query("select c_nationkey, string_agg(c_mktsegment, '/' order by c_custkey) as segments from customer group by 1")
def textjoin_down(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.textjoin_by(table(spark, folder, "customer"), ["c_nationkey"], "c_mktsegment", "/", ["c_custkey"], "segments")


@query("""
with d as (select o_orderkey, cast(o_orderdate as date) as d, o_orderdate as ts, date '1998-08-31' as e from orders)
select o_orderkey, cast(make_date(year(d), 1, 1) + to_months(month(d) + 13) as date) + cast(day(d) + 29 as integer) as rolled,
  cast(year(d) as integer) as y, cast(month(d) as integer) as m, cast(day(d) as integer) as dd, cast(hour(ts) as integer) as hh, cast(minute(ts) as integer) as mi, cast(second(ts) as integer) as ss,
  last_day(cast(d + interval 1 month as date)) as month_end, cast(d + interval 3 month as date) as plus3,
  cast(case when e < d then null else e - d end as integer) as days, cast(case when e < d then null else (year(e) - year(d)) * 12 + month(e) - month(d) - case when day(e) < day(d) then 1 else 0 end end as integer) as months,
  cast(dayofweek(d) + 1 as integer) as wd, cast(floor((dayofyear(d) + dayofweek(date_trunc('year', d)) - 1) / 7.0) + 1 as integer) as wn,
  d as valued
from d""")
def date_functions(spark: SparkSession, folder: str) -> DataFrame:
    d, ts, e = F.col("d"), F.col("ts"), F.lit("1998-08-31").cast("date")
    days = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderdate").alias("ts"))
    return days.select(
        "o_orderkey", S.date(F.year(d), F.month(d) + 14, F.dayofmonth(d) + 30).alias("rolled"), F.year(d).alias("y"), F.month(d).alias("m"),
        F.dayofmonth(d).alias("dd"), F.hour(ts).alias("hh"), F.minute(ts).alias("mi"), F.second(ts).alias("ss"), S.eomonth(d, 1).alias("month_end"),
        S.edate(d, 3).alias("plus3"), S.datedif(d, e, "D").alias("days"), S.datedif(d, e, "M").alias("months"), S.weekday(d).alias("wd"),
        S.weeknum(d).alias("wn"), S.datevalue(d.cast("string")).alias("valued"))


@query(f"""
with o as (select o_orderkey, cast(o_orderdate as date) as d from orders), span as (select min(d) as a, max(d) + 60 as b from o),
cal as (select cast(x as date) as day from span, unnest(generate_series(a - 1, b, interval 1 day)) as t(x)),
work as (select day, isodow(day) < 6 and day not in ({_HOLIDAY_SQL}) as is_work from cal),
num as (select day, is_work, sum(cast(is_work as integer)) over (order by day) as idx from work)
select o_orderkey, cast((select max(idx) from num where day = d + 30) - (select max(idx) from num where day = d - 1) as integer) as net_days,
  (select min(day) from num where idx = (select idx from num n where n.day = d) + 10 and is_work) as after10,
  cast(date_diff('day', d, d + 200) / 365.0 as double) as frac365,
  cast(date_diff('day', d, d + 200) / 360.0 as double) as frac360
from o""")
def workday_functions(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return table(spark, folder, "orders").select(
        "o_orderkey", S.networkdays(d, F.date_add(d, 30), HOLIDAYS).alias("net_days"), S.workday(d, 10, HOLIDAYS).alias("after10"),
        S.yearfrac(d, F.date_add(d, 200), 3).alias("frac365"), S.yearfrac(d, F.date_add(d, 200), 2).alias("frac360"))
