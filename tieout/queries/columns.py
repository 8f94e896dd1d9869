"""Column functions on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieout import functions as X
from tieout.functions import text as texts
from tieout.queries.registry import query, rounded, table

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NET = "l_extendedprice * (1 - l_discount)"


def _net():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query(f"""
select {LINE}, {rounded(NET)} as net, {rounded(NET, 0)} as whole,
  ceil(abs({NET}) * 10.0 - least(abs({NET}) * 10.0 * 1e-15, 1e-3)) / 10.0 as net_up,
  floor(abs({NET}) * 10.0 + least(abs({NET}) * 10.0 * 1e-15, 1e-3)) / 10.0 as net_down,
  floor(abs({NET}) / 100.0 + least(abs({NET}) / 100.0 * 1e-15, 1e-3) + 0.5) * 100.0 as hundreds,
  {rounded(f'({NET}) / 1000.0', 1)} as thousands
from lineitem""")
def round_net(spark: SparkSession, folder: str) -> DataFrame:
    net = _net()
    return table(spark, folder, "lineitem").select(
        *LINE_KEYS, X.round_half_away(net, 2).alias("net"), X.round_half_away(net).alias("whole"),
        X.round_up(net, 1).alias("net_up"), X.round_down(net, 1).alias("net_down"),
        X.round_half_away(net, -2).alias("hundreds"), X.to_thousands(net, 1).alias("thousands"))


_A, _B = "nullif(l_discount, 0.05)", "nullif(l_tax, 0.0)"


@query(f"""
select {LINE}, coalesce({_A}, 0) + coalesce({_B}, 0) as plus, coalesce({_A}, 0) - coalesce({_B}, 0) as minus,
  coalesce({_A}, 0) * coalesce({_B}, 0) as times, coalesce({_A}, 0) + coalesce({_B}, 0) + l_quantity as across
from lineitem""")
def empty_cells(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.nullif(F.col("l_discount"), F.lit(0.05)), F.nullif(F.col("l_tax"), F.lit(0.0))
    return table(spark, folder, "lineitem").select(
        *LINE_KEYS, X.add(a, b).alias("plus"), X.sub(a, b).alias("minus"), X.mul(a, b).alias("times"),
        X.sum_horizontal(a, b, "l_quantity").alias("across"))


@query(f"""
select {LINE}, case when l_tax = 0 then null else l_extendedprice / l_tax end as over_tax,
  coalesce({_A}, 0) / nullif(l_quantity - 10, 0) as over_quantity
from lineitem""")
def safe_unit_price(spark: SparkSession, folder: str) -> DataFrame:
    gap = F.nullif(F.col("l_discount"), F.lit(0.05))
    return table(spark, folder, "lineitem").select(
        *LINE_KEYS, X.div(F.col("l_extendedprice"), F.col("l_tax")).alias("over_tax"),
        X.div(gap, F.col("l_quantity") - 10).alias("over_quantity"))


_SHOWN = """case l_linenumber % 7
  when 0 then '$' || format('{:,.2f}', l_extendedprice) when 1 then '(' || format('{:,.2f}', l_extendedprice) || ')'
  when 2 then format('{:.2f}', l_extendedprice) || '%' when 3 then chr(160) || format('{:.2f}', l_extendedprice) || ' '
  when 4 then format('{:.2f}', l_extendedprice) || 'd' when 5 then format('{:,.2f}', l_extendedprice) || ')'
  else 'n/a' end"""


@query(f"""
with shown as (select {LINE}, {_SHOWN} as amount_text from lineitem),
cut as (select *, trim(replace(amount_text, chr(160), ' ')) as t from shown),
body as (select *, t like '(%)' as negative, t like '%\\%' escape '\\' as percent,
  regexp_replace(regexp_replace(t, '^\\(|\\)$', case when t like '(%)' then '' else '!' end, 'g'), '[, $%]', '', 'g') as b from cut)
select {LINE}, amount_text,
  case when regexp_full_match(b, '[0-9]+\\.[0-9]+') then
    (case when percent then try_cast(b as double) / 100.0 else try_cast(b as double) end) * (case when negative then -1 else 1 end) end as amount
from body""")
def text_amount(spark: SparkSession, folder: str) -> DataFrame:
    price, kind = F.col("l_extendedprice"), F.col("l_linenumber") % 7
    grouped, plain = F.format_number(price, 2), F.format_string("%.2f", price)
    shown = (F.when(kind == 0, F.concat(F.lit("$"), grouped)).when(kind == 1, F.concat(F.lit("("), grouped, F.lit(")")))
             .when(kind == 2, F.concat(plain, F.lit("%"))).when(kind == 3, F.concat(F.lit("\u00a0"), plain, F.lit(" ")))
             .when(kind == 4, F.concat(plain, F.lit("d"))).when(kind == 5, F.concat(grouped, F.lit(")"))).otherwise("n/a"))
    return table(spark, folder, "lineitem").select(*LINE_KEYS, shown.alias("amount_text")).withColumn(
        "amount", X.to_number(F.col("amount_text")))


@query("""
with v as (select event_id, case event_id % 5 when 0 then null when 1 then '#DIV/0!' when 2 then 'n/a'
    else cast(event_id as varchar) end as cell,
  case event_id % 4 when 0 then cast('nan' as double) when 1 then cast('inf' as double) else value end as number from events)
select event_id, try_cast(cell as double) is null as cell_bad, case when cell = '#DIV/0!' then null else cell end as cleaned,
  event_id % 4 in (0, 1) or number is null as number_bad,
  case when event_id % 4 in (0, 1) or number is null then -1.0 else number end as number_or,
  case when try_cast(cell as double) is null then 'error' else cell end as cell_or
from v""")
def error_values(spark: SparkSession, folder: str) -> DataFrame:
    cell = (F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, "#DIV/0!")
            .when(F.col("event_id") % 5 == 2, "n/a").otherwise(F.col("event_id").cast("string")))
    number = (F.when(F.col("event_id") % 4 == 0, float("nan")).when(F.col("event_id") % 4 == 1, float("inf"))
              .otherwise(F.col("value")))
    made = table(spark, folder, "events").select("event_id", cell.alias("cell"), number.alias("number"))
    return made.select(
        "event_id", X.is_error(F.col("cell")).alias("cell_bad"), X.error_text_to_null(F.col("cell")).alias("cleaned"),
        X.is_error(F.col("number")).alias("number_bad"), X.iferror(F.col("number"), -1.0).alias("number_or"),
        X.iferror(F.col("cell"), "error").alias("cell_or"))


@query("""
with x as (select c_custkey, c_acctbal, case c_custkey % 3 when 0 then c_acctbal / 8 when 1 then c_acctbal * 1000 else c_acctbal * 1e-9 end as v from customer),
s as (select *, format('{:.15g}', v) as t from x)
select c_custkey, cast(case when t like '%e%' then null when t like '%.%' then length(t) - position('.' in t) else 0 end as integer) as decimals,
  cast(round_even(abs(c_acctbal) * 100, 0) % 10 as integer) as last_cent
from s""")
def shown_digits(spark: SparkSession, folder: str) -> DataFrame:
    kind, balance = F.col("c_custkey") % 3, F.col("c_acctbal")
    value = F.when(kind == 0, balance / 8).when(kind == 1, balance * 1000).otherwise(balance * 1e-9)
    return table(spark, folder, "customer").select(
        "c_custkey", X.decimals_retained(value).alias("decimals"), X.last_digit(balance, 2).alias("last_cent"))


@query("""
with v as (select o_orderkey, o_totalprice as e, case when o_orderkey % 101 = 0 then null
    when o_orderkey % 97 = 0 then o_totalprice + 0.01 when o_orderkey % 89 = 0 then o_totalprice * 1.0001 else o_totalprice end as a,
  o_orderdate as d, o_orderdate + to_hours(cast(o_orderkey % 49 as integer)) as d2 from orders)
select o_orderkey, a is not null and abs(a - e) <= 1e-6 as exact, a is not null and (abs(a - e) <= 1e-6 or abs(a - e) <= abs(e) * 0.00011) as close,
  round(a - e, 4) as delta, (epoch_us(d2) - epoch_us(d)) / 86400000000.0 as days
from v""")
def tolerance_and_delta(spark: SparkSession, folder: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    actual = F.when(key % 101 == 0, F.lit(None)).when(key % 97 == 0, price + 0.01).when(key % 89 == 0, price * 1.0001).otherwise(price)
    zero = F.lit(0)
    moved = F.col("o_orderdate") + F.make_dt_interval(zero, (key % 49).cast("int"), zero, F.lit(0).cast("decimal(18,6)"))
    made = table(spark, folder, "orders").select("o_orderkey", price.alias("e"), actual.alias("a"), F.col("o_orderdate").alias("d"), moved.alias("d2"))
    e, a = F.col("e"), F.col("a")
    kinds = {f.name: f.dataType for f in made.schema.fields}
    return made.select(
        "o_orderkey", X.within_tolerance(e, a).alias("exact"), X.within_tolerance(e, a, relative=0.00011).alias("close"),
        F.round(X.signed_delta(e, a, kinds["e"], kinds["a"]), 4).alias("delta"),
        X.signed_delta(F.col("d"), F.col("d2"), kinds["d"], kinds["d2"]).alias("days"))


@query(f"""
select {LINE}, cast(l_shipdate as date) - date '1899-12-30' as serial, cast(l_shipdate as date) as ship_day,
  l_shipdate + interval 18 hour as ship_evening
from lineitem""")
def serial_shipdate(spark: SparkSession, folder: str) -> DataFrame:
    serial = X.date_to_serial(F.col("l_shipdate"))
    return table(spark, folder, "lineitem").select(*LINE_KEYS, serial.alias("serial")).withColumns({
        "ship_day": X.serial_to_date(F.col("serial")), "ship_evening": X.serial_to_datetime(F.col("serial") + 0.75)})


@query("""
select cast(p_partkey as bigint) as serial,
  case when p_partkey in (0, 60) then null when p_partkey < 60 then date '1899-12-31' + cast(p_partkey as integer)
       else date '1899-12-30' + cast(p_partkey as integer) end as day,
  case when p_partkey in (0, 60) then null else p_partkey end as back
from part""")
def early_serials(spark: SparkSession, folder: str) -> DataFrame:
    day = X.serial_to_date(F.col("p_partkey"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("serial"), day.alias("day"), X.date_to_serial(day).alias("back"))


_CELLS = """
select 'balance' as origin, cast(c_acctbal as varchar) as cell from customer union all
select 'priority', o_orderpriority from orders union all
select 'day', strftime(o_orderdate, '%Y-%m-%d') from orders union all
select 'slash', strftime(o_orderdate, '%d/%m/%Y') from orders union all
select 'dotted', strftime(o_orderdate, '%d.%m.%Y') from orders union all
select 'named', strftime(o_orderdate, '%d %b %Y') from orders union all
select 'month', strftime(o_orderdate, '%b %d, %Y') from orders union all
select 'money', '£' || format('{:,.2f}', o_totalprice) from orders union all
select 'text', text from documents"""


@query(f"""
with cells as ({_CELLS})
select origin, count(*) as cells,
  count(*) filter (where regexp_full_match(regexp_replace(cell, '[,\\s_$£€%()\\x{{00a0}}]', '', 'g'), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) as numbers,
  count(*) filter (where regexp_full_match(cell, '\\s*[-+(]?\\s*[£$€]?\\s*[0-9]{{1,3}}(,[0-9]{{3}})*(\\.[0-9]+)?\\s*\\)?\\s*%?\\s*')
    or regexp_full_match(cell, '\\s*[-+(]?\\s*[£$€]?\\s*[0-9]*\\.?[0-9]+([eE][-+]?[0-9]+)?\\s*\\)?\\s*%?\\s*')) as shaped,
  count(*) filter (where regexp_full_match(cell, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}')) as iso,
  count(*) filter (where regexp_full_match(cell, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}')) as slash,
  count(*) filter (where regexp_full_match(cell, '[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{2,4}}')) as dotted,
  count(*) filter (where regexp_full_match(cell, '(?i)[0-9]{{1,2}}[- ][a-z]{{3,9}}[- ][0-9]{{2,4}}')) as named,
  count(*) filter (where regexp_full_match(cell, '(?i)[a-z]{{3,9}}\\s+[0-9]{{1,2}},?\\s+[0-9]{{4}}')) as month_first,
  count(*) filter (where upper(trim(cell)) = '#N/A') as errors
from cells group by origin""")
def text_shapes(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    day = F.col("o_orderdate")
    parts = [
        table(spark, folder, "customer").select(F.lit("balance").alias("origin"), F.col("c_acctbal").cast("string").alias("cell")),
        orders.select(F.explode(F.array(*[F.struct(F.lit(n).alias("origin"), c.alias("cell")) for n, c in [
            ("priority", F.col("o_orderpriority")), ("day", F.date_format(day, "yyyy-MM-dd")),
            ("slash", F.date_format(day, "dd/MM/yyyy")), ("dotted", F.date_format(day, "dd.MM.yyyy")),
            ("named", F.date_format(day, "dd MMM yyyy")), ("month", F.date_format(day, "MMM dd, yyyy")),
            ("money", F.concat(F.lit("£"), F.format_number("o_totalprice", 2)))]])).alias("x")).select("x.*"),
        table(spark, folder, "documents").select(F.lit("text").alias("origin"), F.col("text").alias("cell")),
    ]
    cells = parts[0].unionByName(parts[1]).unionByName(parts[2])
    cell, layout = F.col("cell"), F.col("layout")
    seen = cells.withColumn("layout", X.date_text_layout(cell))
    count = lambda name: F.count_if(layout == name)
    return seen.groupBy("origin").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(X.looks_numeric(cell)).alias("numbers"),
        F.count_if(X.numeric_text_shape(cell)).alias("shaped"), count("iso").alias("iso"), count("slash").alias("slash"),
        count("dotted").alias("dotted"), count("named-month").alias("named"), count("month-first").alias("month_first"),
        F.count_if(X.value_kind(cell, cells.schema["cell"].dataType) == "error").alias("errors"))


@query("""
select c_custkey, 'sha256:' || substr(sha256(c_name), 1, 12) as name_hash,
  'sha256:' || coalesce(substr(sha256(nullif(c_mktsegment, 'BUILDING')), 1, 8), 'null') as segment_hash,
  'Balance of ' || c_name || ' in ' || c_mktsegment as note from customer""")
def hash_names(spark: SparkSession, folder: str) -> DataFrame:
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return table(spark, folder, "customer").select(
        "c_custkey", X.hash_value(F.col("c_name")).alias("name_hash"), X.hash_value(segment, 8).alias("segment_hash"),
        X.note_text("Balance of {} in {}", F.col("c_name"), F.col("c_mktsegment")).alias("note"))


# Texts without anything that could be taken for a credential, so that what is planted around them is all there is.
_PLAIN = """regexp_replace(text, '[=:;@''"{}]|[Bb][Ee][Aa][Rr][Ee][Rr]|[Bb][Aa][Ss][Ii][Cc]', ' ', 'g')"""


@query(f"""
with plain as (select doc_id, {_PLAIN} as body from documents)
select doc_id, 'Host=h1;Password=***REDACTED***;Port=5' as value,
  sha256(body || ' Access_Token=***REDACTED***') as ending_hash,
  sha256('see Bearer ***REDACTED*** ' || body) as bearer_hash,
  sha256(body || ' https://***REDACTED***@host/x') as url_hash,
  sha256(body || body) as free_hash from plain""")
def mask_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Credentials planted in, before and behind every whole text."""
    lit, col = F.lit, F.col
    plain = table(spark, folder, "documents").select("doc_id", F.regexp_replace(
        "text", "[=:;@'\"{}]|[Bb][Ee][Aa][Rr][Ee][Rr]|[Bb][Aa][Ss][Ii][Cc]", " ").alias("body"))
    masked = lambda *parts: X.mask_secrets(F.concat(*parts))
    number, body = col("doc_id").cast("string"), col("body")
    return plain.select(
        "doc_id", masked(lit("Host=h1;Password="), body, lit(";Port=5")).alias("value"),
        F.sha2(masked(body, lit(" Access_Token = abc"), number, lit("&x")), 256).alias("ending_hash"),
        F.sha2(masked(lit("see Bearer abcdefgh"), number, lit(" "), body), 256).alias("bearer_hash"),
        F.sha2(masked(body, lit(" https://me:pw"), number, lit("@host/x")), 256).alias("url_hash"),
        F.sha2(masked(body, body), 256).alias("free_hash"))


@query("""
select 'UPDATE orders SET price = ' || cast(o_totalprice as varchar) || ', day = TIMESTAMP ''' ||
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ''', note = ' || case when o_orderstatus = 'F' then 'NULL' else
  '''it''''s ' || o_orderpriority || '''' end || ' WHERE id = ' || cast(o_orderkey as varchar) as statement from orders""")
def adjustment_statements(spark: SparkSession, folder: str) -> DataFrame:
    note = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("it's "), F.col("o_orderpriority")))
    orders = table(spark, folder, "orders").withColumn("note", note)
    template = "UPDATE orders SET price = {o_totalprice}, day = {o_orderdate}, note = {note} WHERE id = {o_orderkey}"
    return X.render_statements(orders, template, limit=None)
