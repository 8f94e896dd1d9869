"""Verification and tie-out on the given tables, with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieout.functions.numeric import round_half_away
from tieout.operators import acceptance
from tieout.operators.compare import Region, baseline_status, comparison_counts, paired_cells, reconcile_many
from tieout.operators.verify import Verification, verify
from tieout.plans import signoff
from tieout.queries.deliveries import scratch
from tieout.queries.registry import query, rounded, table

_NET = rounded("cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as double)")
_SIDES = f"""
with predicted as (select l_orderkey, {_NET} as net, count(*) as lines from lineitem group by 1),
actual as (select l_orderkey, case when l_orderkey % 101 = 0 then null when l_orderkey % 97 = 0 then net + 0.01 else net end as net, lines from predicted where l_orderkey % 103 <> 0
  union all select -l_orderkey, net, lines from predicted where l_orderkey % 499 = 0 and l_orderkey > 0),
j as (select coalesce(p.l_orderkey, a.l_orderkey) as l_orderkey, p.net as pn, a.net as an, p.lines as pl, a.lines as al,
  p.l_orderkey is not null as here, a.l_orderkey is not null as there from predicted p full join actual a on p.l_orderkey = a.l_orderkey)"""


def predicted_net(spark: SparkSession, folder: str) -> DataFrame:
    """Net amount per order, rounded as a sheet rounds it."""
    amount = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        round_half_away(F.sum(amount).cast("double"), 2).alias("net"), F.count(F.lit(1)).alias("lines"))


def delivered_net(predicted: DataFrame) -> DataFrame:
    """What came back: pennies off, empty amounts, rows gone and rows nobody predicted."""
    key = F.col("l_orderkey")
    net = F.when(key % 101 == 0, F.lit(None)).when(key % 97 == 0, F.col("net") + 0.01).otherwise(F.col("net"))
    kept = predicted.where(key % 103 != 0).withColumn("net", net)
    extra = predicted.where((key % 499 == 0) & (key > 0)).withColumn("l_orderkey", -key)
    return kept.unionByName(extra)


def _verified(spark: SparkSession, folder: str) -> Verification:
    predicted = predicted_net(spark, folder)
    return verify(predicted, delivered_net(predicted), ["l_orderkey"])


@query(f"""{_SIDES}
select l_orderkey, 'net' as column, pn as predicted, an as actual, round(an - pn, 6) as delta from j
where here and there and (an is null or abs(an - pn) > 1e-6)""")
def verify_net_amounts(spark: SparkSession, folder: str) -> DataFrame:
    return _verified(spark, folder).breaks.select(
        "l_orderkey", "column", F.col("predicted").cast("double").alias("predicted"), F.col("actual").cast("double").alias("actual"),
        F.round("delta", 6).alias("delta"))


@query(f"""{_SIDES}
select 'failed' as status, count(*) filter (where here) as rows_predicted, count(*) filter (where there) as rows_actual,
  count(*) filter (where here and there and an is not null and abs(an - pn) <= 1e-6) as matched,
  count(*) filter (where here and there and (an is null or abs(an - pn) > 1e-6)) as breaks,
  count(*) filter (where here and not there) as missing, count(*) filter (where there and not here) as unexpected from j""")
def verify_summary(spark: SparkSession, folder: str) -> DataFrame:
    v = _verified(spark, folder)
    row = (v.status.value, v.rows_predicted, v.rows_actual, v.matched, v.break_count, v.missing_count, v.unexpected_count)
    return spark.createDataFrame([row], "status string, rows_predicted bigint, rows_actual bigint, matched bigint, breaks bigint, missing bigint, unexpected bigint")


@query(f"""{_SIDES}
select l_orderkey, 'missing' as problem from j where here and not there union all select l_orderkey, 'unexpected' from j where there and not here""")
def verify_keys(spark: SparkSession, folder: str) -> DataFrame:
    v = _verified(spark, folder)
    return v.missing.withColumn("problem", F.lit("missing")).unionByName(v.unexpected.withColumn("problem", F.lit("unexpected")))


@query("select 'not_reconciled' as status, count(*) - count(distinct (l_orderkey, l_linenumber)) as repeated from lineitem")
def verify_refuses_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that repeat make a row-wise comparison meaningless, so none is made."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    v = verify(lines, lines, ["l_orderkey", "l_linenumber"])
    repeated = int(v.reason.split("repeats ")[1].split(" ")[0].replace(",", ""))
    return spark.createDataFrame([(v.status.value, repeated)], "status string, repeated bigint")


_ORDERED = """
with e as (select row_number() over (order by o_orderdate, o_orderkey) as row, case when o_orderkey % 211 = 0 then null else o_totalprice end as want from orders),
a as (select row_number() over (order by o_orderdate, o_orderkey) as row, case when o_orderkey % 101 = 0 then null when o_orderkey % 97 = 0 then o_totalprice + 0.01 else o_totalprice end as got
  from (select * from orders union all select o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate + interval 3650 day, o_orderpriority from orders where o_orderkey % 1000 = 1)),
j as (select coalesce(e.row, a.row) as row, want, got, e.row is not null as here, a.row is not null as there from e full join a on e.row = a.row),
k as (select *, case when here and want is null then null when here and not there then 'missing_row' when not here then 'extra_row' when got is null then 'actual_null'
  when abs(got - want) > 1e-6 then 'value_differs' end as kind from j)"""


def _positional(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders, key = table(spark, folder, "orders"), F.col("o_orderkey")
    expected = orders.select("o_orderdate", "o_orderkey", F.when(key % 211 != 0, F.col("o_totalprice")).alias("want"))
    got = F.when(key % 101 == 0, F.lit(None)).when(key % 97 == 0, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice"))
    got = got.alias("got")
    late = orders.where(key % 1000 == 1).withColumns({
        "o_orderkey": key + 1000000000, "o_orderdate": F.col("o_orderdate") + F.expr("interval 3650 days")})
    actual = orders.unionByName(late).select("o_orderdate", "o_orderkey", got)
    return expected, actual


@query(f"{_ORDERED} select row, kind, want, got, round(abs(got - want), 6) as delta from k where kind is not null")
def compare_ordered(spark: SparkSession, folder: str) -> DataFrame:
    expected, actual = _positional(spark, folder)
    cells = paired_cells(expected, actual, "want", "got", order=["o_orderdate", "o_orderkey"])
    return cells.where(F.col("kind").isNotNull()).select(
        "row", "kind", F.col("expected_number").alias("want"), F.col("actual_number").alias("got"), F.round("absolute_delta", 6).alias("delta"))


@query(f"""{_ORDERED}
select 'failed' as status, count(*) filter (where here) as rows_expected, count(*) filter (where there) as rows_actual, count(*) filter (where here and there and want is not null) as rows_compared,
  count(*) filter (where here and there and want is not null and kind is null) as rows_matched, count(kind) as rows_differing,
  count(*) filter (where here and want is null) as rows_missing_baseline, round(max(abs(got - want)), 6) as worst from k""")
def compare_counts(spark: SparkSession, folder: str) -> DataFrame:
    expected, actual = _positional(spark, folder)
    counts = comparison_counts(paired_cells(expected, actual, "want", "got", order=["o_orderdate", "o_orderkey"]))
    return counts.select("status", "rows_expected", "rows_actual", "rows_compared", "rows_matched", "rows_differing", "rows_missing_baseline",
                         F.round("worst_absolute_delta", 6).alias("worst"))


def _regions(spark: SparkSession, folder: str) -> list[Region]:
    orders, key, price = table(spark, folder, "orders"), F.col("o_orderkey"), F.col("o_totalprice")
    made = orders.select(
        (key + 1).alias("place"), price.alias("same"), round_half_away(price / 7, 2).alias("rounded"), (price / 7).alias("unrounded"),
        F.when(key % 5 != 0, price).alias("holes"), F.lit(None).cast("double").alias("nothing"), F.col("o_orderdate").cast("date").alias("day"),
        F.date_add(F.col("o_orderdate").cast("date"), 1).alias("next_day"), price.cast("string").alias("texts"))
    def region(name: str, want: str, got: str) -> Region:
        return Region(name, made, want, got, actual=made, ordinal="place")
    return [region("same", "same", "same"), region("unrounded", "rounded", "unrounded"), region("partial", "holes", "same"),
            region("nulls", "same", "holes"), region("absent", "nothing", "same"), region("dates", "day", "next_day"), region("texts", "same", "texts"),
            Region("gone", None, "x", "same", actual=made, ordinal="place"), Region("elsewhere", made, "same", "not_there", actual=made, ordinal="place")]


@query("""
with o as (select o_orderkey % 5 = 0 as hole, floor(o_totalprice / 7 * 100.0 + least(o_totalprice / 7 * 100.0 * 1e-15, 1e-3) + 0.5) / 100.0 as r, o_totalprice / 7 as u from orders),
n as (select count(*) as n, count(*) filter (where hole) as h, count(*) filter (where abs(r - u) > 1e-6) as un from o)
select 'same' as region, 'passed' as status, null as reason, n as rows_compared, 0 as rows_differing, 0 as rows_missing_baseline from n union all
select 'unrounded', 'failed', null, n, un, 0 from n union all
select 'partial', 'not_reconciled', 'partial_cached_values', n - h, 0, h from n union all
select 'nulls', 'failed', null, n, h, 0 from n union all
select 'absent', 'not_reconciled', 'no_cached_values', 0, 0, n from n union all
select 'dates', 'failed', null, n, n, 0 from n union all
select 'texts', 'failed', null, n, n, 0 from n union all
select 'gone', 'not_reconciled', 'baseline_range_unreadable', 0, 0, 0 union all
select 'elsewhere', 'not_reconciled', 'no_actual_values', 0, 0, 0""")
def reconcile_regions(spark: SparkSession, folder: str) -> DataFrame:
    report = reconcile_many(_regions(spark, folder), explain=False)
    return report.to_frame(spark).select("region", "status", "reason", "rows_compared", "rows_differing", "rows_missing_baseline")


@query("""
with o as (select o_orderkey % 5 = 0 as hole, floor(o_totalprice / 7 * 100.0 + least(o_totalprice / 7 * 100.0 * 1e-15, 1e-3) + 0.5) / 100.0 as r, o_totalprice / 7 as u from orders),
n as (select count(*) as n, count(*) filter (where hole) as h, count(*) filter (where abs(r - u) > 1e-6) as un from o)
select 'unrounded' as region, 'rounding_not_applied' as cause, 0.9 as confidence, un as affected_rows from n union all
select 'nulls', 'null_vs_empty', round(0.5 + h / n, 6), h from n union all select 'dates', 'date_serial_offset', 0.85, n from n union all
select 'texts', 'text_formatted_number', 0.85, n from n union all select 'texts', 'date_serial_offset', 0.8, n from n""")
def likely_causes(spark: SparkSession, folder: str) -> DataFrame:
    """What the differences of each region look like: missing rounding, empty cells, dates off by a day, text numbers."""
    report = reconcile_many(_regions(spark, folder))
    rows = [(r.id, d.cause, round(d.confidence, 6), d.affected_rows) for r in report.regions for d in r.diagnoses]
    return spark.createDataFrame(rows, "region string, cause string, confidence double, affected_rows bigint")


@query("""
select 'same' as name, case when count(*) = count(o_totalprice) then 'present' end as status from orders union all
select 'holes', 'partial' union all select 'nothing', 'absent' union all select 'missing', 'unreadable'""")
def baseline_states(spark: SparkSession, folder: str) -> DataFrame:
    frame = _regions(spark, folder)[0].expected
    return spark.createDataFrame([(n, baseline_status(frame, n)) for n in ("same", "holes", "nothing", "missing")], "name string, status string")


_PLAN = signoff.Adjustment("o_orderkey", "o_totalprice", {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, {"o_orderstatus": "P"}, 0.045,
                           carry=("o_custkey",), note="Uplift for {}", note_column="o_custkey")
_ADJUSTED = f"""select o_orderkey, o_custkey, coalesce(p, 0) as before, {rounded('coalesce(p, 0) * 0.045')} as uplift, {rounded('coalesce(p, 0) * 1.045')} as after,
  'Uplift for ' || o_custkey as note from (select *, case when o_orderkey % 503 = 0 then null else o_totalprice end as p from orders)
  where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus <> 'P'"""


def _adjusted(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 503 != 0, F.col("o_totalprice")))
    return signoff.adjust(orders, _PLAN)


@query(f"""select *, 'UPDATE orders SET o_totalprice = ' || cast(after as varchar) || ' WHERE o_orderkey = ' || o_orderkey as statement from ({_ADJUSTED})""")
def adjustment(spark: SparkSession, folder: str) -> DataFrame:
    return signoff.with_statements(_adjusted(spark, folder), "UPDATE orders SET o_totalprice = {after} WHERE o_orderkey = {o_orderkey}")


@query(f"""
with a as ({_ADJUSTED}), t as (select count(*) as rows, cast(sum(cast(before as decimal(18,4))) as double) as before,
  cast(sum(cast(uplift as decimal(18,4))) as double) as uplift, cast(sum(cast(after as decimal(18,4))) as double) as after from a)
select rows, round(before, 1) as before, round(uplift, 1) as uplift, round(after, 1) as after from t""")
def adjustment_totals(spark: SparkSession, folder: str) -> DataFrame:
    totals = signoff.totals(_adjusted(spark, folder))
    return totals.select("rows", *[F.round(c, 1).alias(c) for c in ("before", "uplift", "after")])


@query(f"""select o_orderkey, 'o_totalprice' as column, after as predicted, case when o_orderkey % 1001 = 0 then before else after end as actual
  from ({_ADJUSTED}) where o_orderkey % 1001 = 0 and abs(after - before) > 1e-6""")
def adjustment_verified(spark: SparkSession, folder: str) -> DataFrame:
    """Some rows came back unchanged: each is a break."""
    adjusted = _adjusted(spark, folder)
    key = F.col("o_orderkey")
    done = adjusted.select("o_orderkey", F.when(key % 1001 == 0, F.col("before")).otherwise(F.col("after")).alias("applied"))
    returned = table(spark, folder, "orders").join(done, "o_orderkey", "left").withColumn("o_totalprice", F.coalesce("applied", "o_totalprice"))
    v = signoff.verify_adjustment(adjusted, returned, _PLAN)
    return v.breaks.select("o_orderkey", "column", F.col("predicted").cast("double").alias("predicted"), F.col("actual").cast("double").alias("actual"))


@query("""select * from (values ('first', 'passed', true, true), ('same', 'passed', true, true), ('other', 'not_reconciled', false, true)) as t(run, status, compared, accepted)
  where (select count(*) from orders) > 0""")
def accept_then_cite(spark: SparkSession, folder: str) -> DataFrame:
    """Compared on the first delivery and again on the same one; on another delivery the acceptance is only cited."""
    path, same = scratch(spark, "acceptance"), _regions(spark, folder)[:1]
    rows = []
    for run, digest in (("first", "a"), ("same", "a"), ("other", "b")):
        check = acceptance.check_or_cite(spark, path, "orders", digest, lambda: reconcile_many(same))
        rows.append((run, check.status.value, check.live is not None, check.translation_accepted))
    return spark.createDataFrame(rows, "run string, status string, compared boolean, accepted boolean")
