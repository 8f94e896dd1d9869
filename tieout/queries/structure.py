"""Runs, graphs, search and the run log on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieout.operators import audit, graph, runs, search
from tieout.operators.ordered import prior_row
from tieout.operators.ordinal import with_ordinal
from tieout.operators.profile import coverage, fold_kinds, mixed_type_columns
from tieout.queries.registry import query, table

_NUMBERED = "select user_id, event_type, event_id, row_number() over (partition by user_id order by ts, event_id) as place from events"


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    from tieout.operators.ordered import row_rank

    events = table(spark, folder, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return row_rank(events, ["user_id"], ["ts", "event_id"], "place")


@query(f"""
with n as ({_NUMBERED}), g as (select *, case when place - lag(place) over w <= 3 then 0 else 1 end as starts from n window w as (partition by user_id, event_type order by place)),
r as (select *, sum(starts) over (partition by user_id, event_type order by place) as run from g)
select user_id, event_type, cast(run as bigint) as run, min(place) as anchor, max(place) as last, count(*) as cells from r group by user_id, event_type, run""")
def event_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.compress_runs(_placed(spark, folder), ["user_id"], "event_type", "place")


_CELLS = """select user_id, place, case when event_id % 11 = 0 then null else event_type end as pattern,
  case when event_id % 13 = 0 then null else cast(event_id as varchar) end as value from n"""


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(spark, folder).select(
        "user_id", "place", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("pattern"),
        F.when(F.col("event_id") % 13 != 0, F.col("event_id").cast("string")).alias("value"))


@query(f"""
with n as ({_NUMBERED}), c as ({_CELLS}),
g as (select *, lag(place) over (partition by user_id, pattern order by place) as prior from c where pattern is not null),
r as (select *, cast(sum(case when place - prior <= 3 then 0 else 1 end) over (partition by user_id, pattern order by place) as bigint) as run from g)
select r.user_id, c.place, r.pattern as expected_pattern, r.run, c.pattern as actual_pattern, c.value as actual_value
from r join c on c.user_id = r.user_id and c.place > r.prior and c.place < r.place and r.place - r.prior <= 3 where c.pattern is not null or c.value is not null""")
def run_breaks(spark: SparkSession, folder: str) -> DataFrame:
    return runs.find_breaks(_cells(spark, folder), ["user_id"], "pattern", "place", "value")


@query(f"""
with n as ({_NUMBERED}), c as (select user_id, place, case when event_id % 3 = 0 then null else 'f' end as pattern, cast(event_id as varchar) as value from n),
g as (select *, lag(place) over (partition by user_id order by place) as prior from c where pattern is not null),
r as (select *, cast(sum(case when place - prior <= 3 then 0 else 1 end) over (partition by user_id order by place) as bigint) as run from g)
select r.user_id, 'f' as expected_pattern, r.run, count(*) as typed_over from r join c on c.user_id = r.user_id and c.place > r.prior and c.place < r.place
  and r.place - r.prior <= 3 and c.pattern is null group by all having count(*) >= 3""")
def override_blocks(spark: SparkSession, folder: str) -> DataFrame:
    cells = _placed(spark, folder).select(
        "user_id", "place", F.when(F.col("event_id") % 3 != 0, F.lit("f")).alias("pattern"), F.col("event_id").cast("string").alias("value"))
    return runs.override_blocks(runs.find_breaks(cells, ["user_id"], "pattern", "place", "value"), ["user_id"])


_WINDOWS = """select l_orderkey as id, o_custkey as sheet, min(cast(l_shipdate as date) - date '1990-01-01') as min_row, max(cast(l_shipdate as date) - date '1990-01-01') as max_row,
  min(l_linenumber) as min_col, max(l_linenumber) as max_col from lineitem join orders on o_orderkey = l_orderkey group by all"""


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min(day).alias("min_row"), F.max(day).alias("max_row"), F.min("l_linenumber").alias("min_col"), F.max("l_linenumber").alias("max_col"))
    return lines.join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sheet")), "id")


@query(f"""
with w as ({_WINDOWS}) select p.id as src, c.id as dst from w p join w c on p.sheet = c.sheet and p.id <> c.id
  and p.min_row <= c.max_row and c.min_row <= p.max_row and p.min_col <= c.max_col and c.min_col <= p.max_col""")
def overlapping_shipments(spark: SparkSession, folder: str) -> DataFrame:
    windows = _windows(spark, folder)
    return graph.overlap_edges(windows, windows)


_TRADE = """select 'C' || c_custkey as src, 'N' || c_nationkey as dst from customer union select 'O' || o_orderkey, 'C' || o_custkey from orders
  union select 'N' || n_nationkey, 'R' || n_regionkey from nation union select 'S' || s_suppkey, 'N' || s_nationkey from supplier"""


def _trade_edges(spark: SparkSession, folder: str) -> DataFrame:
    def edge(name: str, a: str, source: str, b: str, target: str) -> DataFrame:
        return table(spark, folder, name).select(F.concat(F.lit(a), F.col(source)).alias("src"), F.concat(F.lit(b), F.col(target)).alias("dst"))
    return (edge("customer", "C", "c_custkey", "N", "c_nationkey").unionByName(edge("orders", "O", "o_orderkey", "C", "o_custkey"))
            .unionByName(edge("nation", "N", "n_nationkey", "R", "n_regionkey")).unionByName(edge("supplier", "S", "s_suppkey", "N", "s_nationkey")))


@query(f"""
with e as ({_TRADE}), n as (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e)
select node, cast(sum(i) as bigint) as fan_in, cast(sum(o) as bigint) as fan_out, sum(i) = 0 as is_root, sum(o) = 0 as is_leaf from n group by node""")
def trade_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph.graph_degrees(_trade_edges(spark, folder))


@query(f"""
with recursive e as ({_TRADE}), walk as (select distinct src as node, 0 as level from e where src not in (select dst from e)
  union select e.dst, w.level + 1 from walk w join e on e.src = w.node)
select node, max(level) as level from walk group by node""")
def trade_levels(spark: SparkSession, folder: str) -> DataFrame:
    return graph.topological_levels(_trade_edges(spark, folder))


@query("select event_type as node from (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as next from events) where next is not null group by 1")
def cyclic_event_types(spark: SparkSession, folder: str) -> DataFrame:
    steps = prior_row(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], {"before": "event_type"})
    return graph.cyclic_core(steps.where(F.col("before").isNotNull()).select(F.col("before").alias("src"), F.col("event_type").alias("dst")))


@query("select o_orderkey as node, cast(row_number() over (order by o_orderkey) - 1 as integer) as level from orders")
def order_chain_levels(spark: SparkSession, folder: str) -> DataFrame:
    """One chain through all orders: its levels take about as many rounds as the logarithm of its length."""
    return graph.topological_levels(_order_chain(spark, folder))


@query("select count(*) as orders, false as has_order from orders")
def order_chain_with_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """The same chain with one edge from its end to its middle has no order."""
    chain = _order_chain(spark, folder)
    # The middle is found by its number: an aggregate of all sources would hold each of them in one task.
    sources = with_ordinal(chain.select("src").dropna(), ["src"])
    middle = sources.where(F.col("ordinal") == (sources.count() + 1) // 2).agg(F.max("src").alias("dst"))
    found = graph.topological_levels(chain.unionByName(chain.agg(F.max("dst").alias("src")).crossJoin(middle)))
    return table(spark, folder, "orders").agg(F.count(F.lit(1)).alias("orders")).withColumn("has_order", F.lit(found is not None))


def _order_chain(spark: SparkSession, folder: str) -> DataFrame:
    placed = with_ordinal(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"])
    return placed.select(F.col("o_orderkey").alias("src"), (F.col("ordinal") + 1).alias("ordinal")).join(
        placed.select(F.col("o_orderkey").alias("dst"), "ordinal"), "ordinal").select("src", "dst")


@query("select o_orderkey as node from orders where o_custkey % 3 = 0")
def order_rings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders lead to their customer's next one. Of every third customer the last leads to the first again; one edge leads
    from each ring, if it is of several orders, into a chain, and from a chain into the next ring's first order."""
    orders = prior_row(table(spark, folder, "orders"), ["o_custkey"], ["o_orderkey"], {"before": "o_orderkey"})
    steps = orders.where("before is not null").select(F.col("before").alias("src"), F.col("o_orderkey").alias("dst"))
    ends = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    rings = ends.where("o_custkey % 3 = 0").select(F.col("last").alias("src"), F.col("first").alias("dst"))
    # Chains of the customer before lead into a ring, whose last order leads into chains of the customer after.
    after = ends.select((F.col("o_custkey") - 1).alias("o_custkey"), F.col("first").alias("next"))
    links = ends.join(after, "o_custkey").where("o_custkey % 3 <> 1").select(F.col("last").alias("src"), F.col("next").alias("dst"))
    return graph.cyclic_core(steps.unionByName(rings).unionByName(links))


@query("select p_partkey as node from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49) and p_size < 40")
def unread_parts(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("node"), "p_size")
    used = table(spark, folder, "lineitem").where(F.col("l_quantity") > 49).select(F.col("l_partkey").alias("src"))
    return graph.dead_nodes(parts, used, F.col("p_size") >= 40).select("node")


@query("""
with c as (select lang, source, count(*) as total, count(l.doc_id) as present from documents d left join labels l using (doc_id) group by all)
select *, present / total as coverage, case when present = 0 then 'absent' when present / total >= 0.995 then 'present' else 'partial' end as status from c""")
def label_coverage(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.lit(1).alias("labelled"))
    return coverage(table(spark, folder, "documents").join(labels, "doc_id", "left"), ["lang", "source"], F.col("labelled").isNotNull())


@query("""
with k as (select user_id, case event_id % 3 when 0 then 'date' when 1 then 'string' else 'integer' end as kind from events)
select user_id, count(*) filter (where kind = 'date') as dates, count(*) filter (where kind <> 'date') as others from k group by 1
having count(*) filter (where kind = 'date') >= 2 and count(*) filter (where kind <> 'date') >= 2""")
def mixed_columns(spark: SparkSession, folder: str) -> DataFrame:
    place = F.col("event_id") % 3
    kind = F.when(place == 0, "date").when(place == 1, "string").otherwise("integer")
    return mixed_type_columns(table(spark, folder, "events").select("user_id", kind.alias("kind")), ["user_id"])


@query("""
with k as (select user_id % 50 as col, case event_type when 'click' then 'integer' when 'view' then 'float' when 'error' then 'error' else 'empty' end as kind, event_id from events
  where user_id % 50 < 25 or event_type in ('error', 'click')),
c as (select col, count(*) filter (where kind = 'integer') as i, count(*) filter (where kind = 'float') as f, count(*) filter (where kind = 'error') as e from k group by 1)
select col, case when i + f + e = 0 then 'empty' when i + f = 0 then 'error' when f > 0 then 'float' else 'integer' end as dtype from c""")
def folded_kinds(spark: SparkSession, folder: str) -> DataFrame:
    kind = (F.when(F.col("event_type") == "click", "integer").when(F.col("event_type") == "view", "float")
            .when(F.col("event_type") == "error", "error").otherwise("empty"))
    cells = table(spark, folder, "events").select((F.col("user_id") % 50).alias("col"), kind.alias("kind"), "event_type")
    cells = cells.where((F.col("col") < 25) | F.col("event_type").isin("error", "click"))
    counted = cells.groupBy("col").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("integer", "float", "error")])
    return counted.select("col", fold_kinds({k: F.col(k) for k in ("integer", "float", "error")}).alias("dtype"))


@query("""
with s as (select doc_id, source, case when contains(lower(cast(doc_id as varchar)), 'data') or contains(lower(source), 'data') then 3 else 0 end
  + case when contains(lower(text), 'data') then 1 else 0 end
  + case when len(list_filter(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: starts_with(x, '#') and contains(lower(x), 'data'))) > 0 then 2 else 0 end as score from documents)
select doc_id, source, score from s where score > 0 order by score desc, doc_id limit 20""")
def search_docs(spark: SparkSession, folder: str) -> DataFrame:
    return search.search_documents(table(spark, folder, "documents"), "data", "doc_id", "source", "text", 20).select("doc_id", "source", "score")


@query("""
with s as (select cast(conv_id as varchar) as table_name, max(case when contains(cast(conv_id as varchar), 'user') then 3 else 0 end)
  + sum(case when contains(lower(role), 'user') then 2 when contains(lower(text), 'user') then 1 else 0 end) as score from conversations group by 1)
select table_name, cast(score as integer) as score from s where score > 0 order by score desc, table_name limit 25""")
def search_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    catalogue = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("table_name"), F.lit(None).cast("string").alias("table_description"),
        F.col("role").alias("column_name"), F.col("text").alias("column_description"))
    return search.search_tables(catalogue, " User ", 25)


@query("""select user_id, event_type, event_id, ts, value from events
  qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""")
def latest_per_step(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return audit.latest_per_step(events, ["user_id", "event_type"], "ts", ["event_id"])


@query("select user_id, event_type, min(ts) as first_seen from events group by all")
def steps_reached(spark: SparkSession, folder: str) -> DataFrame:
    return audit.steps_reached(table(spark, folder, "events"), "event_type", "ts", ["user_id"])


@query("""
select * from (select 'event' as kind, cast(event_id as varchar) as what, ts as at from events union all
  select 'order', cast(o_orderkey as varchar), o_orderdate from orders)""")
def audit_trail(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("what"), F.col("ts").alias("at"))
    orders = table(spark, folder, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("what"), F.col("o_orderdate").alias("at"))
    return audit.audit_trail(events, orders)


@query("select c_custkey as step, c_custkey in (select o_custkey from orders where o_orderstatus = 'P') as completed from customer")
def steps_completed(spark: SparkSession, folder: str) -> DataFrame:
    steps = table(spark, folder, "customer").select(F.col("c_custkey").alias("step"))
    pending = table(spark, folder, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("step"))
    return audit.steps_completed(steps, pending)
