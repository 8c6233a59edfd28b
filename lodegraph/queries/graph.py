"""Queries of the pattern language, views, natives and standing queries on the trade and event graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import natives
from lodegraph.lgql import match, standing
from lodegraph.log import View, advance, update_ids
from lodegraph.plans.trade import STEP, event_history, graph, history
from lodegraph.schema import as_log
from lodegraph.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def pattern(name: str, text: str, columns: dict[str, str], sql: str) -> None:
    """A query that gives some columns of a pattern's matches, values as bigint where they are keys."""

    @add(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        m = match(graph(spark, d), text)
        return m.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def key(c: str) -> str:
    return f"cast({c} as bigint)"


pattern("customer_orders", 'n(type="customer", mktsegment="BUILDING")->e(type="placed")->n(type="order")', {"custkey": key("n1_value"), "orderkey": key("n3_value")},
        "select c_custkey as custkey, o_orderkey as orderkey from customer join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
pattern("node_type_scan", 'n(type="part")', {"partkey": key("n1_value")}, "select distinct p_partkey as partkey from part")
pattern("node_point", 'n(type="nation", value="7")', {"nationkey": key("n1_value")}, "select cast(n_nationkey as bigint) as nationkey from nation where n_nationkey = 7")
pattern("prop_eq", 'n(type="part", size=10)', {"partkey": key("n1_value")}, "select p_partkey as partkey from part where p_size = 10")
pattern("prop_in", 'n(type="customer", mktsegment=["BUILDING","MACHINERY"])', {"custkey": key("n1_value")}, "select c_custkey as custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
pattern("prop_range", 'n(type="part", retailprice>=910, retailprice<930.5)', {"partkey": key("n1_value")}, "select p_partkey as partkey from part where p_retailprice >= 910 and p_retailprice < 930.5")
pattern("prop_regex", 'n(type="part", ptype~/^(large|s.a)/i)', {"partkey": key("n1_value")}, "select p_partkey as partkey from part where regexp_matches(lower(p_type), '^(large|s.a)')")
pattern("prop_not_regex", 'n(type="part", ptype!~/T/)', {"partkey": key("n1_value")}, "select p_partkey as partkey from part where not contains(p_type, 'T')")
# Regions, nations and suppliers have no mktsegment: an unresolved key fails the negation too.
pattern("prop_not", 'n(mktsegment!="BUILDING")', {"custkey": key("n1_value")}, "select c_custkey as custkey from customer where c_mktsegment <> 'BUILDING'")
pattern("prop_type", 'n(type=["customer","part"], acctbal:number, name!:number)', {"custkey": key("n1_value")}, "select c_custkey as custkey from customer where c_acctbal is not null and c_name is not null")
pattern("prop_exists", 'n(orderpriority)', {"orderkey": key("n1_value")}, "select o_orderkey as orderkey from orders where o_orderpriority is not null")
pattern("two_hop", 'n(type="nation", name)->n(type="region", value="1")', {"nationkey": key("n1_value"), "regionkey": key("n2_value")}, "select cast(n_nationkey as bigint) as nationkey, cast(n_regionkey as bigint) as regionkey from nation where n_regionkey = 1")
pattern("reverse_hop", 'n(type="order", orderpriority="1-URGENT")<-e(type="placed")<-n(type="customer")', {"orderkey": key("n1_value"), "custkey": key("n3_value")},
        "select o_orderkey as orderkey, c_custkey as custkey from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT'")
pattern("undirected_hop", 'n(type=["nation","region"])-n(type=["nation","region"])', {"a": "concat(n1_type, n1_value)", "b": "concat(n2_type, n2_value)"},
        "select 'nation' || n_nationkey as a, 'region' || n_regionkey as b from nation union all select 'region' || n_regionkey, 'nation' || n_nationkey from nation")
pattern("chain5", 'n(type="customer", acctbal>9000)->e(type="in")->n(type="nation")->e(type="in")->n(type="region")', {"custkey": key("n1_value"), "nationkey": key("n3_value"), "regionkey": key("n5_value")},
        "select c_custkey as custkey, cast(n_nationkey as bigint) as nationkey, cast(n_regionkey as bigint) as regionkey from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9000")
pattern("uniq_slots", 'n(type="supplier")-@n(type="nation")-n(type="supplier")', {"a": key("n1_value"), "b": key("n2_value")},
        "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey where a.s_suppkey <> b.s_suppkey")
pattern("nonuniq_slots", 'n(type="supplier")->N(type="nation")<-@E(type="in")-N(type="supplier")', {"a": key("n1_value"), "b": key("n3_value")},
        "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey")
pattern("omit_bag", 'n(type="part", size=1)<-@e(type="contains")<-@n(type="order")', {"partkey": key("n1_value")},
        "select p_partkey as partkey from part join lineitem on l_partkey = p_partkey join orders on l_orderkey = o_orderkey where p_size = 1")
pattern("edge_filter_src", '@n(type="order")->e(type="contains", src.orderpriority="1-URGENT", quantity>45)->n(type="part")', {"partkey": key("n2_value"), "n": "1"},
        "select l_partkey as partkey, 1 as n from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey where o_orderpriority = '1-URGENT' and l_quantity > 45")
pattern("edge_prop", 'n(type="order")->e(type="contains", returnflag="R", quantity>=50)->n(type="part")', {"orderkey": key("n1_value"), "partkey": key("n3_value")},
        "select l_orderkey as orderkey, l_partkey as partkey from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey where l_returnflag = 'R' and l_quantity >= 50")
pattern("trailer_alias", 'n:c()->e(type="placed")->n:o(), c(type="customer", acctbal<0), 3(type="order", status="F")', {"custkey": key("n1_value"), "orderkey": key("n3_value")},
        "select c_custkey as custkey, o_orderkey as orderkey from customer join orders on o_custkey = c_custkey where c_acctbal < 0 and o_orderstatus = 'F'")
pattern("native_filter", 'n(type="customer", outbound_count>20)', {"custkey": key("n1_value")},
        "select c_custkey as custkey from customer left join orders on o_custkey = c_custkey group by c_custkey having count(o_orderkey) + 1 > 20")

_EDGES = """
nodes as (select 'region' as t, r_regionkey::varchar as v from region union all select 'nation', n_nationkey::varchar from nation union all select 'customer', c_custkey::varchar from customer
  union all select 'supplier', s_suppkey::varchar from supplier union all select 'part', p_partkey::varchar from part union all select 'order', o_orderkey::varchar from orders),
edges as (
  select 'nation' as st, n_nationkey::varchar as sv, 'region' as tt, n_regionkey::varchar as tv, 'in' as ty from nation
  union all select 'customer', c_custkey::varchar, 'nation', c_nationkey::varchar, 'in' from customer
  union all select 'supplier', s_suppkey::varchar, 'nation', s_nationkey::varchar, 'in' from supplier
  union all select 'customer', o_custkey::varchar, 'order', o_orderkey::varchar, 'placed' from orders
  union all select 'order', l_orderkey::varchar, 'part', l_partkey::varchar, 'contains' from lineitem
  union all select distinct 'part', l_partkey::varchar, 'supplier', l_suppkey::varchar, 'supplied_by' from lineitem),
live as (select e.* from edges e join nodes a on a.t = st and a.v = sv join nodes b on b.t = tt and b.v = tv),
ends as (select st as t, sv as v, tt as ot, tv as ov, 1 as o from live union all select tt, tv, st, sv, 0 from live)"""


@add("degree", f"with {_EDGES} select nodes.t as type, nodes.v as value, count(o) as edge_count, count(o) filter (o = 0) as inbound_count, count(o) filter (o = 1) as outbound_count from nodes left join ends using (t, v) group by 1, 2")
def degree(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return g.nodes.join(natives.degrees(g), "id").drop("id")


@add("neighbors", f"with {_EDGES} select nodes.t as type, nodes.v as value, count(distinct ot || '/' || ov) as neighbor_count from nodes left join ends using (t, v) group by 1, 2")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return g.nodes.join(natives.neighbour_counts(g), "id").drop("id")


@add("neighbor_types", f"with {_EDGES} select t as type, v as value, ot as neighbor_type, count(distinct ov) as n from ends group by 1, 2, 3")
def neighbor_types(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return g.nodes.join(natives.neighbour_types(g).withColumnRenamed("type", "neighbor_type"), "id").drop("id")


_TOP = "(select max(event_id) from events)"


def _top(spark: SparkSession, d: str) -> int:
    return table(spark, d, "events").agg(F.max("event_id").alias("m")).first().m


@add("history_view", f"with e as (select user_id, event_id, event_type from events where event_id < {_TOP} // 2) select user_id, arg_max(event_type, event_id) as last_event from e group by user_id")
def history_view(spark: SparkSession, d: str) -> DataFrame:
    v = View(event_history(spark, d), _top(spark, d) // 2 * STEP)
    n = v.nodes.select(F.col("id").alias("parent"), F.col("value").cast("long").alias("user_id"))
    return n.join(v.props.filter("key = 'last_event'"), "parent").select("user_id", F.col("val_str").alias("last_event"))


@add("log_supersede", "select user_id, arg_max(event_type, event_id) as last_event, arg_max(cast(props->>'$.k' as bigint), event_id) as k from events group by user_id")
def log_supersede(spark: SparkSession, d: str) -> DataFrame:
    v = View(event_history(spark, d))
    p = v.props.groupBy("parent").agg(F.max(F.when(F.col("key") == "last_event", F.col("val_str"))).alias("last_event"), F.max(F.when(F.col("key") == "k", F.col("val_int"))).cast("long").alias("k"))
    return v.nodes.select(F.col("id").alias("parent"), F.col("value").cast("long").alias("user_id")).join(p, "parent").select("user_id", "last_event", "k")


@add("counts_at", f"select count(distinct user_id) as nodes, 0::bigint as edges from events where event_id < {_TOP} // 2")
def counts_at(spark: SparkSession, d: str) -> DataFrame:
    return View(event_history(spark, d), _top(spark, d) // 2 * STEP).counts()


@add("update_id", """
with e as (select user_id, event_id, event_type, cast(props->>'$.k' as bigint) as k, lag(event_type) over w as p, lag(cast(props->>'$.k' as bigint)) over w as pk from events window w as (partition by user_id order by event_id))
select user_id, max(case when k is distinct from pk then event_id * 4 + 3 when event_type is distinct from p then event_id * 4 + 2 else 0 end) as updated from e group by user_id""")
def update_id(spark: SparkSession, d: str) -> DataFrame:
    h = event_history(spark, d)
    nodes = View(h).nodes.select("id", F.col("value").cast("long").alias("user_id"))
    return nodes.join(update_ids(h), "id").select("user_id", "updated")


@add("mquery_flip", """
select user_id, event_id from (select *, lag(event_type) over (partition by user_id order by event_id) as p from events) where event_type = 'error' and (p is null or p <> 'error')""")
def mquery_flip(spark: SparkSession, d: str) -> DataFrame:
    s = standing(event_history(spark, d), ['n(last_event="error")'])
    return s.select(F.col("chain")[0]["value"].cast("long").alias("user_id"), F.floor((F.col("at") - 2) / STEP).alias("event_id"))


@add("mquery_range", f"""
select user_id, event_id from (select *, lag(event_type) over (partition by user_id order by event_id) as p from events)
where event_type in ('click', 'view') and (p is null or p not in ('click', 'view')) and event_id >= {_TOP} // 5 and event_id < {_TOP} // 5 * 4""")
def mquery_range(spark: SparkSession, d: str) -> DataFrame:
    part = _top(spark, d) // 5
    s = standing(event_history(spark, d), ['n(last_event=["click","view"])'], start=part * STEP, stop=part * 4 * STEP - 1)
    return s.select(F.col("chain")[0]["value"].cast("long").alias("user_id"), F.floor((F.col("at") - 2) / STEP).alias("event_id"))


@add("mquery_chain", "select c_custkey as custkey, o_orderkey as orderkey from customer join orders on o_custkey = c_custkey where c_mktsegment = 'AUTOMOBILE' and o_totalprice > 200000")
def mquery_chain(spark: SparkSession, d: str) -> DataFrame:
    s = standing(history(spark, d), ['n(type="customer", mktsegment="AUTOMOBILE")->@e(type="placed")->n(type="order", totalprice>200000)'])
    return s.select(F.col("chain")[0]["value"].cast("long").alias("custkey"), F.col("chain")[1]["value"].cast("long").alias("orderkey"))


@add("cascade_delete", """
with gone as (select c_custkey from customer where c_mktsegment = 'HOUSEHOLD'), nodes as (select count(*) as n from customer where c_mktsegment <> 'HOUSEHOLD'),
left_edges as (select count(*) as n from orders join customer on o_custkey = c_custkey where c_mktsegment <> 'HOUSEHOLD')
select nodes.n as customers, left_edges.n as placed, (select count(*) * 3 from customer where c_mktsegment <> 'HOUSEHOLD') as props from nodes, left_edges""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """All customers of a segment are deleted by one log row each; edges and properties end with them."""
    h = history(spark, d)
    doomed = match(View(h), 'n(type="customer", mktsegment="HOUSEHOLD")').select("n1_id")
    top = h.agg(F.max("id").alias("top"))
    rows = doomed.crossJoin(F.broadcast(top)).select((F.col("top") + F.col("n1_id")).alias("id"), F.lit("deletion").alias("kind"), F.col("n1_id").alias("target"))
    v = View(advance(h, as_log(rows)))
    mine = v.nodes.filter("type = 'customer'")
    n = mine.agg(F.count("*").alias("customers"))
    e = v.edges.filter("type = 'placed'").agg(F.count("*").alias("placed"))
    p = v.props.join(mine.select(F.col("id").alias("parent")), "parent", "left_semi").agg(F.count("*").alias("props"))
    return n.crossJoin(e).crossJoin(p)


@add("props_of", "select c_custkey as custkey, 'mktsegment' as key, c_mktsegment as val_str from customer union all select c_custkey, 'name', c_name from customer")
def props_of(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    n = g.nodes.filter("type = 'customer'").select(F.col("id").alias("parent"), F.col("value").cast("long").alias("custkey"))
    return n.join(g.props.filter("val_kind = 'string'"), "parent").select("custkey", "key", "val_str")


@add("props_valued", "select p_partkey as partkey from part where p_brand = 'Brand#17'")
def props_valued(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    hit = g.props.filter("key = 'brand' and val_str = 'Brand#17'").select(F.col("parent").alias("id"))
    return g.nodes.join(hit, "id", "left_semi").select(F.col("value").cast("long").alias("partkey"))


