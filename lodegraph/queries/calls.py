"""Queries of single calls: lookups, writes, value functions, natives, algorithms and ranking numbers, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import bulk, natives
from lodegraph.algo.paths import costs, joining, path_slack, shared_with_target
from lodegraph.expand.source import label_depth
from lodegraph.expand.tasks import answer_value, answers_left
from lodegraph.functions import json_values as J
from lodegraph.lgql import match, query
from lodegraph.log import View, advance, edge_lookup, edges_ended_by, entry, log_commits, next_id, span, strings
from lodegraph.plans.trade import STEP, event_history, graph, history
from lodegraph.rank.features import features, priority
from lodegraph.rank.metrics import capped, credit
from lodegraph.schema import as_log, typed
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


def _value(v: View, column: str, name: str) -> DataFrame:
    return v.nodes.select(F.col("id").alias(column), F.col("value").alias(name))


# Lookups

_LOG = f"""
with e as (select user_id, event_id, event_type, cast(props->>'$.k' as bigint) as k, lag(event_type) over w as p, lag(cast(props->>'$.k' as bigint)) over w as pk, row_number() over w as n from events window w as (partition by user_id order by event_id)),
log as (select event_id * {STEP} + 1 as id, 'node' as kind from e where n = 1 union all select event_id * {STEP} + 2, 'prop' from e where event_type is distinct from p union all select event_id * {STEP} + 3, 'prop' from e where k is not null and k is distinct from pk)"""


@add("entry_row", f"select user_id::varchar as value, 'node' as kind from events where event_id = (select min(event_id) from events)")
def entry_row(spark: SparkSession, d: str) -> DataFrame:
    h = event_history(spark, d)
    first = h.agg(F.min("id").alias("m")).first().m
    return entry(h, first).select("value", "kind")


@add("log_span", f"{_LOG}, ends as (select max(event_id) // 4 * {STEP} as a, max(event_id) // 2 * {STEP} as b from events) select id, kind from log, ends where id >= a and id < b")
def log_span(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "events").agg(F.max("event_id").alias("m")).first().m
    return span(event_history(spark, d), top // 4 * STEP, top // 2 * STEP).select("id", "kind")


@add("next_position", f"{_LOG} select max(id) + 1 as next_id from log")
def next_position(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(next_id(event_history(spark, d)),)], "next_id long")


@add("edge_point", "select 'placed' as type, o_custkey as custkey, o_orderkey as orderkey from orders join customer on c_custkey = o_custkey where o_orderkey = (select min(o_orderkey) from orders join customer on c_custkey = o_custkey)")
def edge_point(spark: SparkSession, d: str) -> DataFrame:
    v = graph(spark, d)
    key = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.min("o_orderkey").alias("m")).first().m
    pair = match(v, f'n(type="customer")->e(type="placed")->n(type="order", value="{key}")').first()
    found = edge_lookup(v, pair.n1_id, pair.n3_id, "placed")
    return found.join(_value(v, "src", "custkey"), "src").join(_value(v, "tgt", "orderkey"), "tgt").select("type", F.col("custkey").cast("long").alias("custkey"), F.col("orderkey").cast("long").alias("orderkey"))


@add("edge_type_scan", "select c_custkey as custkey, o_orderkey as orderkey from orders join customer on o_custkey = c_custkey")
def edge_type_scan(spark: SparkSession, d: str) -> DataFrame:
    v = graph(spark, d)
    found = match(v, 'e(type="placed")').select(F.col("e1_src").alias("src"), F.col("e1_tgt").alias("tgt"))
    return found.join(_value(v, "src", "c"), "src").join(_value(v, "tgt", "o"), "tgt").select(F.col("c").cast("long").alias("custkey"), F.col("o").cast("long").alias("orderkey"))


_ONE = "(select min(c_custkey) from customer join orders on o_custkey = c_custkey)"


@add("edges_ended", f"select 'placed' as type, count(*) as n from orders where o_custkey = {_ONE} union all select 'in', 1")
def edges_ended(spark: SparkSession, d: str) -> DataFrame:
    """What ends with one customer, read back from the history."""
    h = history(spark, d)
    key = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.min("c_custkey").alias("m")).first().m
    at = next_id(h)
    one = match(View(h), f'n(type="customer", value="{key}")').select(F.lit(at).alias("id"), F.lit("deletion").alias("kind"), F.col("n1_id").alias("target"))
    return edges_ended_by(advance(h, as_log(one)), at).groupBy("type").agg(F.count("*").alias("n"))


@add("string_ids", "with s as (select unnest(['user', 'last_event', 'k']) as string union select user_id::varchar from events) select string, row_number() over (order by string) as string_id from s")
def string_ids(spark: SparkSession, d: str) -> DataFrame:
    return strings(event_history(spark, d))


@add("commit_counts", "with m as (select max(event_id) as m from events), q as (select unnest([1, 2, 3, 4]) as q), c as (select q, m * q // 4 as last from m, q) select q::int as quarter, (select count(distinct user_id) from events where event_id <= last) as nodes, 0::bigint as edges from c")
def commit_counts(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "events").agg(F.max("event_id").alias("m")).first().m
    ends = spark.createDataFrame([(q, top * q // 4 * STEP + STEP - 1) for q in (1, 2, 3, 4)], "quarter int, end long")
    return log_commits(event_history(spark, d), ends.select("end")).join(ends, "end").select("quarter", "nodes", "edges")


@add("many_patterns", "select 0 as pattern, value from (select n_nationkey::varchar as value from nation order by value limit 30) union all select 1, value from (select r_regionkey::varchar as value from region order by value limit greatest(0, 28 - (select count(*) from nation)))")
def many_patterns(spark: SparkSession, d: str) -> DataFrame:
    q = query(graph(spark, d), ['n(type="nation")', 'n(type="region")'], limit=28)
    return q.select("pattern", F.col("chain")[0]["value"].alias("value"))


@add("literals", "select p_partkey as partkey from part where p_size in (10, 11, 12, 13) and p_brand <> 'it''s \"x\" \\'")
def literals(spark: SparkSession, d: str) -> DataFrame:
    text = r"""n(type="part", size=[0xA, 013, 1.2e1, 13], brand!="it's \"x\" \\")"""
    return match(graph(spark, d), text).select(F.col("n1_value").cast("long").alias("partkey"))


@add("object_path", "select event_id from events where cast(props->>'$.k' as bigint) >= 50")
def object_path(spark: SparkSession, d: str) -> DataFrame:
    """A test inside an object value."""
    e = table(spark, d, "events").select("event_id", "props")
    nodes = e.select((F.col("event_id") * 2 + 1).alias("id"), F.lit("node").alias("kind"), F.lit("event").alias("type"), F.col("event_id").cast("string").alias("value"))
    props = e.select((F.col("event_id") * 2 + 2).alias("id"), F.lit("prop").alias("kind"), (F.col("event_id") * 2 + 1).alias("parent"), F.lit("props").alias("key"), F.lit("object").alias("val_kind"), F.col("props").alias("val_json"))
    h = as_log(nodes).unionByName(as_log(props)).withColumn("next", F.lit(None).cast("long"))
    return match(View(h), "n(props.k>=50)").select(F.col("n1_value").cast("long").alias("event_id"))


# Natives

@add("edge_lists", """
with e as (select n_nationkey::varchar as nation, 'in' as type from nation union all select c_nationkey::varchar, 'in' from customer join nation on n_nationkey = c_nationkey union all select s_nationkey::varchar, 'in' from supplier join nation on n_nationkey = s_nationkey)
select nation, count(*)::int as edges, (count(*) - 1)::int as inbound, 1::int as outbound from e group by nation""")
def edge_lists(spark: SparkSession, d: str) -> DataFrame:
    v = graph(spark, d)
    return natives.edge_lists(v).join(v.nodes.filter("type = 'nation'"), "id").select(F.col("value").alias("nation"), F.size("edges").alias("edges"), F.size("inbound").alias("inbound"), F.size("outbound").alias("outbound"))


@add("neighbour_lists", "select c_custkey as custkey, 'order' as type, o_orderkey::varchar as value from orders join customer on c_custkey = o_custkey union all select c_custkey, 'nation', n_nationkey::varchar from customer join nation on n_nationkey = c_nationkey")
def neighbour_lists(spark: SparkSession, d: str) -> DataFrame:
    v = graph(spark, d)
    mine = natives.neighbours(v).join(v.nodes.filter("type = 'customer'").select("id", F.col("value").cast("long").alias("custkey")), "id")
    return mine.select("custkey", F.explode("neighbors").alias("id")).join(v.nodes, "id").select("custkey", "type", "value")


# Writes

_WRITTEN = """
select 'node' as kind, 'customer' as type, count(*) as n from customer union all select 'edge', 'in', count(*) from customer join nation on n_nationkey = c_nationkey
union all select 'prop', 'mktsegment', count(*) from customer where c_mktsegment is not null union all select 'prop', 'name', count(*) from nation where n_nationkey % 2 = 0"""


@add("ingest_bulk", _WRITTEN)
def ingest_bulk(spark: SparkSession, d: str) -> DataFrame:
    """Customers written to a graph that has the nations: nations are found, half of their names change."""
    h = history(spark, d).filter("next is null")
    known = h.filter("kind = 'node' and type in ('nation', 'region')")
    names = h.filter("kind = 'prop'").join(known.select(F.col("id").alias("parent")), "parent", "left_semi").select(*h.columns)
    old = known.select(*h.columns).unionByName(names)
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    nation = lambda x: x.cast("string")
    nodes = c.select(F.lit("customer").alias("type"), F.col("c_custkey").cast("string").alias("value")).union(n.select(F.lit("nation"), nation(F.col("n_nationkey"))))
    edges = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(
        F.lit("customer").alias("src_type"), F.col("c_custkey").cast("string").alias("src_value"), F.lit("nation").alias("tgt_type"), nation(F.col("c_nationkey")).alias("tgt_value"), F.lit("in").alias("type"), F.lit(None).cast("string").alias("value"))
    props = c.filter("c_mktsegment is not null").select(F.lit("customer").alias("type"), F.col("c_custkey").cast("string").alias("value"), F.lit("mktsegment").alias("key"), *typed(F.col("c_mktsegment"), "string"))
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name"))
    props = props.union(n.select(F.lit("nation"), nation(F.col("n_nationkey")), F.lit("name"), *typed(name, "string")))
    new = bulk.written(old, nodes, edges, props)
    return new.groupBy("kind", F.coalesce("type", "key").alias("type")).agg(F.count("*").alias("n"))


@add("chain_ingest", "select 'node' as what, 'customer' as type, count(distinct c_custkey) as n from customer join orders on o_custkey = c_custkey union all select 'node', 'nation', count(distinct c_nationkey) from customer join orders on o_custkey = c_custkey union all select 'node', 'order', count(*) from customer join orders on o_custkey = c_custkey union all select 'edge', 'in', count(distinct c_custkey) from customer join orders on o_custkey = c_custkey union all select 'edge', 'placed', count(*) from customer join orders on o_custkey = c_custkey")
def chain_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Orders as chains of order, customer and nation."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    item = lambda t, c=None: F.struct(F.lit(t).alias("type"), (F.lit(None) if c is None else F.col(c)).cast("string").alias("value"))
    nodes, edges = bulk.chains(o.select(F.array(item("order", "o_orderkey"), item("placed"), item("customer", "c_custkey"), item("in"), item("nation", "c_nationkey")).alias("chain")))
    return nodes.groupBy("type").count().select(F.lit("node").alias("what"), "type", F.col("count").alias("n")).union(edges.groupBy("type").count().select(F.lit("edge"), "type", "count"))


_ADJ = "e as (select distinct id, nbr from adj where id is not null and nbr is not null), u as (select id, nbr from e union select nbr, id from e)"


@add("depths", f"with recursive {_ADJ}, walk as (select 101::bigint as id, 0 as depth union select u.nbr, depth + 1 from walk join u using (id) where depth < 12) select id, min(depth) as depth from walk group by id")
def depths(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "adj").select(F.col("id").alias("src"), F.col("nbr").alias("tgt")).dropna().distinct()
    return bulk.depths(e, spark.createDataFrame([(101,)], "id long"))


# Values

@add("truthy_values", "select event_id, cast(props->>'$.k' as bigint) <> 0 as k, event_type <> '' as name, props <> '{}' as object from events")
def truthy_values(spark: SparkSession, d: str) -> DataFrame:
    none = {k: F.lit(None) for k in ("bool", "num", "str", "json")}
    k = F.get_json_object("props", "$.k").cast("double")
    of = lambda kind, **v: J.truthy({**none, "kind": F.lit(kind), **v})
    return table(spark, d, "events").select("event_id", of("number", num=k).alias("k"), of("string", str=F.col("event_type")).alias("name"), of("object", json=F.col("props")).alias("object"))


@add("date_values", "select doc_id, epoch(date_trunc('second', sitting_at))::bigint as at, epoch(date_trunc('day', sitting_at))::bigint as day, epoch(date_trunc('minute', sitting_at))::bigint as minute from documents")
def date_values(spark: SparkSession, d: str) -> DataFrame:
    text = lambda p: J.date_seconds(F.date_format("sitting_at", p))
    return table(spark, d, "documents").select("doc_id", text("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"), text("yyyy-MM-dd").alias("day"), text("yyyy-MM-dd HH:mm").alias("minute"))


@add("word_values", r"select distinct doc_id, unnest(regexp_extract_all(agenda_item, '[\pL\pN_]+')) as word from documents where agenda_item is not null")
def word_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("agenda_item is not null").select("doc_id", F.explode(J.words(F.col("agenda_item"))).alias("word"))


@add("uuid_values", """
with h as (select event_id, md5(event_id::varchar) as h from events), u as (select event_id, h[1:8] || '-' || h[9:12] || '-' || (case when event_id % 2 = 0 then '1' else '4' end) || h[14:16] || '-' || h[17:20] || '-' || h[21:32] as u from h)
select event_id, true as ok, case when event_id % 2 = 0 then round((('0x' || u[16:18] || u[10:13] || u[1:8])::bigint - 122192928000000000) / 1e7, 3) end as created from u""")
def uuid_values(spark: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    u = F.concat(h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-"), F.when(F.col("event_id") % 2 == 0, "1").otherwise("4"), h.substr(14, 3), F.lit("-"), h.substr(17, 4), F.lit("-"), h.substr(21, 12))
    return table(spark, d, "events").select("event_id", u.alias("u")).select("event_id", J.is_uuid(F.col("u")).alias("ok"), F.round(J.uuid_seconds(F.col("u")), 3).alias("created"))


@add("merged_values", "select event_id, case when k = 9 then '[9]' else '[' || least(k, 9) || ',' || greatest(k, 9) || ']' end as merged from (select event_id, cast(props->>'$.k' as bigint) as k from events)")
def merged_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    merge = F.pandas_udf(J.merge_json, "string")
    return table(spark, d, "events").select("event_id", merge(F.concat(F.lit("["), k, F.lit("]")), F.lit("[9,9]")).alias("merged"))


@add("answers_left", "select key from (select sha256('m' || chr(0) || 'q' || chr(0) || prompt) as key, min(created_at) as c from tasks where prompt is not null group by prompt) where key > '8'")
def answers_left_query(spark: SparkSession, d: str) -> DataFrame:
    """Prompts without a stored answer, where those whose key begins with 0 to 7 have one."""
    asked = table(spark, d, "tasks").filter("prompt is not null").select(F.lit("m").alias("model"), F.lit("q").alias("question"), F.col("prompt").alias("text"))
    keys = asked.select(J.answer_key(F.col("model"), F.col("question"), F.col("text")).alias("key")).filter("key <= '8'").distinct()
    return answers_left(asked, keys).select("key")


@add("answer_values", "select grp, id, case when y is null then 'NaN'::double when domain = 0 then y::double else hops / 9.0 end as value from candidates where domain is not null and hops is not null")
def answer_values(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("y").isNull(), "none").when(F.col("domain") == 0, "probability").otherwise("score")
    v = answer_value(kind, F.col("y").cast("double"), F.col("hops").cast("double"), F.lit(9.0))
    return table(spark, d, "candidates").filter("domain is not null and hops is not null").select("grp", "id", v.alias("value"))


@add("wire_fields", "select grp, id, domain::int as domain, peek, hops, cost, case when isinf(prior) or isnan(prior) then null else prior end as priority from candidates where grp is not null")
def wire_fields(spark: SparkSession, d: str) -> DataFrame:
    """The lines of ``wire_lines`` read back."""
    from lodegraph.queries.graphs import wire_lines

    row = F.from_json("line", "id long, domain int, peek array<int>, hops int, cost double, priority double")
    return wire_lines(spark, d).select("grp", row.alias("r")).select("grp", "r.*")


# Algorithms

@add("components", f"with recursive {_ADJ}, low as (select id, id as root from u union select u.nbr, low.root from low join u using (id) where low.root < u.nbr) select id as node, min(root) as root from low group by id")
def components(spark: SparkSession, d: str) -> DataFrame:
    from lodegraph.algo.components import spanning_forest

    return spanning_forest(table(spark, d, "adj"), "id", "nbr")[0]


def _relaxed(source: int, name: str, rounds: int = 14) -> str:
    """Cheapest costs from a node in SQL: so many rounds over all edges, each the least of what was known and one edge more."""
    steps = [f"{name}0 as (select {source}::bigint as id, 0.0::double as cost)"]
    for k in range(1, rounds + 1):
        steps.append(f"{name}{k} as materialized (select id, min(cost) as cost from (select * from {name}{k - 1} union all select u.nbr, cost + case when c.id = {source} then 0 else w end from {name}{k - 1} c join u on u.id = c.id join deg on deg.id = c.id) group by id)")
    return ", ".join(steps) + f", {name} as (select * from {name}{rounds})"


_DEG = f"{_ADJ}, deg as (select id, count(*) as degree, ln(1 + count(*)) as w from u group by id)"
_A, _B = 101, 1044


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "adj").select("id", "nbr").dropna().distinct()
    both = e.union(e.select("nbr", "id")).distinct()
    return both, both.groupBy("id").agg(F.count("*").alias("degree"))


@add("cheapest_costs", f"with {_DEG}, {_relaxed(_A, 'a')} select id, round(cost, 6) as cost from a")
def cheapest_costs(spark: SparkSession, d: str) -> DataFrame:
    return costs(*_both(spark, d), _A).select("id", F.round("cost", 6).alias("cost"))


@add("path_slack", f"""
with {_DEG}, {_relaxed(_A, 'a')}, {_relaxed(_B, 'b')}, best as (select cost as best from a where id = {_B}),
t as (select a.id, a.cost + b.cost + case when a.id in ({_A}, {_B}) then 0 else w end as t, best from a join b using (id) join deg using (id), best)
select id, round(greatest(t / best - 1, 0), 6) as slack from t where id not in ({_A}, {_B}) and t <= best * 1.1 + 1e-9 union all select unnest([{_A}, {_B}]), 0.0""")
def path_slack_query(spark: SparkSession, d: str) -> DataFrame:
    edges, degrees = _both(spark, d)
    best = costs(edges, degrees, _A).filter(F.col("id") == _B).first().cost
    return path_slack(edges, degrees, _A, _B, best).select("id", F.round("slack", 6).alias("slack"))


@add("joining", f"with {_DEG}, {_relaxed(_A, 'a')} select round(cost, 6) as cost, true as joined from a where id = {_B}")
def joining_query(spark: SparkSession, d: str) -> DataFrame:
    """The cost of the cheapest path along the edges, and whether those on it lead from one end to the other."""
    from lodegraph.algo.components import spanning_forest

    edges, degrees = _both(spark, d)
    written = edges.select(F.col("id").alias("x"), F.col("nbr").alias("y"), F.lit(0).alias("rel")).filter("x < y")
    cost, _, on = joining(written, degrees, _A, _B)
    ends = spanning_forest(on, "x", "y")[0].filter(F.col("node").isin(_A, _B)).agg(F.count("*").alias("n"), F.countDistinct("root").alias("roots"))
    return ends.select(F.round(F.lit(cost), 6).alias("cost"), ((F.col("n") == 2) & (F.col("roots") == 1)).alias("joined"))


@add("shared_with_target", """
with e as (select distinct id, nbr from adj where rel = 0 and nbr is not null and id is not null), has as (select distinct id from entities where domain = 1),
seed as (select min(id) as s from e where nbr in (select id from e)), hit as (select m.nbr as e, o.nbr as o from e m join seed on m.id = s join e o on o.id = m.nbr where o.nbr <> s and o.nbr in (select id from has))
select e as id from hit union select o from hit union select s from seed""")
def shared_query(spark: SparkSession, d: str) -> DataFrame:
    adj = table(spark, d, "adj")
    attrs = table(spark, d, "entities").select("id", F.lit("domain").alias("key"), F.col("domain").cast("string").alias("value"))
    e = adj.filter("rel = 0 and nbr is not null and id is not null").select("id", "nbr")
    seed = e.join(e.select(F.col("id").alias("nbr")).distinct(), "nbr", "left_semi").agg(F.min("id").alias("m")).first().m
    return shared_with_target(adj, attrs, seed, 0, "domain", "1")


@add("label_depths", """
with p as (select id, rel, nbr, row_number() over (partition by id, rel order by pos, nbr) - 1 as place from (select id, rel, nbr, min(pos) as pos from adj where id is not null and rel is not null and nbr is not null group by id, rel, nbr)),
y as (select distinct id from candidates where y = 1)
select id, rel::int as rel, min(place) as depth from p where nbr in (select id from y) group by id, rel""")
def label_depths(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "candidates").filter("y = 1").select("id")
    return label_depth(table(spark, d, "adj"), labels).select("id", F.col("rel").cast("int").alias("rel"), "depth")


# Ranking

@add("candidate_features", """
with c as (select grp, id, cost, list_sum(peek)::double as degree, (peek[1] + 0.5 * peek[2])::double as relevant, coalesce(cost, 1000) as c from candidates where grp is not null and id is not null and peek is not null)
select grp, id, round(ln(1 + degree), 6) as log_degree, round(ln(1 + relevant), 6) as log_relevant, round(c, 6) as cost, round(ln(1 + count(*) over (partition by grp)), 6) as batch,
  round((row_number() over (partition by grp order by c, id) - 1) / greatest(count(*) over (partition by grp) - 1, 1), 6) as rank_cost from c""")
def candidate_features(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").filter("grp is not null and id is not null and peek is not null")
    none = F.lit(0)
    rows = c.select(
        "grp", "id", F.coalesce("domain", none).alias("domain"), "peek", F.array().cast("array<int>").alias("fetched"), F.array("hops", F.lit(None)).alias("hops"), F.array("cost", F.lit(None)).alias("cost"), none.alias("known"),
        F.array().cast("array<int>").alias("known_by_domain"), none.alias("watched"), F.lit(False).alias("is_watched"), none.alias("alerts"), F.lit(None).cast("int").alias("probes"), F.array().cast("array<boolean>").alias("pushed"),
        F.lit("connect").alias("goal"), F.array(F.lit(1.0), F.lit(0.5)).alias("relation_interest"), F.array(F.lit(1.0)).alias("domain_interest"), F.lit(100).alias("budget"), none.alias("fetched_total"), F.array(none, none).alias("by_side"), none.alias("steps"))
    return features(rows).select("grp", "id", *[F.round(x, 6).alias(x) for x in ("log_degree", "log_relevant", "cost", "batch", "rank_cost")])


@add("learned_priority", "select grp, id, round(ln(0.5 + cost / 100) - 0.7 * ln(1 + hops), 6) as priority from candidates where cost between 0 and 40 and hops is not null")
def learned_priority(spark: SparkSession, d: str) -> DataFrame:
    p = priority(F.lit(0.5) + F.col("cost") / 100, F.log1p(F.col("hops").cast("double")), 0.7)
    return table(spark, d, "candidates").filter("cost between 0 and 40 and hops is not null").select("grp", "id", F.round(p, 6).alias("priority"))


@add("route_credit", """
with s as (select id, min(cost) / 10 as slack from known where cost is not null and id is not null group by id)
select grp, id, y::int as y, round(case when y = 1 and slack is not null then exp(-2 * slack) else 1 end, 6) as credit from candidates left join s using (id) where y is not null""")
def route_credit(spark: SparkSession, d: str) -> DataFrame:
    slack = table(spark, d, "known").filter("cost is not null and id is not null").groupBy("id").agg((F.min("cost") / 10).alias("slack"))
    c = credit(table(spark, d, "candidates").filter("y is not null").select("grp", "id", F.col("y").cast("int").alias("y")), slack, ["id"], "y", 2.0)
    return c.select("grp", "id", "y", F.round("credit", 6).alias("credit"))


@add("capped_positives", """
with c as (select distinct grp, id, y from candidates where y is not null and grp is not null), n as (select *, count(*) filter (y = 1) over (partition by grp) as pos from c)
select grp, id from n where y = 1 and pos <= 64""")
def capped_positives(spark: SparkSession, d: str) -> DataFrame:
    """Which rows a cap keeps, where it keeps all positives."""
    c = table(spark, d, "candidates").select("grp", "id", "y").filter("y is not null and grp is not null").distinct()
    kept = capped(c, "grp", "y", 64).filter("y = 1")
    few = c.groupBy("grp").agg(F.count_if(F.col("y") == 1).alias("pos")).filter("pos <= 64").select("grp")
    return kept.join(few, "grp", "left_semi").select("grp", "id")
