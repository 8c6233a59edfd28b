"""Queries of graph algorithms, expansion and ranking on the entity tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.algo.paths import closure, hops
from lodegraph.expand.policy import guided_priority
from lodegraph.expand.source import fetch, peek, semi_join_chain
from lodegraph.expand.tasks import alert_targets, connect_targets
from lodegraph.rank.features import test_tasks
from lodegraph.rank.metrics import by_task, capped, per_group, summary, weights
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


_E = "e as (select distinct id, nbr from adj where id is not null and nbr is not null)"
_U = "u as (select id, nbr from e union select nbr, id from e)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "adj").select("id", "nbr").dropna().distinct()


def _seed(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


@add("bfs_depth", f"with recursive {_E}, walk as (select 101::bigint as id, 0 as hops union select e.nbr, hops + 1 from walk join e using (id) where hops < 3) select id, min(hops) as hops from walk group by id")
def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    return hops(_edges(spark, d), _seed(spark, 101), 3)


@add("crawl", f"with recursive {_E}, {_U}, walk as (select 101::bigint as id union select u.nbr from walk join u using (id)) select id from walk")
def crawl(spark: SparkSession, d: str) -> DataFrame:
    return closure(_edges(spark, d), _seed(spark, 101))


@add("peek", "with edges as (select distinct id, rel, nbr from adj where id is not null and rel is not null and nbr is not null) select id, " + ", ".join(f"count(*) filter (rel = {r}) as rel_{r}" for r in range(8)) + " from edges group by id")
def peek_query(spark: SparkSession, d: str) -> DataFrame:
    p = peek(table(spark, d, "adj"))
    return p.select("id", *[F.get("peek", F.lit(r)).alias(f"rel_{r}") for r in range(8)])


@add("fetch_pages", """
with p as (select id, rel, nbr, row_number() over (partition by id, rel order by pos, nbr) - 1 as place from (select id, rel, nbr, min(pos) as pos from adj where id is not null and rel is not null and nbr is not null group by id, rel, nbr))
select id, rel, nbr, place from p where place >= 2 and place < 5""")
def fetch_pages(spark: SparkSession, d: str) -> DataFrame:
    adj = table(spark, d, "adj")
    picks = adj.select("id", "rel").dropna().distinct().select("id", "rel", F.lit(2).alias("offset"), F.lit(3).alias("limit"))
    return fetch(adj, picks).select("id", "rel", "nbr", F.col("at").alias("place"))


@add("fetch_where_via", """
with edges as (select distinct id, rel, nbr from adj where id is not null and rel is not null and nbr is not null)
select distinct a.id, a.nbr from edges a where a.rel = 0 and exists (select 1 from edges b where b.id = a.nbr and b.rel = 3 and exists (select 1 from entities x where x.id = b.nbr and x.domain = 1))""")
def fetch_where_via(spark: SparkSession, d: str) -> DataFrame:
    attrs = table(spark, d, "entities").select("id", F.lit("domain").alias("key"), F.col("domain").cast("string").alias("value"))
    return semi_join_chain(table(spark, d, "adj"), attrs, 0, [3], "domain", "1").select("id", "nbr").distinct()


_INTEREST = [1.0, 0.5, 0.2, 0.0, 0.2, 0.2, 0.0, 0.0]
_DOMAINS = [1.0, 0.8, 0.6, 0.3, 0.1]


@add("guided_priority", f"""
with c as (select *, [{', '.join(map(str, _INTEREST))}] as ri, [{', '.join(map(str, _DOMAINS))}] as di from candidates where cost is not null and domain is not null and peek is not null),
r as (select grp, id, logged_at, cost, di[domain + 1] as w, {' + '.join(f'peek[{i + 1}]' for i, x in enumerate(_INTEREST) if x > 0)} as n, {' + '.join(f'peek[{i + 1}] * {x}' for i, x in enumerate(_INTEREST))} as relevant from c)
select grp, id, round(-(cost + ln(1 + n)) / w, 6) as priority from r where relevant > 0 and w > 0""")
def guided(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").filter("cost is not null and domain is not null and peek is not null")
    p = guided_priority(F.col("peek"), F.col("cost"), F.col("domain"), _INTEREST, _DOMAINS)
    return c.select("grp", "id", F.round(p, 6).alias("priority")).filter("priority is not null")


@add("ranking_metrics", """
with c as (select grp, prior as s, y::int as y, coalesce(cost, 0) as c from candidates where grp is not null and prior is not null and not isnan(prior) and y is not null),
r as (select *, row_number() over (partition by grp order by s desc, y) as r from c),
f as (select *, min(case when y = 1 then r end) over (partition by grp) as first from r),
g as (select grp, sum(y) as pos, count(*) as n, coalesce(sum(case when r <= 10 and y = 1 then 1 / log2(r + 1) end), 0) as dcg, sum(case when r <= 10 then y end) as got, max(case when r = 1 then y end) as top, count(*) filter (r < first) as before from f group by grp)
select grp, round(dcg / (select sum(1 / log2(i + 1)) from range(1, least(pos, 10)::bigint + 1) t(i)), 6) as ndcg, round(got / least(pos, 10), 6) as recall, top::double as top1 from g where pos > 0 and pos < n""")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = per_group(table(spark, d, "candidates"), "grp", "prior", "y", "cost", 10)
    return m.select("grp", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"), "top1")


@add("capped_groups", "with c as (select grp, y, count(*) as n from candidates where y is not null and grp is not null group by 1, 2), g as (select grp, coalesce(sum(n) filter (y = 1), 0) as pos, coalesce(sum(n) filter (y = 0), 0) as neg from c group by 1) select grp, least(pos, 64)::bigint as kept_pos, least(neg, greatest(64 - pos, 0))::bigint as kept_neg from g")
def capped_groups(spark: SparkSession, d: str) -> DataFrame:
    k = capped(table(spark, d, "candidates").select("grp", "id", "y", "prior", "logged_at").filter("y is not null and grp is not null"), "grp", "y", 64)
    return k.groupBy("grp").agg(F.count_if(F.col("y") == 1).alias("kept_pos"), F.count_if(F.col("y") == 0).alias("kept_neg"))


@add("negative_weights", """
with c as (select grp, y from candidates where y is not null and grp is not null), g as (select grp, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from c group by 1)
select grp, round(neg / greatest(least(neg, greatest(8 - pos, 0)), 1), 6) as weight from g where least(neg, greatest(8 - pos, 0)) > 0""")
def negative_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select("grp", "id", "y", "prior", "logged_at").filter("y is not null and grp is not null")
    w = weights(capped(rows, "grp", "y", 8), rows, "grp", "y")
    return w.filter("y = 0").groupBy("grp").agg(F.round(F.max("weight"), 6).alias("weight"))


@add("cost_summary", """
with r as (select domain, cost, row_number() over (partition by domain order by cost) - 1 as i, count(*) over (partition by domain) as n from candidates where cost is not null)
select domain::bigint as domain, round(avg(cost), 6) as mean, min(cost) filter (i >= ceil(0.5 * (n - 1))) as p50, min(cost) filter (i >= ceil(0.9 * (n - 1))) as p90 from r group by 1""")
def cost_summary(spark: SparkSession, d: str) -> DataFrame:
    s = summary(table(spark, d, "candidates").select(F.col("domain").cast("long").alias("domain"), "cost"), "domain", "cost")
    return s.withColumn("mean", F.round("mean", 6))


@add("offered_by_task", "with g as (select task, run, avg(offered) as m from batches group by 1, 2) select task, round(avg(m), 6) as mean from g group by 1")
def offered_by_task(spark: SparkSession, d: str) -> DataFrame:
    return by_task(table(spark, d, "batches"), "task", "run", "offered").withColumn("mean", F.round("mean", 6))


@add("alert_targets", """
with officer as (select id, min(domain)::varchar as country from entities where id is not null and domain is not null group by id),
e as (select distinct id as x, nbr as y from adj where rel = 0 and id is not null and nbr is not null),
co as (select s.x as id, f.y as o from e s join e f on f.x = s.y where f.y <> s.x),
c as (select co.id, country, count(*) as n from co join officer on officer.id = co.o group by 1, 2),
k as (select c.*, sum(n) over (partition by c.id) as all_n from c)
select k.id, arg_min(k.country, (n, k.country)) as country, min(n) as n from k left join officer own on own.id = k.id where all_n >= 50 and k.country is distinct from own.country group by k.id""")
def alert_targets_query(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "entities").filter("id is not null and domain is not null").groupBy("id").agg(F.min("domain").cast("string").alias("country"))
    return alert_targets(table(spark, d, "adj"), ids, 0, 50)


@add("connect_targets", """
with recursive e as (select distinct id, nbr from adj where id is not null and nbr is not null), walk as (select 1044::bigint as id, 0 as hops union select e.nbr, hops + 1 from walk join e using (id) where hops < 6),
near as (select id, min(hops) as hops from walk group by id)
select id, hops from near where hops >= 4 and id in (select id from entities where domain = 1)""")
def connect_targets_query(spark: SparkSession, d: str) -> DataFrame:
    return connect_targets(_edges(spark, d), 1044, table(spark, d, "entities").filter("domain = 1"), 4, 6)


@add("sibling_split", None)
def sibling_split(spark: SparkSession, d: str) -> DataFrame:
    return test_tasks(table(spark, d, "tasks"), 0.2)


@add("wire_lines", None)
def wire_lines(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each call as JSON lines, infinite priorities as null."""
    c = table(spark, d, "candidates").filter("grp is not null")
    finite = F.when(F.col("prior").between(-1.7e308, 1.7e308), F.col("prior"))
    return c.select("grp", F.to_json(F.struct("id", "domain", "peek", "hops", "cost", finite.alias("priority")), {"ignoreNullFields": "false"}).alias("line"))
