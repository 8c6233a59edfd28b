"""Queries on heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegraph.operators.profiles import edge_audit, exact_quantiles, relation_histogram
from lodegraph.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return edge_audit(table(spark, d, "adj"), table(spark, d, "known")).select("id", "rel")


def p2_relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return relation_histogram(table(spark, d, "adj"))


def p2_neighbour_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return exact_quantiles(table(spark, d, "adj"), "id", "nbr", [0.25, 0.5, 0.75, 1.0])


QUERIES = {"p2_found": p2_found, "p2_relation_counts": p2_relation_counts, "p2_neighbour_quantiles": p2_neighbour_quantiles}

_RELS = range(8)
_COUNTS = ", ".join(f"count(*) filter (rel = {r}) as n_{r}" for r in _RELS)
_EDGES = f"""
edges as (select distinct id, rel, nbr from adj where id is not null and rel is not null and nbr is not null),
listed as (select id, {_COUNTS}, count(*) as n_all from edges group by id)"""
_CELLS = " union all ".join(
    f"select id, {r} as rel, k_{s} as recorded, coalesce(n_{s}, 0) as listed from both_sides" for r, s in [*((r, str(r)) for r in _RELS), (-1, "all")])
ORACLES = {
    "p2_relation_counts": f"with {_EDGES} select * from listed",
    "p2_found": f"""
with {_EDGES},
once as (select distinct on (log) log, id, peek, degree from known where id is not null),
recorded as (select id, {", ".join(f"sum(coalesce(peek[{r + 1}], 0)) as k_{r}" for r in _RELS)}, sum(coalesce(degree, 0)) as k_all from once group by id),
both_sides as (select recorded.*, listed.* exclude (id) from recorded left join listed using (id))
select id, cast(rel as bigint) as rel from ({_CELLS}) where recorded <> listed""",
    "p2_neighbour_quantiles": """
with v as (select id, nbr, row_number() over (partition by id order by nbr) as r, count(*) over (partition by id) as n
  from adj where id is not null and nbr is not null),
p as (select unnest([0.25, 0.5, 0.75, 1.0])::double as prob)
select id, prob, nbr, n from v, p where r = greatest(ceil(prob * n), 1)""",
}
