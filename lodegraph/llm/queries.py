"""Queries of the operators in this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import addresses, mixing, names, packing, spam, splits, topn
from lodegraph.session import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_location(table(spark, d, "entities"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_name(table(spark, d, "entities"), table(spark, d, "nicknames"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return addresses.location_classes(table(spark, d, "entities"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return names.name_classes(table(spark, d, "entities"), table(spark, d, "nicknames"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "candidates"), "grp", "id", "prior", 5).select("grp", "id")


def p3_top_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "candidates"), "grp", "id", "prior", 5)


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return splits.anchors(table(spark, d, "batches"), table(spark, d, "tasks"))[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(spark, d).filter("grp <> anchor")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(_anchors(spark, d))


def p5_forest(spark: SparkSession, d: str) -> DataFrame:
    """The edges by which calls were joined, each component's one fewer than its nodes."""
    return splits.anchors(table(spark, d, "batches"), table(spark, d, "tasks"))[1]


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    s = splits.assign_splits(_anchors(spark, d))
    total = s.agg(F.count("*").alias("t"))
    return s.groupBy("split").agg(F.count("*").alias("calls"), F.countDistinct("anchor").alias("components")).crossJoin(
        F.broadcast(total)).select("split", "calls", "components", (F.col("calls") / F.col("t")).alias("share"))


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any splits: every call has one, no component is torn, the shares are near."""
    s = splits.assign_splits(_anchors(spark, d)).groupBy("anchor").agg(
        F.count("*").alias("n"), F.countDistinct("grp").alias("calls"), F.countDistinct("split").alias("splits"), F.first("split").alias("split"))
    part = lambda x: F.sum(F.when(F.col("split") == x, F.col("n")).otherwise(0)) / F.sum("n")
    near = [F.abs(part(x) - p) < 0.03 for x, p in splits.SPLITS]
    return s.agg(F.sum("calls").alias("calls"), F.count_if(F.col("splits") > 1).alias("torn"), (near[0] & near[1] & near[2]).alias("near"))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: every text is there, no container too full, no text torn that fits, no two members of a cluster together."""
    from lodegraph.llm.duplicates import clusters

    docs = table(spark, d, "documents")
    p = materialize(packing.pack(docs, table(spark, d, "pack_targets")), "packed")
    held = p.groupBy("name", "capacity_tokens", "container").agg(F.sum("tokens").alias("t")).groupBy("name").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    texts = p.groupBy("name", "capacity_tokens", "doc_id").agg(F.sum("tokens").alias("t"), F.countDistinct("container").alias("c"))
    texts = texts.groupBy("name").agg(F.count("*").alias("documents"), F.count_if((F.col("t") <= F.col("capacity_tokens")) & (F.col("c") > 1)).alias("torn"))
    roots = p.filter("piece = 0").join(clusters(docs), F.col("doc_id") == F.col("node")).groupBy("name", "container", "root").agg(F.countDistinct("doc_id").alias("n"))
    together = roots.groupBy("name").agg(F.count_if(F.col("n") > 1).alias("together"))
    return texts.join(held, "name").join(together, "name", "left").select("name", "documents", "overfull", "torn", F.coalesce("together", F.lit(0)).alias("together"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any mixture: every source is reported, none is used beyond its cap, the shares add up to 1."""
    s = p7_shares(spark, d)
    return s.agg(F.count("*").alias("sources"), F.count_if(F.col("most_copies") > F.col("max_repeats")).alias("beyond"), F.round(F.sum("actual_share"), 9).alias("whole"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_targets"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, d))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return spam.page_shares(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p3_found": p3_found,
    "p3_top_ranked": p3_top_ranked,
    "p5_found": p5_found,
    "p5_splits": p5_splits,
    "p5_forest": p5_forest,
    "p5_shares": p5_shares,
    "p5_checks": p5_checks,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p6_checks": p6_checks,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
}

_BEST = """
with best as (
  select grp, id, max(prior) + 0.0 as prior from candidates
  where grp is not null and id is not null and prior is not null and not isnan(prior) and not isinf(prior)
  group by grp, id),
ranked as (select grp, id, prior, row_number() over (partition by grp order by prior desc, id) as rank from best)
"""



def _key(c: str) -> str:
    """A name's key in SQL: words and numbers joined by dots, without leading zeros."""
    x = f"regexp_replace(lower({c}), '[^a-z0-9]+', '.', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '([a-z])([0-9])', '\\1.\\2', 'g'), '([0-9])([a-z])', '\\1.\\2', 'g')"
    return f"nullif(regexp_replace(trim({x}, '.'), '(^|\\.)0+([0-9])', '\\1\\2', 'g'), '')"


_ANCHORS = f"""
with recursive named as (select grp, {_key("run")} as r, {_key("task")} as t from batches where grp is not null),
calls as (select distinct grp, r, coalesce(t, array_to_string(string_split(r, '.')[1:3], '.')) as t from named),
has as (select t, min(grp) as low from calls where t is not null group by t),
seeds as (select distinct {_key("task")} as t, unnest(seeds) as seed from tasks),
links as (
  select a.t as a, b.t as b from seeds a join seeds b using (seed) where seed is not null and a.t <> b.t
  union select a.t, b.t from calls a join calls b using (r) where a.t <> b.t
  union select a.t, b.t from calls a join calls b using (grp) where a.t <> b.t),
reach as (select t as a, t as b from has union select reach.a, links.b from reach join links on reach.b = links.a),
root as (select a as t, min(low) as anchor from reach join has on has.t = reach.b group by a),
anchors as (select grp, min(coalesce(anchor, grp)) as anchor from calls left join root using (t) group by grp)
"""

ORACLES: dict[str, str] = {
    "p5_checks": "select count(distinct grp) as calls, 0::bigint as torn, true as near from batches",
    "p6_checks": "select name, (select count(distinct doc_id) from documents where text <> '') as documents, 0::bigint as overfull, 0::bigint as torn, 0::bigint as together from pack_targets",
    "p7_checks": "select count(*) as sources, 0::bigint as beyond, 1.0::double as whole from mix_targets",
    "p5_found": _ANCHORS + "select grp, anchor from anchors where grp <> anchor",
    "p3_found": _BEST + "select grp, id from ranked where rank <= 5",
    "p3_top_ranked": _BEST + "select grp, id, prior, rank from ranked where rank <= 5",
}
