"""Writes of whole tables: the same find-or-create as a transaction's, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.log import delta, next_id, with_ends
from lodegraph.operators.skew import distributed_rank
from lodegraph.schema import VALUES, as_log
from lodegraph.session import materialize

_NODE, _EDGE = ["type", "value"], ["src", "tgt", "type", "value"]


class Missing(LookupError):
    """An end of an edge, or the owner of a property, that is no live node."""


def written(history: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, props: DataFrame | None = None) -> DataFrame:
    """The log rows that a write of tables appends to ``history`` (a log with ``next``).

    ``nodes`` has ``type`` and ``value``; ``edges`` ``src_type``, ``src_value``, ``tgt_type``, ``tgt_value``, ``type`` and
    ``value`` (null: empty); ``props`` ``type`` and ``value`` of a node, ``key`` and the value columns. What is
    live already is found, the rest is created once, in the order of its columns: nodes, then
    edges, then properties. A property with its current value adds no row; of several
    values given for one key the least counts. An edge or property of a node that is neither live
    nor among ``nodes`` is an error, and then nothing is written. Rows with a null type, value or key are left out.
    """
    at = next_id(history)
    live = history.filter("next is null")
    have = live.filter("kind = 'node'").select(*_NODE, "id")
    out = []
    if nodes is not None:
        fresh = nodes.select(*_NODE).dropna().distinct().join(have, _NODE, "left_anti")
        made = materialize(distributed_rank(fresh, _NODE, name="id").withColumn("id", F.col("id") + at), "made")
        at += made.count()
        have = have.unionByName(made)
        out.append(as_log(made.withColumn("kind", F.lit("node"))))
    if edges is not None:
        ends = edges.select("src_type", "src_value", "tgt_type", "tgt_value", "type", F.coalesce("value", F.lit("")).alias("value")).dropna().distinct()
        for side in ("src", "tgt"):
            of = have.select(F.col("type").alias(f"{side}_type"), F.col("value").alias(f"{side}_value"), F.col("id").alias(side))
            ends = ends.join(of, [f"{side}_type", f"{side}_value"], "left")
        ends = materialize(ends.select(*_EDGE), "ends")
        _complete(ends, "src is null or tgt is null")
        fresh = ends.join(live.filter("kind = 'edge'").select(*_EDGE), _EDGE, "left_anti")
        made = materialize(distributed_rank(fresh, _EDGE, name="id").withColumn("id", F.col("id") + at), "made")
        at += made.count()
        out.append(as_log(made.withColumn("kind", F.lit("edge"))))
    if props is not None:
        own = props.filter("key is not null and val_json is not null").join(have.withColumnRenamed("id", "parent"), _NODE, "left")
        once = own.groupBy(*_NODE, "parent", "key").agg(F.min(F.struct("val_json", *[v for v in VALUES if v != "val_json"])).alias("v"))
        once = materialize(once.select("parent", "key", "v.*"), "props")
        _complete(once, "parent is null")
        same = live.filter("kind = 'prop'").select("parent", "key", "val_json")
        made = distributed_rank(once.join(same, ["parent", "key", "val_json"], "left_anti"), ["parent", "key"], name="id").withColumn("id", F.col("id") + at)
        out.append(as_log(made.withColumn("kind", F.lit("prop"))))
    if not out:
        raise ValueError("nothing to write")
    new = out[0]
    for part in out[1:]:
        new = new.unionByName(part)
    return materialize(new, "new")


def deletions(history: DataFrame, ids: DataFrame) -> DataFrame:
    """The log rows that delete the live entries of ``ids`` (column ``id``), each once; any that is not live is an error."""
    asked = materialize(ids.select("id").distinct(), "doomed")
    live = history.filter("next is null and kind <> 'deletion'").select("id", F.lit(True).alias("live"))
    _complete(asked.join(live, "id", "left"), "live is null")
    at = next_id(history)
    ranked = distributed_rank(asked, ["id"], name="at").select((F.col("at") + at).alias("id"), F.lit("deletion").alias("kind"), F.col("id").alias("target"))
    return materialize(as_log(ranked), "deletions")


def chains(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` for ``written`` of ``chain``: arrays of (type, value), nodes and edges in turn, an odd number of them.

    A chain of an even number is an error, as is one with a null type.
    """
    whole = rows.select(F.monotonically_increasing_id().alias("_c"), "chain").filter("chain is not null")
    whole = materialize(whole, "chains")
    _complete(whole, "size(chain) % 2 = 0 or exists(chain, x -> x is null or x.type is null)")
    at = lambda i: F.element_at("chain", i)
    nodes = whole.select(F.posexplode("chain").alias("at", "x")).filter("at % 2 = 0").select("x.type", F.coalesce("x.value", F.lit("")).alias("value"))
    step = whole.filter("size(chain) > 2").select("chain", F.explode(F.sequence(F.lit(2), F.size("chain") - 1, F.lit(2))).alias("at"))
    a, e, b = at(F.col("at") - 1), at(F.col("at")), at(F.col("at") + 1)
    edges = step.select(
        a["type"].alias("src_type"), F.coalesce(a["value"], F.lit("")).alias("src_value"), b["type"].alias("tgt_type"), F.coalesce(b["value"], F.lit("")).alias("tgt_value"),
        e["type"].alias("type"), F.coalesce(e["value"], F.lit("")).alias("value"))
    return nodes.distinct(), edges.distinct()


def write(history: DataFrame, **tables: DataFrame) -> DataFrame:
    """The history after ``written``: old rows with their new ends, and the new ones."""
    rows, ends = delta(history, written(history, **tables))
    return with_ends(history, ends).unionByName(rows)


def depths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id`` and ``depth``: edges to the nearest seed, whatever their direction; nodes that none reaches are left out.

    The depths that a transaction's input gives where edges have no costs and none is deleted.
    """
    from lodegraph.algo.paths import hops

    both = edges.select(F.col("src").alias("id"), F.col("tgt").alias("nbr")).union(edges.select("tgt", "src"))
    return hops(both, seeds, 1 << 30).withColumnRenamed("hops", "depth")


def _complete(rows: DataFrame, missing: str) -> None:
    bad = rows.filter(missing).limit(1).collect()
    if bad:
        raise Missing(str(bad[0].asDict()))
