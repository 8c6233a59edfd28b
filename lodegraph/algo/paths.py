"""Reachability and cheapest paths, by rounds of joins with the frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import materialize

#: A path counts as near the cheapest if it is at most this part dearer.
NEAR = 0.1


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``id`` and ``hops`` of everything at most ``depth`` edges from the seeds.

    ``edges`` has ``id`` and ``nbr``, walked from id to nbr; ``seeds`` has ``id``. Each round joins
    only the last layer, and what it finds is set against all that is known.
    """
    e = edges.select("id", "nbr").dropna().distinct()
    seen = materialize(seeds.select("id").dropna().distinct().withColumn("hops", F.lit(0)), "hops")
    layer = seen
    for d in range(1, depth + 1):
        found = layer.select("id").join(e, "id").select(F.col("nbr").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        layer = materialize(found.withColumn("hops", F.lit(d)), "layer")
        if layer.isEmpty():
            break
        seen = seen.union(layer)
    return seen


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every node connected to the seeds, whatever the direction of the edges: ``id``. Seeds without edges are included."""
    from lodegraph.algo.components import spanning_forest

    labels, _ = spanning_forest(edges, "id", "nbr")
    s = seeds.select("id").dropna().distinct()
    roots = labels.join(s.withColumnRenamed("id", "node"), "node", "left_semi").select("root").distinct()
    return labels.join(roots, "root", "left_semi").select(F.col("node").alias("id")).union(s).distinct()


def costs(edges: DataFrame, degrees: DataFrame, source: int, bound: float | None = None) -> DataFrame:
    """``id``, ``cost`` and ``via`` (the node before) of the cheapest path from ``source`` to each node.

    Passing through a node costs ln(1 + degree); the two ends of a path are free.
    ``degrees`` has ``id`` and ``degree``. With ``bound``, only paths up to that cost. Each round relaxes
    the edges of the nodes that improved in the last one.
    """
    spark = edges.sparkSession
    e = edges.select("id", "nbr").dropna().distinct()
    w = degrees.select("id", F.log1p(F.col("degree").cast("double")).alias("w"))
    e = materialize(e.join(w, "id", "left").select("id", "nbr", F.when(F.col("id") == source, 0.0).otherwise(F.coalesce("w", F.lit(0.0))).alias("w")), "weighted")
    best = materialize(spark.createDataFrame([(source, 0.0, None)], "id long, cost double, via long"), "best")
    front = best
    while True:
        step = front.select("id", "cost").join(e, "id").select(F.col("nbr").alias("id"), (F.col("cost") + F.col("w")).alias("_c"), F.col("id").alias("_v"))
        if bound is not None:
            step = step.filter(F.col("_c") <= bound)
        step = step.groupBy("id").agg(F.min(F.struct("_c", "_v")).alias("_s"))
        old = best.select("id", F.col("cost").alias("_old"))
        front = materialize(step.join(old, "id", "left").filter("_old is null or _s._c < _old").select("id", F.col("_s._c").alias("cost"), F.col("_s._v").alias("via")), "front")
        if front.isEmpty():
            return best
        best = materialize(front.union(best.join(front.select("id"), "id", "left_anti")), "best")


def cheapest_path(edges: DataFrame, degrees: DataFrame, a: int, b: int) -> tuple[float, int, list[int]] | None:
    """Cost, widest degree passed and nodes of the cheapest path from ``a`` to ``b``; None if there is none.

    The path is read back one node at a time, as many small lookups as it has nodes.
    """
    c = costs(edges, degrees, a).filter("via is not null or id = " + str(int(a)))
    end = c.filter(F.col("id") == b).first()
    if end is None:
        return None
    path = [b]
    while path[-1] != a:
        path.append(c.filter(F.col("id") == path[-1]).first().via)
    inner = path[1:-1]
    widest = degrees.filter(F.col("id").isin(inner)).agg(F.max("degree").alias("m")).first().m if inner else 0
    return end.cost, int(widest or 0), path


def path_slack(edges: DataFrame, degrees: DataFrame, a: int, b: int, best: float) -> DataFrame:
    """``id`` and ``slack`` of nodes on paths from ``a`` to ``b`` that cost at most ``NEAR`` more than ``best``.

    The slack is how much dearer, as a part of ``best``, the cheapest path through the node is; the ends have 0.
    """
    limit = best * (1 + NEAR) + 1e-9
    one = costs(edges, degrees, a, limit).select("id", F.col("cost").alias("ca"))
    two = costs(edges, degrees, b, limit).select("id", F.col("cost").alias("cb"))
    through = one.join(two, "id").join(degrees.select("id", "degree"), "id", "left")
    t = F.col("ca") + F.col("cb") + F.log1p(F.coalesce("degree", F.lit(0)).cast("double"))
    inner = through.withColumn("t", t).filter((F.col("t") <= limit) & ~F.col("id").isin(a, b))
    slack = F.greatest(F.col("t") / best - 1.0, F.lit(0.0)) if best > 0 else F.lit(0.0)
    ends = edges.sparkSession.createDataFrame([(x, 0.0) for x in {a, b}], "id long, slack double")
    return inner.select("id", slack.alias("slack")).union(ends)


def joining(written: DataFrame, degrees: DataFrame, a: int, b: int) -> tuple[float, int, DataFrame] | None:
    """The cheapest path along written edges (``x``, ``y``, ``rel``), and those edges that lie on it."""
    both = written.select(F.col("x").alias("id"), F.col("y").alias("nbr")).union(written.select("y", "x"))
    found = cheapest_path(both, degrees, a, b)
    if found is None:
        return None
    cost, widest, path = found
    on = {(min(p), max(p)) for p in zip(path, path[1:], strict=False)}
    pairs = written.sparkSession.createDataFrame(sorted(on), "_x long, _y long")
    keep = (F.least("x", "y") == F.col("_x")) & (F.greatest("x", "y") == F.col("_y"))
    return cost, widest, written.join(F.broadcast(pairs), keep, "left_semi")  # as many rows as the path has edges


def shared_with_target(adj: DataFrame, attrs: DataFrame, seed: int, rel: int, key: str, value: str) -> DataFrame:
    """``id`` of the seed, and of the entities and their members through which it shares one with a member that has an attribute."""
    r = adj.filter((F.col("rel") == rel) & F.col("nbr").isNotNull()).select("id", "nbr").distinct()
    mine = r.filter(F.col("id") == seed).select(F.col("nbr").alias("e"))
    has = attrs.filter((F.col("key") == key) & (F.col("value") == value)).select(F.col("id").alias("o"))
    hit = mine.join(r.select(F.col("id").alias("e"), F.col("nbr").alias("o")), "e").filter(F.col("o") != seed).join(has, "o", "left_semi")
    s = adj.sparkSession.createDataFrame([(seed,)], "id long")
    return hit.select(F.explode(F.array("e", "o")).alias("id")).union(s).distinct()
