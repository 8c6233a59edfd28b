"""Connected components by Borůvka contraction, with the spanning forest it builds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import materialize


def spanning_forest(edges: DataFrame, a: str = "a", b: str = "b", forest_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Components of an undirected graph: ``(labels, forest)``.

    ``labels`` has ``node`` and ``root``, the smallest node of its component, for every
    node with an edge (self-loops and rows with a null end add nothing, repeats and both directions of
    an edge are one); ``forest`` has the edges ``a`` < ``b`` that join each component.
    Both are written tables, the forest in ``forest_path`` if one is given (an existing one is an
    error). Node ids are bigint; other columns are ignored.

    Each round every component takes its least outgoing edge in the order of (a, b);
    as that order is strict, the taken edges form no cycle but the two ends of one
    edge. Trees are flattened by pointer jumping, edges relabelled, inner and parallel
    ones dropped. The number of components with edges at least halves, so rounds are
    logarithmic. Joins have one row per component on one side; a hub on the other is
    split by adaptive skew joins, which the write that follows each join allows.
    """
    e = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).filter("x is not null and y is not null and x <> y")
    e = e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    live = materialize(e.select(F.col("a").alias("u"), F.col("b").alias("v"), "a", "b"), "edges")
    spark = edges.sparkSession
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    forest = live.select("a", "b").limit(0)
    steps: list[DataFrame] = []
    while not live.isEmpty():
        ends = live.select("u", "v", "a", "b").union(live.select("v", "u", "a", "b"))
        least = ends.groupBy("u").agg(F.min(F.struct("a", "b", "v")).alias("w"))
        taken = materialize(least.select("u", F.col("w.v").alias("p"), F.col("w.a").alias("a"), F.col("w.b").alias("b")), "taken")
        forest = forest.union(taken.select("a", "b").distinct())
        up = taken.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
        # Two ends that took the same edge point at each other: the smaller is the root.
        tree = taken.join(up, taken.p == up._u).select(
            "u", F.when((F.col("_p") == F.col("u")) & (F.col("u") < F.col("p")), F.col("u")).otherwise(F.col("p")).alias("p"))
        tree = materialize(tree, "tree")
        while True:
            # Two jumps a round: every node then points four times as far as before.
            up = tree.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
            once = tree.join(up, tree.p == up._u).select("u", F.col("_p").alias("p"), (F.col("_p") != F.col("p")).alias("moved"))
            over = once.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
            jumped = materialize(once.join(over, once.p == over._u).select("u", F.col("_p").alias("p"), "moved"), "tree")
            tree = jumped.select("u", "p")
            if jumped.filter("moved").isEmpty():
                break
        steps.append(tree)
        p1, p2 = tree.select(F.col("u").alias("_u"), F.col("p").alias("_pu")), tree.select(F.col("u").alias("_v"), F.col("p").alias("_pv"))
        moved = live.join(p1, live.u == F.col("_u")).join(p2, F.col("v") == F.col("_v")).filter("_pu <> _pv")
        parallel = moved.groupBy(F.least("_pu", "_pv").alias("u"), F.greatest("_pu", "_pv").alias("v")).agg(F.min(F.struct("a", "b")).alias("w"))
        live = materialize(parallel.select("u", "v", F.col("w.a").alias("a"), F.col("w.b").alias("b")), "edges")
    labels = nodes.withColumn("root", F.col("node"))
    for tree in steps:
        labels = labels.join(tree, labels.root == tree.u, "left").select("node", F.coalesce("p", "root").alias("root"))
    labels = materialize(labels, "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("_min"))
    labels = materialize(labels.join(least, "root").select("node", F.col("_min").alias("root")), "labels")
    if forest_path is None:
        return labels, materialize(forest, "forest")
    forest.write.parquet(forest_path)
    return labels, spark.read.schema(forest.schema).parquet(forest_path)
