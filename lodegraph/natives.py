"""Fields that nodes have by their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.log import View

COUNTS = ("edge_count", "inbound_count", "outbound_count")
NEIGHBOURS = ("neighbor_count",)
LISTS = ("edges", "edgeIDs", "inbound", "inboundIDs", "outbound", "outboundIDs", "neighbors", "neighborIDs")


def degrees(view: View) -> DataFrame:
    """``id``, ``edge_count``, ``inbound_count``, ``outbound_count`` of every node; a self-loop is one edge, in and out."""
    by = view.incidence.groupBy("node").agg(
        F.count("*").alias("edge_count"), F.count_if(~F.col("out") | F.col("loop")).alias("inbound_count"), F.count_if("out").alias("outbound_count"))
    return _every(view, by, {c: F.lit(0) for c in COUNTS})


def neighbours(view: View) -> DataFrame:
    """``id``, ``neighbor_count`` and ``neighbors``, the ids of other nodes it shares an edge with, in order."""
    sets = view.incidence.filter("node <> other").groupBy("node").agg(F.array_sort(F.collect_set("other")).alias("neighbors"))
    by = sets.select("node", F.size("neighbors").cast("long").alias("neighbor_count"), "neighbors")
    return _every(view, by, {"neighbor_count": F.lit(0), "neighbors": F.array().cast("array<bigint>")})


def neighbour_counts(view: View) -> DataFrame:
    """As ``neighbours``, without the lists: hubs cost no more than other nodes."""
    by = view.incidence.filter("node <> other").select("node", "other").distinct().groupBy("node").agg(F.count("*").alias("neighbor_count"))
    return _every(view, by, {"neighbor_count": F.lit(0)})


def neighbour_types(view: View) -> DataFrame:
    """``id``, ``type``, ``n``: distinct neighbours of each type, one row for each type that occurs."""
    pairs = view.incidence.filter("node <> other").select("node", "other").distinct()
    types = view.nodes.select(F.col("id").alias("other"), F.col("type").alias("_t"))
    return pairs.join(types, "other").groupBy("node", "_t").agg(F.count("*").alias("n")).select(F.col("node").alias("id"), F.col("_t").alias("type"), "n")


def edge_lists(view: View) -> DataFrame:
    """``id``, ``edges``, ``inbound``, ``outbound``: ids of a node's edges, inbound first, each by type and id; a self-loop once."""
    # One list a node; what comes in and what goes out are parts of it, in its order.
    item = F.struct((F.col("out") & ~F.col("loop")).alias("o"), F.col("type").alias("t"), F.col("edge").alias("e"), F.col("loop").alias("l"))
    ids = lambda c: F.transform(c, lambda s: s["e"])
    all_ = view.incidence.groupBy("node").agg(F.array_sort(F.collect_list(item)).alias("all"))
    by = all_.select("node", ids("all").alias("edges"), ids(F.filter("all", lambda s: ~s["o"])).alias("inbound"), ids(F.filter("all", lambda s: s["o"] | s["l"])).alias("outbound"))
    none = F.array().cast("array<bigint>")
    return _every(view, by, {"edges": none, "inbound": none, "outbound": none})


def _every(view: View, by: DataFrame, empty: dict) -> DataFrame:
    out = view.nodes.select("id").join(by, F.col("id") == F.col("node"), "left").drop("node")
    return out.select("id", *[F.coalesce(F.col(c), v).alias(c) for c, v in empty.items()])
