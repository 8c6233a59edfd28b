"""Train, validation and test splits that keep everything related together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.algo.components import spanning_forest
from lodegraph.operators.skew import distributed_rank, salted_join
from lodegraph.session import materialize

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def name_key(c: Column) -> Column:
    """A run or task name without the ways of writing it: words and numbers joined by dots.

    Case, separators and leading zeros vanish; an empty name is null.
    """
    c = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ".")
    c = F.regexp_replace(F.regexp_replace(c, r"(\p{L})(?=\p{N})", "$1."), r"(\p{N})(?=\p{L})", "$1.")
    c = F.regexp_replace(F.trim(c, F.lit(".")), r"(^|\.)0+(?=\p{N})", "$1")
    return F.nullif(c, F.lit(""))


def task_of_run(run_key: Column) -> Column:
    """The task that a run names: its first three parts (kind, word, number)."""
    return F.nullif(F.substring_index(run_key, ".", 3), F.lit(""))


def anchors(batches: DataFrame, tasks: DataFrame, forest_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Every policy call with the smallest call it must share a split with.

    Gives ``(calls, forest)``: ``calls`` has ``grp`` and ``anchor`` for each distinct
    non-null ``grp``; ``forest`` holds the edges (``a``, ``b``) of the spanning forest by
    which calls were joined, and is written to ``forest_path`` if one is given, for the caller to keep. Calls belong together by the same run, the same task (a
    missing one is named by the run) or tasks with a common non-null seed, also if the
    seeds lead on through a task that has no call. In the forest such a task is a node
    beyond the greatest call. Null and empty names and null seeds join nothing.
    Repeated rows, and a call that is logged with several names, are one call.

    Calls with the same run and task are one node from the start, so a run that owns a
    third of the rows is a single row of the graph. Every run, task and seed joins its
    members to the smallest of them, never pair by pair.
    """
    rows = batches.select(F.col("grp").cast("long").alias("grp"), name_key(F.col("run")).alias("r"), name_key(F.col("task")).alias("t"))
    rows = rows.filter("grp is not null").withColumn("t", F.coalesce("t", task_of_run(F.col("r"))))
    rows = rows.select("grp", F.coalesce("r", F.lit("")).alias("r"), F.coalesce("t", F.lit("")).alias("t")).distinct()
    # A call without any name is its own unit.
    rows = materialize(rows.withColumn("own", F.when((F.col("r") == "") & (F.col("t") == ""), F.col("grp"))), "calls")
    units = materialize(rows.groupBy("r", "t", "own").agg(F.min("grp").alias("rep")), "units")
    unit_of = rows.filter("own is null")
    named = salted_join(unit_of.select("r", "t", "grp"), units.filter("own is null").select("r", "t", "rep"), ["r", "t"], [F.col("grp")])
    calls = materialize(named.select("grp", "rep").union(rows.filter("own is not null").select("grp", F.col("own").alias("rep"))), "calls")
    several = calls.groupBy("grp").agg(F.min("rep").alias("a"), F.max("rep").alias("m")).filter("a <> m")
    edges = [several.join(calls, "grp").select("a", F.col("rep").alias("b"))]
    keys = units.select("rep", F.explode(F.array(F.concat(F.lit("r:"), "r"), F.concat(F.lit("t:"), "t"))).alias("k")).filter("length(k) > 2")
    seeds = tasks.select(name_key(F.col("task")).alias("t"), F.explode("seeds").alias("seed")).dropna().distinct()
    task_rep = units.filter("t <> ''").groupBy("t").agg(F.min("rep").alias("rep"))
    seeds = materialize(seeds, "seeds")
    # Tasks without a call are nodes too, numbered behind all calls, so that no component has one for its smallest.
    idle = seeds.select("t").distinct().join(task_rep, "t", "left_anti")
    beyond = (rows.agg(F.max("grp").alias("m")).first().m or 0) + 1
    idle = distributed_rank(idle, ["t"], name="rep").withColumn("rep", F.col("rep") + beyond)
    seeded = seeds.join(task_rep.union(idle), "t").select("rep", F.concat(F.lit("s:"), F.col("seed").cast("string")).alias("k"))
    keys = materialize(keys.union(seeded).distinct(), "keys")
    least = keys.groupBy("k").agg(F.min("rep").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    edges.append(salted_join(keys, least, ["k"], [F.col("rep")]).select("a", F.col("rep").alias("b")))
    labels, forest = spanning_forest(edges[0].union(edges[1]).filter("a <> b"), forest_path=forest_path)
    rooted = calls.groupBy("grp").agg(F.min("rep").alias("rep"))
    out = rooted.join(labels, rooted.rep == labels.node, "left").select("grp", F.coalesce("root", "rep").alias("anchor"))
    return materialize(out, "anchors"), forest


def assign_splits(calls: DataFrame, splits: Sequence[tuple[str, float]] = SPLITS, salt: str = "", giant: float = 0.01) -> DataFrame:
    """``grp``, ``anchor`` and ``split`` for calls with their anchors.

    Components are put into bands by the power of two of their size, ordered by a hash
    inside each band, and dealt: the one at place k of its band takes the split in whose
    part of the unit interval (k + offset) * golden ratio lies, which keeps every
    stretch of places close to the proportions. Components of more than ``giant`` of all
    calls, of which there are fewer than 1 / ``giant``, go one by one, largest first, to
    the split that then lacks most. Equal inputs give equal splits, in any row order.
    An empty input gives an empty result.
    """
    total = sum(p for _, p in splits)
    if not splits or any(p < 0 for _, p in splits) or total <= 0:
        raise ValueError("proportions must be positive")
    calls = calls.select("grp", "anchor")
    sizes = materialize(calls.groupBy("anchor").agg(F.count("*").alias("size")), "sizes")
    n = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    large = sizes.filter(F.col("size") > n * giant).orderBy(F.desc("size"), "anchor").limit(int(1 / giant) + 1).collect()
    want = {s: p / total * n for s, p in splits}
    dealt = []
    for row in large:
        s = max(want, key=lambda k: want[k])
        want[s] -= row["size"]
        dealt.append((row["anchor"], s))
    rest = sizes.filter(F.col("size") <= n * giant)
    band = F.floor(F.log2("size")).cast("int")
    rest = rest.select("anchor", band.alias("band"), F.xxhash64(F.lit(salt), F.col("anchor")).alias("h"))
    ranked = distributed_rank(rest, ["h", "anchor"], ["band"], "k")
    # Proportions of what the large components left over.
    lacking = sum(max(0.0, x) for x in want.values()) or 1.0
    u = ((F.col("k") + F.pmod(F.hash(F.lit(salt), F.col("band")), F.lit(1000))) * 0.6180339887498949) % 1.0
    pick, upto = F.lit(splits[-1][0]), 1.0
    for s, _ in reversed(splits[:-1]):
        upto = sum(max(0.0, want[x]) for x, _ in splits[: [y for y, _ in splits].index(s) + 1]) / lacking
        pick = F.when(u < upto, F.lit(s)).otherwise(pick)
    spark = calls.sparkSession
    chosen = ranked.select("anchor", pick.alias("split")).union(spark.createDataFrame(dealt, "anchor long, split string"))
    return calls.join(materialize(chosen, "splits"), "anchor").select("grp", "anchor", "split")
