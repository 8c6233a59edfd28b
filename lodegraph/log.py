"""Views of a change log: what is live at any position, without replaying it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.schema import VALUES
from lodegraph.session import materialize


#: Running sums go by blocks of so many log positions, and by blocks of as many of those.
BLOCK = 1 << 16


def derive_next(log: DataFrame, nesting: int | None = None) -> DataFrame:
    """The log with ``next``: the id of the entry that ended each row, null while it lives.

    Ends follow from the rows themselves: a row ends with its own deletion; an edge also with
    the first of its ends; a property also with its successor under the same parent and
    key, and with its parent. Properties of properties take one more join for each level,
    until none is left (or ``nesting`` levels).
    """
    dead = log.filter("kind = 'deletion'").groupBy(F.col("target").alias("_dead")).agg(F.min("id").alias("_own"))
    own = log.join(dead, F.col("id") == F.col("_dead"), "left").drop("_dead")
    ends = own.filter("kind = 'node'").select(F.col("id").alias("_node"), F.col("_own").alias("_end")).filter("_end is not null")
    nodes = own.filter("kind = 'node'").withColumn("next", F.col("_own"))
    edges = own.filter("kind = 'edge'")
    for side in ("src", "tgt"):
        edges = edges.join(ends.select(F.col("_node").alias(f"_n{side}"), F.col("_end").alias(f"_e{side}")), F.col(side) == F.col(f"_n{side}"), "left").drop(f"_n{side}")
    edges = edges.withColumn("next", F.least("_own", "_esrc", "_etgt")).drop("_esrc", "_etgt")
    w = Window.partitionBy("parent", "key").orderBy("id")
    props = own.filter("kind = 'prop'").withColumn("_own", F.least("_own", F.lead("id").over(w)))
    done = nodes.unionByName(edges)
    parents = done.select(F.col("id").alias("_p"), F.col("next").alias("_pend"))
    first = props.join(parents, F.col("parent") == F.col("_p"), "left")
    out = done.unionByName(first.filter("parent = 0 or _p is not null").withColumn("next", F.least("_own", "_pend")).drop("_p", "_pend"))
    todo = first.filter("parent <> 0 and _p is null").drop("_p", "_pend")
    level = out.filter("kind = 'prop'")
    depth = 0
    while nesting is None or depth < nesting:
        todo = materialize(todo, "nested")
        if todo.isEmpty():
            break
        parents = level.select(F.col("id").alias("_p"), F.col("next").alias("_pend"))
        joined = materialize(todo.join(parents, F.col("parent") == F.col("_p"), "left"), "nested")
        level = joined.filter("_p is not null").withColumn("next", F.least("_own", "_pend")).drop("_p", "_pend")
        if level.isEmpty():
            break  # properties of what is no node, edge or property: never live
        out = out.unionByName(level)
        todo = joined.filter("_p is null").drop("_p", "_pend")
        depth += 1
    gone = own.filter("kind = 'deletion'").withColumn("next", F.lit(None).cast("long"))
    return out.unionByName(gone).drop("_own")


def delta(history: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What new log rows change: ``(rows, ends)``.

    ``history`` has ``next``; ``new`` are log rows of later positions. ``rows`` are the new
    rows with ``next``; ``ends`` has ``id`` and ``next`` of the old rows that they end. Nothing
    is derived again: only rows are looked at that a deletion or a superseding property
    of ``new`` reaches, over edges and properties, level by level. Both are written tables.
    """
    new = materialize(new, "arrived")
    old = history.filter("next is null and kind <> 'deletion'")
    doomed = new.filter("kind = 'deletion'").select(F.col("target").alias("id"))
    keys = new.filter("kind = 'prop'").select("parent", "key").distinct()
    replaced = old.filter("kind = 'prop'").join(keys, ["parent", "key"], "left_semi").select("id")
    front = materialize(old.join(doomed.union(replaced).distinct(), "id", "left_semi").select(*history.columns), "reached")
    reached = front
    while not front.isEmpty():
        nodes, ids = front.filter("kind = 'node'").select("id"), front.select("id")
        edges = old.filter("kind = 'edge'")
        # A write for each, so that the shuffle files of one join are gone when the next begins.
        below = materialize(edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").select(*history.columns), "below")
        below = below.unionByName(materialize(edges.join(nodes.withColumnRenamed("id", "tgt"), "tgt", "left_semi").select(*history.columns), "below"))
        below = below.unionByName(materialize(old.filter("kind = 'prop'").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").select(*history.columns), "below"))
        below = below.select(*history.columns).dropDuplicates(["id"])
        front = materialize(below.join(reached.select("id"), "id", "left_anti").select(*history.columns), "reached")
        reached = reached.union(front)
    # What these rows refer to and nothing ends stands in as a bare node.
    own = reached.select("id").union(new.select("id"))
    both = reached.select("parent", "src", "tgt").union(new.select("parent", "src", "tgt"))
    named = both.select(F.explode(F.array("parent", "src", "tgt")).alias("id")).filter("id > 0").distinct().join(own, "id", "left_anti")
    log = reached.drop("next").unionByName(new).unionByName(named.withColumn("kind", F.lit("node")), allowMissingColumns=True)
    done = materialize(derive_next(log).join(named, "id", "left_anti").select(*history.columns), "derived")
    arrived = done.join(new.select("id"), "id", "left_semi")
    ends = done.join(reached.select("id"), "id", "left_semi").filter("next is not null").select("id", "next")
    return arrived, ends


def with_ends(history: DataFrame, ends: DataFrame) -> DataFrame:
    """``history`` with the ends of ``delta`` put in."""
    e = ends.groupBy("id").agg(F.min("next").alias("_end"))
    return history.join(e, "id", "left").withColumn("next", F.coalesce("next", "_end")).select(*history.columns)


def advance(history: DataFrame, new: DataFrame) -> DataFrame:
    """The history with new log rows."""
    rows, ends = delta(history, new)
    return with_ends(history, ends).unionByName(rows)


def live(before: int | None) -> Column:
    """What a view sees: rows before position ``before`` that no row before it ended."""
    ended = F.col("next").isNull()
    if before is None:
        return ended
    return (F.col("id") < before) & (ended | (F.col("next") >= before))


@dataclass(frozen=True)
class View:
    """The graph as of a position: ``nodes``, ``edges``, ``props``, and what follows from them."""

    history: DataFrame
    before: int | None = None

    @cached_property
    def _seen(self) -> DataFrame:
        return self.history.filter(live(self.before))

    @cached_property
    def nodes(self) -> DataFrame:
        return self._seen.filter("kind = 'node'").select("id", "type", "value")

    @cached_property
    def edges(self) -> DataFrame:
        return self._seen.filter("kind = 'edge'").select("id", "type", "value", "src", "tgt")

    @cached_property
    def props(self) -> DataFrame:
        return self._seen.filter("kind = 'prop'").select("id", "parent", "key", *VALUES)

    @cached_property
    def incidence(self) -> DataFrame:
        """``node``, ``edge``, ``other``, ``type``, ``out``: two rows per edge, one per self-loop."""
        return incidence(self.edges)

    def counts(self) -> DataFrame:
        """One row: live ``nodes`` and ``edges``."""
        return self._seen.agg(F.count_if(F.col("kind") == "node").alias("nodes"), F.count_if(F.col("kind") == "edge").alias("edges"))


def incidence(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("src").alias("node"), F.col("id").alias("edge"), F.col("tgt").alias("other"), "type", F.lit(True).alias("out"), (F.col("src") == F.col("tgt")).alias("loop"))
    b = edges.filter("src <> tgt").select(F.col("tgt").alias("node"), F.col("id").alias("edge"), F.col("src").alias("other"), "type", F.lit(False).alias("out"), F.lit(False).alias("loop"))
    return a.union(b)


def entry(history: DataFrame, id_: int) -> DataFrame:
    """Any row by its id, live or not."""
    return history.filter(F.col("id") == id_)


def span(history: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of positions ``start`` <= id < ``end``, live or not, in order."""
    return history.filter((F.col("id") >= start) & (F.col("id") < end)).orderBy("id")


def edge_lookup(view: View, src: int, tgt: int, type_: str, value: str = "") -> DataFrame:
    """The live edge with these ends, type and value: at most one row."""
    return view.edges.filter((F.col("src") == src) & (F.col("tgt") == tgt) & (F.col("type") == type_) & (F.col("value") == value))


def edges_ended_by(history: DataFrame, deletion: int) -> DataFrame:
    """The edges that one deletion ended, its own target or those of its node."""
    return history.filter((F.col("kind") == "edge") & (F.col("next") == deletion)).select("id", "type", "value", "src", "tgt")


def strings(history: DataFrame) -> DataFrame:
    """``string`` and ``string_id``: every type, value and key of the log numbered from 1 in their order; the empty string is 0."""
    from lodegraph.operators.skew import distributed_rank

    every = history.select(F.explode(F.array("type", "value", "key")).alias("string")).filter("string is not null").distinct()
    ranked = distributed_rank(every.filter("string <> ''"), ["string"], name="string_id").withColumn("string_id", F.col("string_id") + 1)
    return ranked.unionByName(every.filter("string = ''").withColumn("string_id", F.lit(0).cast("long")))


def next_id(log: DataFrame) -> int:
    return (log.agg(F.max("id").alias("m")).first().m or 0) + 1


def update_ids(history: DataFrame, before: int | None = None) -> DataFrame:
    """``id`` and ``updated``: the greatest position that changed an entry or its direct properties.

    Creations and ends count, ends only before the view's position; the graph itself has id 0.
    """
    h = history.filter("kind <> 'deletion'")
    if before is not None:
        h = h.filter(F.col("id") < before)
    end = F.when(F.lit(True) if before is None else F.col("next") < before, F.col("next"))
    own = h.select("id", F.greatest("id", end).alias("u"))
    below = h.filter("kind = 'prop'").select(F.col("parent").alias("id"), F.greatest("id", end).alias("u"))
    return own.union(below).groupBy("id").agg(F.max("u").alias("updated"))


def log_commits(log: DataFrame, ends: DataFrame) -> DataFrame:
    """Live counts at the end of each commit: ``end``, ``nodes``, ``edges`` (``ends`` has ``end``, the last id of each).

    Births and deaths are summed once over all rows and read off at each end, instead of
    one scan for each commit. ``log`` may have ``next`` already.
    """
    history = (log if "next" in log.columns else derive_next(log)).filter("kind in ('node', 'edge')")
    born = history.select(F.col("id").alias("at"), F.when(F.col("kind") == "node", 1).otherwise(0).alias("n"), F.when(F.col("kind") == "edge", 1).otherwise(0).alias("e"))
    moves = born.union(history.filter("next is not null").select("next", F.when(F.col("kind") == "node", -1).otherwise(0), F.when(F.col("kind") == "edge", -1).otherwise(0)))
    marks = ends.select(F.col("end").cast("long").alias("at")).distinct().withColumn("mark", F.lit(True))
    both = moves.groupBy("at").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).join(marks, "at", "full")
    # Sums run within blocks of positions, and over the sums of the blocks before.
    both = both.select("at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("e", F.lit(0)).alias("e"), "mark", F.floor(F.col("at") / BLOCK).alias("_b"))
    both = materialize(both, "moves")
    blocks = both.groupBy("_b").agg(F.sum("n").alias("bn"), F.sum("e").alias("be"))
    over = Window.partitionBy(F.floor(F.col("_b") / BLOCK)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = blocks.groupBy(F.floor(F.col("_b") / BLOCK).alias("_t")).agg(F.sum("bn").alias("tn"), F.sum("be").alias("te"))
    top = Window.partitionBy(F.lit(0)).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)  # one row for BLOCK * BLOCK positions
    whole = whole.select("_t", F.coalesce(F.sum("tn").over(top), F.lit(0)).alias("tn"), F.coalesce(F.sum("te").over(top), F.lit(0)).alias("te"))
    blocks = blocks.select("_b", F.floor(F.col("_b") / BLOCK).alias("_t"), F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("bn"), F.coalesce(F.sum("be").over(over), F.lit(0)).alias("be")).join(whole, "_t")
    run = Window.partitionBy("_b").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = both.withColumn("n", F.sum("n").over(run)).withColumn("e", F.sum("e").over(run)).filter("mark").join(blocks, "_b")
    return summed.select(F.col("at").alias("end"), (F.col("n") + F.col("bn") + F.col("tn")).alias("nodes"), (F.col("e") + F.col("be") + F.col("te")).alias("edges"))
