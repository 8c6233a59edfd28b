"""Standing queries: the log positions at which a pattern starts to match.

No position is replayed. For each slot the spans of positions in which an object
matches are computed at once; a chain holds where the spans of its slots overlap, and
is reported where that overlap begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph import natives
from lodegraph.lgql.compiler import Chain, as_chain
from lodegraph.lgql.parser import Filter, Pattern, parse
from lodegraph.lgql.predicates import constant, holds, native, number, properties

#: Beyond every position: the end of what has not ended.
OPEN = (1 << 63) - 1
#: Running sums go by blocks of so many log positions, so that a hub's edges are spread.
BLOCK = 1 << 18


def _spans(history: DataFrame, kind: str) -> DataFrame:
    return history.filter(F.col("kind") == kind).withColumn("t", F.coalesce("next", F.lit(OPEN))).withColumn("f", F.col("id"))


def islands(spans: DataFrame, key: str = "obj") -> DataFrame:
    """Spans of a key that touch or overlap, as one."""
    w = Window.partitionBy(key).orderBy("f", "t")
    new = F.when(F.col("f") > F.max("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    marked = spans.select(key, "f", "t", new.alias("_new")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_island").agg(F.min("f").alias("f"), F.max("t").alias("t")).drop("_island")


def counted(starts: DataFrame, moves: DataFrame, passes: Column) -> DataFrame:
    """Spans in which a running count passes: ``obj``, ``f``, ``t``.

    ``starts`` has ``obj`` and its first position ``at`` and last ``t``; ``moves`` the changes ``d`` of the count at ``at``.
    ``passes`` reads the count from the column ``n``.
    """
    zero = starts.select("obj", "at", F.lit(0).alias("d"))
    m = zero.union(moves.select("obj", "at", "d")).groupBy("obj", "at").agg(F.sum("d").alias("d"))
    m = m.withColumn("_block", F.floor(F.col("at") / BLOCK))
    blocks = m.groupBy("obj", "_block").agg(F.sum("d").alias("_sum"), F.min("at").alias("_first"))
    over = Window.partitionBy("obj").orderBy("_block")
    before = F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("obj", "_block", before.alias("_before"), F.lead("_first").over(over).alias("_later"))
    w = Window.partitionBy("obj", "_block").orderBy("at")
    run = m.withColumn("_run", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_then", F.lead("at").over(w))
    run = run.join(blocks, ["obj", "_block"]).select("obj", "at", (F.col("_run") + F.col("_before")).alias("n"), F.coalesce("_then", "_later").alias("_then"))
    ends = starts.select("obj", "t")
    return run.join(ends, "obj").filter(F.coalesce(passes, F.lit(False))).select("obj", F.col("at").alias("f"), F.least(F.coalesce("_then", F.lit(OPEN)), "t").alias("t")).filter("f < t")


def _degree_moves(history: DataFrame, field: str) -> DataFrame:
    e = _spans(history, "edge")
    both = e.select(F.explode(F.array_distinct(F.array("src", "tgt"))).alias("obj"), "f", "t")
    ends = {"edge_count": both, "inbound_count": e.select(F.col("tgt").alias("obj"), "f", "t"), "outbound_count": e.select(F.col("src").alias("obj"), "f", "t")}[field]
    return _moves(ends)


def _moves(spans: DataFrame) -> DataFrame:
    up = spans.select("obj", F.col("f").alias("at"), F.lit(1).alias("d"))
    return up.union(spans.filter(F.col("t") < OPEN).select("obj", F.col("t").alias("at"), F.lit(-1).alias("d")))


def _neighbour_moves(history: DataFrame, type_: str | None) -> DataFrame:
    e = _spans(history, "edge").filter("src <> tgt")
    pairs = e.select(F.col("src").alias("obj"), F.col("tgt").alias("other"), "f", "t").union(e.select("tgt", "src", "f", "t"))
    if type_ is not None:
        of = history.filter((F.col("kind") == "node") & (F.col("type") == type_)).select(F.col("id").alias("other"))
        pairs = pairs.join(of, "other", "left_semi")
    joined = islands(pairs.select(F.struct("obj", "other").alias("pair"), "f", "t"), "pair")
    return _moves(joined.select(F.col("pair.obj").alias("obj"), "f", "t"))


def filter_spans(history: DataFrame, kind: str, f: Filter) -> DataFrame | Column:
    """Where a filter holds: spans (``obj``, ``f``, ``t``), or a column if it never changes for an object."""
    first = f.path[0]
    if kind == "e" and first in ("src", "tgt") and len(f.path) > 1:
        inner = object_spans(history, "n", [Filter(f.path[1:], f.test)]).select("id", "f", "t")
        e = history.filter("kind = 'edge'").select(F.col("id").alias("obj"), F.col(first).alias("_end"))
        return e.join(inner, F.col("_end") == F.col("id")).select("obj", "f", "t")
    n = native(kind, f.path)
    if n is None:
        p = properties(_spans(history, "prop"), f)
        return p.select(F.col("parent").alias("obj"), "f", "t")
    if n.constant is not None:
        return constant(f, n.constant)
    starts = _spans(history, "node").select(F.col("id").alias("obj"), F.col("id").alias("at"), "t")
    passes = holds(f.test, number(F.col("n")))
    if n.name == "neighbor_types":
        return counted(starts, _neighbour_moves(history, f.path[1]), passes & (F.col("n") > 0))
    moves = _neighbour_moves(history, None) if n.name in natives.NEIGHBOURS else _degree_moves(history, n.name)
    return counted(starts, moves, passes)


def object_spans(history: DataFrame, kind: str, filters: Sequence[Filter]) -> DataFrame:
    """Nodes or edges with the maximal spans in which they live and pass all filters: ``id`` .. and ``f``, ``t``."""
    columns = ["id", "type", "value", *(("src", "tgt") if kind == "e" else ())]
    rows = _spans(history, "node" if kind == "n" else "edge").select(*columns, "f", "t")
    changing = False
    for flt in filters:
        s = filter_spans(history, kind, flt)
        if isinstance(s, Column):
            rows = rows.filter(s)
            continue
        changing = True
        s = s.select(F.col("obj").alias("_obj"), F.col("f").alias("_f"), F.col("t").alias("_t"))
        rows = rows.join(s, F.col("id") == F.col("_obj")).select(
            *columns, F.greatest("f", "_f").alias("f"), F.least("t", "_t").alias("t")).filter("f < t")
    if not changing:
        return rows
    whole = islands(rows.select(F.col("id").alias("obj"), "f", "t"))
    return rows.select(*columns).distinct().join(whole, F.col("id") == F.col("obj")).drop("obj")


def standing(history: DataFrame, texts: Sequence[str], start: int = 1, stop: int | None = None) -> DataFrame:
    """``pattern``, ``at`` and ``chain``: every chain at each position from which it matches anew.

    ``history`` is a log with ``next``. Positions run from ``start`` to ``stop``, both included. A chain is reported once for a
    pattern, position and kept ids, and again when it matches after a gap; deletions
    can report too. Values of the chain are those of its entries.
    """
    out = None
    for n, text in enumerate(texts):
        part = _standing(history, n, parse(text), start, stop)
        out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("no pattern")
    return out


def relevant(history: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """The log without the properties that no filter names: they cannot change a match."""
    keys = set()
    for p in patterns:
        for s in p.slots:
            for f in s.filters:
                path = f.path[1:] if s.kind == "e" and f.path[0] in ("src", "tgt") and len(f.path) > 1 else f.path
                keys.add(path[0])
    return history.filter((F.col("kind") != "prop") | F.col("key").isin(*keys) if keys else F.col("kind") != "prop")


def _standing(history: DataFrame, n: int, p: Pattern, start: int, stop: int | None) -> DataFrame:
    history = relevant(history, [p])
    if stop is not None:
        history = history.filter(F.col("id") <= stop)

    def overlap(df: DataFrame, i: int) -> DataFrame:
        if f"s{i}_f" not in df.columns:
            return df
        f, t = F.col(f"s{i}_f"), F.col(f"s{i}_t")
        if "_f" in df.columns:
            f, t = F.greatest("_f", f), F.least("_t", t)
        return df.withColumn("_f", f).withColumn("_t", t).filter("_f < _t").drop(f"s{i}_f", f"s{i}_t")

    bare = lambda i: p.slots[i].kind == "n" and not p.slots[i].keep and not p.slots[i].filters
    df = Chain(p, lambda i: object_spans(history, p.slots[i].kind, p.slots[i].filters), bare, overlap).build()
    within = F.col("_f") >= start
    df = df.filter(within if stop is None else within & (F.col("_f") <= stop))
    return df.select(F.lit(n).alias("pattern"), F.col("_f").alias("at"), F.array(*[as_chain(p, i) for i in p.kept]).alias("chain")).distinct()
