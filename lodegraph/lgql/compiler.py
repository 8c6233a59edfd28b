"""Patterns as joins: each slot a filtered table, each hop an equi-join."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.lgql.parser import Pattern, parse
from lodegraph.lgql.predicates import narrow
from lodegraph.log import View


def slot_rows(view: View, pattern: Pattern, i: int) -> DataFrame:
    slot = pattern.slots[i]
    rows = view.nodes if slot.kind == "n" else view.edges
    # Filters on the row's own columns first: they reach the scan.
    own = {"ID", "type", "value", "srcID", "tgtID"}
    for f in sorted(slot.filters, key=lambda f: f.path[0] not in own):
        rows = narrow(view, slot.kind, rows, f)
    return rows


class Chain:
    """Joins the slots of a pattern, from the seed outwards.

    ``rows(i)`` gives slot i with ``id`` and, for edges, ``src`` and ``tgt``; other columns
    travel along as ``s{i}_{name}``. A node slot that is neither kept nor filtered is the
    end of an edge, and an edge's ends are live, so it needs no join. ``after`` may
    narrow the rows once a slot has joined.
    """

    def __init__(self, pattern: Pattern, rows: Callable[[int], DataFrame], bare: Callable[[int], bool] | None = None, after: Callable[[DataFrame, int], DataFrame] | None = None):
        self.p, self.rows = pattern, rows
        self.bare = bare or (lambda i: False)
        self.after = after or (lambda df, i: df)

    def build(self) -> DataFrame:
        slots = self.p.slots
        lo = hi = self.p.seed
        df = self._prefixed(lo)
        done = [lo]
        df = self.after(df, lo)
        while lo > 0 or hi < len(slots) - 1:
            right = hi < len(slots) - 1 and (lo == 0 or self._next_filter(hi, 1) <= self._next_filter(lo, -1))
            i, j = (hi, hi + 1) if right else (lo, lo - 1)
            df = self._hop(df, i, j, slots[i].fwd if right else slots[i].bwd)
            if slots[j].unique:
                for k in done:
                    if slots[k].unique and slots[k].kind == slots[j].kind:
                        df = df.filter(F.col(f"s{k}_id") != F.col(f"s{j}_id"))
            done.append(j)
            df = self.after(df, j)
            lo, hi = min(lo, j), max(hi, j)
        return df

    def _next_filter(self, at: int, step: int) -> int:
        """How far the next selective slot on a side is."""
        n, i = 0, at + step
        while 0 <= i < len(self.p.slots):
            n += 1
            if self.p.slots[i].filters:
                return n
            i += step
        return 1000 if n else 2000

    def _prefixed(self, i: int, rows: DataFrame | None = None) -> DataFrame:
        rows = self.rows(i) if rows is None else rows
        return rows.select(*[F.col(c).alias(f"s{i}_{c}") for c in rows.columns])

    def _hop(self, df: DataFrame, i: int, j: int, way: str) -> DataFrame:
        if self.p.slots[i].kind == "n":
            edges = self.rows(j)
            if way == "both":
                # One row per end, so that the join stays an equi-join.
                ends = edges.select("*", F.explode(F.array_distinct(F.array("src", "tgt"))).alias("node"))
                return df.join(self._prefixed(j, ends), F.col(f"s{i}_id") == F.col(f"s{j}_node"))
            return df.join(self._prefixed(j), F.col(f"s{i}_id") == F.col(f"s{j}_{'src' if way == 'out' else 'tgt'}"))
        src, tgt, came = F.col(f"s{i}_src"), F.col(f"s{i}_tgt"), f"s{i}_node"
        if way == "out":
            df = df.withColumn("_to", tgt)
        elif way == "in":
            df = df.withColumn("_to", src)
        elif came in df.columns and self._apart(i, j):
            # It came from a node that the next must differ from: only the other end is left.
            df = df.withColumn("_to", F.when(src == F.col(came), tgt).otherwise(src)).filter(F.col("_to") != F.col(came))
        else:
            df = df.withColumn("_to", F.explode(F.array_distinct(F.array(src, tgt))))
        if self.bare(j):
            return df.withColumnRenamed("_to", f"s{j}_id")
        return df.join(self._prefixed(j), F.col("_to") == F.col(f"s{j}_id")).drop("_to")

    def _apart(self, i: int, j: int) -> bool:
        back = 2 * i - j
        return 0 <= back < len(self.p.slots) and self.p.slots[back].unique and self.p.slots[j].unique


def rows_of(view: View, pattern: Pattern) -> DataFrame:
    bare = lambda i: pattern.slots[i].kind == "n" and not pattern.slots[i].keep and not pattern.slots[i].filters
    return Chain(pattern, lambda i: slot_rows(view, pattern, i), bare).build()


def match(view: View, text: str) -> DataFrame:
    """One row per chain, with ``{kind}{k}_id``, ``_type``, ``_value`` (and ``_src``, ``_tgt`` of edges) for the k-th kept slot.

    Chains that differ only in omitted slots are all reported. Literals of one test are a
    set: a value that is given twice counts once.
    """
    p = parse(text)
    df = rows_of(view, p)
    out = []
    for k, i in enumerate(p.kept, 1):
        kind = p.slots[i].kind
        out += [F.col(f"s{i}_{c}").alias(f"{kind}{k}_{c}") for c in ("id", "type", "value", *(("src", "tgt") if kind == "e" else ()))]
    return df.select(*out) if out else df.select(F.lit(1).alias("matched"))


def as_chain(pattern: Pattern, i: int) -> Column:
    """The struct of a slot within a chain."""
    kind = pattern.slots[i].kind
    none = F.lit(None).cast("long")
    col = lambda c: F.col(f"s{i}_{c}")
    return F.struct(
        F.lit("node" if kind == "n" else "edge").alias("kind"), col("id").alias("id"), col("type").alias("type"), col("value").alias("value"),
        (col("src") if kind == "e" else none).alias("src"), (col("tgt") if kind == "e" else none).alias("tgt"))


def query(view: View, texts: Sequence[str], limit: int = 0) -> DataFrame:
    """``pattern`` (its place in ``texts``) and ``chain``, the kept slots in order, for all patterns.

    With ``limit``, the first rows in the order of pattern and ids; 0 is no limit.
    """
    out = None
    for n, text in enumerate(texts):
        p = parse(text)
        part = rows_of(view, p).select(F.lit(n).alias("pattern"), F.array(*[as_chain(p, i) for i in p.kept]).alias("chain"))
        out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("no pattern")
    if limit:
        out = out.orderBy("pattern", F.transform("chain", lambda c: c["id"])).limit(limit)
    return out


__all__ = ["Chain", "match", "query", "rows_of", "slot_rows"]
