"""Per-key counts and exact quantiles where a few keys own most of the rows.

Everything is built from value histograms whose counts merge: a histogram is made
where the rows are, and only counts travel. Quantiles, and the ranks of given values,
follow by refinement: a rank lies in one bin, that bin is split again, until it holds a
single value or few rows. No task ever gets all rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.operators.skew import hot_keys
from lodegraph.session import materialize

BINS = 64
#: A bin with no more distinct values than this is sorted instead of split again.
LEAF = 512


def histogram(rows: DataFrame, keys: Sequence[str], bin_: Column, weight: Column, *more: Column) -> DataFrame:
    """Counts by key and bin: ``keys``, ``_bin``, ``_m`` and what ``more`` aggregates. Partial counts merge by adding."""
    return rows.groupBy(*keys, bin_.alias("_bin")).agg(F.sum(weight).alias("_m"), *more)


def counts_below(values: DataFrame, key: str, value: str, bounds: Sequence[int], bins: int = BINS) -> DataFrame:
    """``key``, ``n`` and ``below_0``, ``below_1`` ..: how many values of each key lie below each of ``bounds``.

    This is selection turned round: not the value at a rank, but the rank at which a
    value would stand. All keys are counted into the same ``bins`` bins between the least
    and the greatest value. A bin below a bound adds all its values; the one bin that
    a bound cuts is binned again, with the values in it only, until every bound lies
    between two bins. Counts are made where the rows are and add up, so no key's
    values are gathered; a round sends at most ``bins`` counts a key and task. Values are
    integers, repeats count, rows with a null key or value are left out.
    """
    rows = values.select(F.col(key).alias("_key"), F.col(value).cast("long").alias("_v")).filter("_key is not null and _v is not null")
    span = rows.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    ends = list(bounds)
    names = [f"below_{i}" for i in range(len(ends))]
    if span.lo is None:
        return rows.select(F.col("_key").alias(key), *[F.lit(0).cast("long").alias(c) for c in ("n", *names)]).limit(0)
    done = []
    # Each interval with the bounds that are still open in it; the first one holds all values.
    open_ = {(span.lo, span.hi): list(range(len(ends)))}
    first = True
    while open_:
        later: dict[tuple[int, int], list[int]] = {}
        for (lo, hi), some in open_.items():
            width = -(-(hi - lo + 1) // bins)
            part = rows if first else rows.filter(F.col("_v").between(lo, hi))
            # Whole numbers throughout: the distance between two 64-bit values can need 65 bits.
            h = histogram(part, ["_key"], F.expr(f"cast((cast(_v as decimal(20,0)) - {lo}bd) div {width}bd as int)"), F.lit(1))
            sums = {c: F.lit(0).cast("long") for c in names}
            for i in some:
                at, cut = divmod(min(max(ends[i], lo), hi + 1) - lo, width)
                sums[names[i]] = F.sum(F.when(F.col("_bin") < at, F.col("_m")).otherwise(0))
                if cut and at * width + lo <= hi:
                    later.setdefault((lo + at * width, min(hi, lo + (at + 1) * width - 1)), []).append(i)
            n = F.sum("_m") if first else F.sum(F.lit(0))
            done.append(h.groupBy("_key").agg(n.cast("long").alias("n"), *[(e if i in some else F.sum(e)).alias(c) for i, (c, e) in enumerate(sums.items())]))
        open_, first = later, False
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    if len(done) > 1:
        out = out.groupBy("_key").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    return out.withColumnRenamed("_key", key)


def relation_histogram(adj: DataFrame, rels: int = 8) -> DataFrame:
    """Distinct edges of each ``id`` as a histogram over relations.

    Columns ``id``, ``n_0`` .. ``n_{rels-1}``, ``n_all``. An edge is a distinct
    (``id``, ``rel``, ``nbr``) with no part null; further columns are ignored, and so are
    repeats. Relations outside 0..rels-1 count in ``n_all`` only. Edges are
    deduplicated by all three columns, so a hot id is spread over all tasks; then
    the ranks at which each relation begins among an id's edges are resolved by
    ``counts_below``, and the edges of a relation lie between two of them.
    """
    edges = adj.select("id", F.col("rel").cast("long").alias("rel"), "nbr").dropna().distinct()
    below = counts_below(materialize(edges.select("id", "rel"), "listed"), "id", "rel", range(rels + 1))
    return below.select("id", *[(F.col(f"below_{r + 1}") - F.col(f"below_{r}")).alias(f"n_{r}") for r in range(rels)], F.col("n").alias("n_all"))


def recorded_totals(known: DataFrame, rels: int = 8) -> DataFrame:
    """Sums over the records of each ``id``: ``id``, ``k_0`` .. ``k_{rels-1}``, ``k_all``.

    Each ``log`` counts once (records without a ``log`` are told apart by their content);
    null counts and positions past the end of ``peek`` are 0. Rows without ``id`` are left out.
    """
    rows = known.select("log", "id", "peek", "degree").filter("id is not null")
    once = rows.filter("log is not null").dropDuplicates(["log"]).unionByName(rows.filter("log is null").distinct())
    peeks = [F.sum(F.coalesce(F.get("peek", F.lit(r)), F.lit(0)).cast("long")).alias(f"k_{r}") for r in range(rels)]
    return once.groupBy("id").agg(*peeks, F.sum(F.coalesce("degree", F.lit(0))).alias("k_all"))


def edge_audit(adj: DataFrame, known: DataFrame, rels: int = 8) -> DataFrame:
    """Where recorded counts differ from listed edges: ``id``, ``rel``, ``recorded``, ``listed``.

    One row for each relation of an ``id`` of ``known`` whose numbers differ, and one with
    ``rel`` -1 where the totals do. Ids that ``adj`` lacks have 0 listed edges. Empty
    inputs give an empty result.
    """
    both = recorded_totals(known, rels).join(relation_histogram(adj, rels), "id", "left")
    pairs = [(r, f"k_{r}", f"n_{r}") for r in range(rels)] + [(-1, "k_all", "n_all")]
    cells = F.array(*[
        F.struct(F.lit(r).cast("long").alias("rel"), F.col(k).alias("recorded"), F.coalesce(F.col(n), F.lit(0)).alias("listed"))
        for r, k, n in pairs
    ])
    wrong = F.filter(cells, lambda c: c["recorded"] != c["listed"])
    return both.select("id", F.inline(wrong))


@F.pandas_udf(T.LongType())
def _ordered_bits(v: pd.Series) -> pd.Series:
    """Doubles as integers of the same order; -0.0 counts as 0.0, NaN comes last."""
    x = (v.to_numpy(dtype="float64", copy=True) + 0.0)
    bits = x.view("int64")
    return pd.Series(bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF))


def exact_quantiles(
    df: DataFrame, key: str, value: str, probs: Sequence[float], bins: int = BINS, leaf: int = LEAF, higher: bool = False,
) -> DataFrame:
    """Exact discrete quantiles of ``value`` for every ``key``: ``key``, ``prob``, ``value``, ``n``.

    The quantile at p is the value of rank ceil(p * n), at least 1, among the n non-null
    values of the key, repeats counted; with ``higher`` that of rank ceil(p * (n - 1)) + 1, the next
    higher value where the place falls between two. ``value`` may be any integer, date, timestamp or
    floating type (NaN is the largest value). Rows with a null key or value are left out;
    a key without values has no rows; an empty input gives an empty result. Other columns
    are ignored, whatever their names.

    Each round costs one pass over the rows that still can hold a rank: they are set
    against their key's open intervals (hot keys in salted parts), counted by bin where
    they are, and every interval shrinks to one of ``bins`` parts. Intervals of at
    most ``leaf`` distinct values are sorted instead. There are at most
    log(2^64) / log(bins) rounds.
    """
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probs must lie in 0..1")
    kind = df.schema[value].dataType
    # Not dropna(): that would drop NaN as well.
    rows = df.select(F.col(key).alias("_key"), F.col(value).alias("_raw")).filter("_key is not null and _raw is not null")
    rows = rows.withColumn("_v", _as_long(kind))
    # Distinct values with their counts: a key that repeats few values is small from here on.
    rows = materialize(rows.groupBy("_key", "_v").agg(F.min("_raw").alias("_raw"), F.count("*").alias("_c")), "values")
    span = rows.groupBy("_key").agg(
        F.sum("_c").alias("n"), F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # Ranks in whole numbers: a product of doubles would miss by one where n is large.
    whole = lambda x: F.lit(x).cast("decimal(19,0)")
    ratios = [(float(p), *Decimal(str(p)).as_integer_ratio()) for p in probs]
    ps = F.array(*[F.struct(F.lit(p).alias("p"), whole(a).alias("a"), whole(b).alias("b")) for p, a, b in ratios])
    state = span.select("_key", "n", "_d", "_lo", "_hi", F.explode(ps).alias("q"))
    rank = F.expr("(q.a * (n - 1) + q.b - 1) div q.b + 1") if higher else F.greatest(F.expr("(q.a * n + q.b - 1) div q.b"), F.lit(1))
    state = state.withColumn("_rank", rank.cast("long")).withColumn("prob", F.col("q.p")).drop("q")
    state = materialize(state, "ranks")
    hot = hot_keys(rows, ["_key"])
    done = []
    while True:
        small = state.filter(F.col("_d") <= leaf)
        done.append(_sorted_leaf(_within(rows, small, hot)))
        state = state.filter(F.col("_d") > leaf)
        if state.isEmpty():
            break
        state = materialize(_refine(_within(rows, state, hot), bins), "ranks")
        rows = materialize(_survivors(rows, state, hot), "values")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("_key").alias(key), "prob", F.col("_raw").alias(value), "n")


def _as_long(kind: T.DataType) -> Column:
    """``_raw`` as an integer of the same order."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _ordered_bits(F.col("_raw").cast("double"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros("_raw")
    return F.unix_date("_raw").cast("long") if isinstance(kind, T.DateType) else F.col("_raw").cast("long")


def _salted(rows: DataFrame, state: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    parts = F.broadcast(hot.select("_key", "_parts"))
    n = F.coalesce("_parts", F.lit(1))
    a = rows.join(parts, "_key", "left").withColumn("_s", F.pmod(F.xxhash64("_v"), n).cast("int")).drop("_parts")
    b = state.join(parts, "_key", "left").withColumn("_s", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    return a, b


def _within(rows: DataFrame, state: DataFrame, hot: DataFrame) -> DataFrame:
    a, b = _salted(rows, state, hot)
    return a.join(b, ["_key", "_s"]).filter("_v between _lo and _hi").drop("_s")


def _survivors(rows: DataFrame, state: DataFrame, hot: DataFrame) -> DataFrame:
    spans = state.groupBy("_key").agg(F.collect_set(F.struct("_lo", "_hi")).alias("_spans"))  # one for each rank
    a, b = _salted(rows, spans, hot)
    keep = F.exists("_spans", lambda s: (F.col("_v") >= s["_lo"]) & (F.col("_v") <= s["_hi"]))
    return a.join(b, ["_key", "_s"]).filter(keep).select(*rows.columns)


def _refine(pairs: DataFrame, bins: int) -> DataFrame:
    """Each interval shrunk to the bin that holds its rank."""
    # Decimals, as the distance between two 64-bit values can need 65 bits.
    dec = lambda c: F.col(c).cast("decimal(20,0)")
    width = F.ceil((dec("_hi") - dec("_lo") + 1) / bins)
    part = F.floor((dec("_v") - dec("_lo")) / width).cast("int")
    h = histogram(pairs, ["_key", "prob", "n", "_rank"], part, F.col("_c"), F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    w = Window.partitionBy("_key", "prob").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # `bins` rows at most
    h = h.withColumn("_upto", F.sum("_m").over(w))
    h = h.filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_m") < F.col("_rank")))
    return h.select("_key", "n", "_d", "_lo", "_hi", "prob", (F.col("_rank") - (F.col("_upto") - F.col("_m"))).alias("_rank"))


def _sorted_leaf(pairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("_key", "prob").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)  # `leaf` rows at most
    p = pairs.withColumn("_upto", F.sum("_c").over(w))
    p = p.filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank")))
    return p.select("_key", "prob", "_raw", "n")
