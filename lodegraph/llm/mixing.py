"""One mixture of several sources near target shares, by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.tokens import token_counts
from lodegraph.session import materialize

#: More sources than this are an error: their targets go to every task.
MOST_SOURCES = 10_000
#: Steps of all sources' counts that are sent to every task, 80 MB; more are an error.
MOST_STEPS = 10_000_000


def source_key(c: Column) -> Column:
    """A source's name without case, outer blanks and the choice of separator; empty is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_"), F.lit(""))


def chances(rate: float, cap: int) -> tuple[int, np.ndarray]:
    """The least count and the upper ends of the unit interval's parts for it and each next one, under Poisson(rate).

    Counts from ``cap`` on are the cap and have no end of their own. Left out are counts so
    far from the rate that their chances, below 2^-53, would not change any sum: about
    18 * sqrt(rate) are left. Chances are computed by their logarithms, as exp(-rate) is 0 beyond 745.
    """
    if rate <= 0:
        return 0, np.ones(min(cap, 1))
    wide = 9 * math.sqrt(rate) + 30
    low, high = max(0, math.floor(rate - wide)), math.ceil(rate + wide)
    k = np.arange(low, min(high, cap) if cap > low else low)
    steps = np.concatenate(([0.0], np.cumsum(math.log(rate) - np.log(k[1:])))) if len(k) else np.zeros(0)
    return min(low, cap), np.minimum(np.cumsum(np.exp(steps - rate + low * math.log(rate) - math.lgamma(low + 1))), 1.0)


def mean_copies(rate: float, cap: int) -> float:
    """Mean of a Poisson count that is cut at ``cap``."""
    low, upto = chances(rate, cap)
    return low + float(np.sum(1 - upto))


def rate_for(mean: float, cap: int) -> float:
    """The rate whose cut Poisson count has this mean; at the cap, a rate that always reaches it."""
    if mean <= 0 or cap <= 0:
        return 0.0
    if mean >= cap:
        return math.inf
    low, high = 0.0, 1.0
    while mean_copies(high, cap) < mean:
        if len(chances(high, cap)[1]) == 0:
            return math.inf  # no chance of fewer is left: the cap is as near the mean as doubles can tell
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean_copies(mid, cap) < mean else (low, mid)
    return (low + high) / 2


def plan(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, tuple[float, int]]:
    """Mean copies and cap of each source: ``{source: (mean, cap)}``.

    ``total`` is the size of the mixture; by default the largest at which every source with tokens
    can still reach its share under its cap.
    """
    live = {s: (w, m) for s, (w, m) in targets.items() if w > 0 and m > 0 and tokens.get(s, 0) > 0}
    whole = sum(w for w, _ in live.values())
    if not live:
        return {}
    if total is None:
        total = min(m * tokens[s] * whole / w for s, (w, m) in live.items())
    return {s: (min(m, total * w / whole / tokens[s]), m) for s, (w, m) in live.items()}


def mixture(
    documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, tokenizer: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(mixture, shares)``.

    ``mixture`` has ``place`` (the order of the mixture is that of this key, then of
    document and copy), ``doc_id``, ``copy`` from 1, ``source`` and ``tokens``, in that order of
    rows; ``shares`` has ``source``, ``target_share``, ``max_repeats``, ``documents``, ``used``, ``most_copies``,
    ``tokens`` and ``actual_share`` for every source of ``targets``.

    A document's copies are a Poisson count with its source's mean repetition, cut at
    ``max_repeats``; the rate is chosen so that the cut count still has that mean. The count is read from
    a hash of the document and ``seed``, so it is the same in every run and task.
    Sources written differently are one; documents of no or an unlisted source and empty texts
    add nothing. Targets with a null source, share or cap are ignored, repeats of a
    source are an error. An empty table gives an empty mixture and shares of 0.
    """
    rows = [(r.s, r.w, r.m) for r in targets.select(source_key(F.col("source")).alias("s"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("m")).dropna().limit(MOST_SOURCES + 1).collect()]
    if len(rows) > MOST_SOURCES or len({s for s, _, _ in rows}) < len(rows):
        raise ValueError("targets must name each source once, and at most 10,000 sources")
    wanted = {s: (w, m) for s, w, m in rows}
    spark = documents.sparkSession
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", source_key(F.col("source").cast("string")).alias("source"))
    sized = token_counts(d, ["source"], tokenizer).filter("tokens > 0")
    names = spark.createDataFrame([(s,) for s in wanted], "source string")
    # Sums by source, of listed sources only: as many rows as targets.
    held = {r.source: (r.t, r.n) for r in sized.join(F.broadcast(names), "source").groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    means = plan({s: t for s, (t, _) in held.items()}, wanted, total)
    steps = []
    for s, (mean, cap) in means.items():
        least, upto = (cap, np.zeros(0)) if (rate := rate_for(mean, cap)) == math.inf else chances(rate, cap)
        steps.append((s, least, upto.tolist()))
    if sum(len(u) for _, _, u in steps) > MOST_STEPS:
        raise ValueError("the targets repeat too many sources too often")
    table = F.broadcast(spark.createDataFrame(steps, "source string, least int, upto array<double>"))
    # 53 bits of a hash as a number in [0, 1).
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("copies"), "doc_id"), 11) / F.lit(float(1 << 53))
    copies = F.col("least") + F.size(F.filter("upto", lambda c: c <= u))
    drawn = materialize(sized.join(table, "source").select("doc_id", "source", "tokens", copies.alias("copies")), "drawn")
    used = drawn.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    mixed = used.select(F.xxhash64(F.lit(seed), F.lit("place"), "doc_id", "copy").alias("place"), "doc_id", "copy", "source", "tokens").orderBy("place", "doc_id", "copy")
    sums = drawn.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if(F.col("copies") > 0).alias("used"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    listed = spark.createDataFrame(rows, "source string, target_share double, max_repeats int")
    whole = sums.agg(F.sum("tokens").alias("all"))
    shares = listed.join(F.broadcast(sums), "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("documents", "used", "most_copies", "tokens")],
        F.coalesce(F.col("tokens") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0)).alias("actual_share"))
    return mixed, shares
