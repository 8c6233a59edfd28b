"""How well scores order the candidates of each group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.profiles import exact_quantiles
from lodegraph.operators.skew import salted_join
from lodegraph.session import materialize


def per_group(df: DataFrame, group: str, score: str, y: str, cost: str, k: int = 10) -> DataFrame:
    """``group``, ``ndcg``, ``recall``, ``top1`` and ``ahead`` of every group with a positive and a negative.

    Positives have ``y`` 1. Ties go against the score: a positive below a negative of equal score.
    ``ndcg`` and ``recall`` are those of the first ``k``; ``ahead`` is the cost ranked before the first
    positive (null costs are 0). Rows with a null group, score or y, or a NaN score, are left out.

    No group is ranked as a whole: counts and the best positive's score combine where the
    rows are, each task passes on its first ``k`` of a group, and what lies ahead is a sum
    over the negatives that score no less than that best positive.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(score).cast("double").alias("_s"), F.col(y).cast("int").alias("_y"), F.coalesce(F.col(cost).cast("double"), F.lit(0.0)).alias("_c"))
    rows = rows.filter("_g is not null and _s is not null and not isnan(_s) and _y is not null")
    all_ = rows.groupBy("_g").agg(F.sum("_y").alias("_pos"), F.count("*").alias("_n"), F.max(F.when(F.col("_y") == 1, F.col("_s"))).alias("_best")).filter("_pos > 0 and _pos < _n")
    all_ = materialize(all_, "groups")
    w = Window.partitionBy("_g").orderBy(F.desc("_s"), "_y")
    first = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    gain = 1 / F.log2(F.col("_r") + 1.0)
    top = first.groupBy("_g").agg(F.sum(F.when(F.col("_y") == 1, gain)).alias("_dcg"), F.sum("_y").alias("_got"), F.max(F.when(F.col("_r") == 1, F.col("_y"))).alias("_top"))
    # Rows meet their group's best score in parts; sums of the parts add up.
    ahead = salted_join(rows.filter("_y <> 1"), all_.select("_g", "_best"), ["_g"], [F.col("_s"), F.col("_c")]).filter("_s >= _best").groupBy("_g").agg(F.sum("_c").alias("_ahead"))
    g = all_.join(top, "_g").join(ahead, "_g", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_pos"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return g.select(
        F.col("_g").alias(group), (F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg"), (F.col("_got") / F.least(F.col("_pos"), F.lit(k))).alias("recall"),
        F.col("_top").cast("double").alias("top1"), F.coalesce("_ahead", F.lit(0.0)).alias("ahead"))


#: Upper ends of the unit interval's parts for 0, 1, 2 .. under Poisson(1), until doubles cannot tell the rest.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 20.0)))))


def _times(keys: np.ndarray, seed: int, n: int) -> np.ndarray:
    """How often each row takes part in each of ``n`` resamples: rows x resamples, from a hash of the row's key and the resample."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, (x ^ (x >> np.uint64(31))) / 2.0**64, side="right")


def bootstrap(df: DataFrame, column: str, key: str, n: int = 2000, seed: int = 0) -> tuple[float, float]:
    """The 95% interval of a column's mean over ``n`` resamples.

    ``key`` tells the rows (groups) apart. Each takes part in every resample a Poisson(1) number of
    times, drawn from its key where the row is, so resampling needs one pass, no gathering, and gives the
    same in any order; partial sums of the resamples are added up. Null and NaN values are left out.
    """

    def sums(it):
        total, weight = np.zeros(n), np.zeros(n)
        for pdf in it:
            for at in range(0, len(pdf), 512):
                w = _times(pdf["h"].to_numpy()[at : at + 512], seed, n)
                total += pdf["x"].to_numpy(float)[at : at + 512] @ w
                weight += w.sum(0)
        yield pd.DataFrame({"b": range(n), "t": total, "w": weight})

    keyed = df.select(F.col(column).cast("double").alias("x"), F.xxhash64(key).alias("h")).filter("x is not null and not isnan(x)")
    parts = keyed.mapInPandas(sums, "b int, t double, w double").groupBy("b").agg((F.sum("t") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    q = parts.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).first().q
    return (q[0], q[1]) if q else (float("nan"), float("nan"))


def capped(df: DataFrame, group: str, y: str, cap: int = 64, seed: int = 0) -> DataFrame:
    """Each group cut to ``cap`` rows: positives first, then negatives in the order of a seeded hash of the row."""
    order = Window.partitionBy(group).orderBy(F.desc(y), F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]))
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= cap).drop("_r")


def weights(kept: DataFrame, total: DataFrame, group: str, y: str) -> DataFrame:
    """``kept`` with ``weight``: 1 for positives, and for a negative its group's negatives in ``total`` over those kept."""
    def negatives(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(group).agg(F.count_if(F.col(y) == 0).alias(name))

    both = negatives(kept, "_k").join(negatives(total, "_t"), group, "left")
    w = F.when(F.col(y) == 0, F.coalesce("_t", F.lit(0)) / F.greatest("_k", F.lit(1))).otherwise(1.0)
    return kept.join(both, group).withColumn("weight", w).drop("_k", "_t")


def summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by``, ``mean``, ``p50`` and ``p90`` of a value, percentiles as the next higher value that occurs.

    Percentiles come by refined histograms, so a few large groups take no task for themselves. Null values
    are left out; null is a group like others.
    """
    v = df.select(F.struct(by).alias("_by"), value).filter(F.col(value).isNotNull())
    q = exact_quantiles(v, "_by", value, [0.5, 0.9], higher=True).groupBy("_by").agg(
        F.max(F.when(F.col("prob") == 0.5, F.col(value))).alias("p50"), F.max(F.when(F.col("prob") == 0.9, F.col(value))).alias("p90"))
    return v.groupBy("_by").agg(F.avg(value).alias("mean")).join(q, "_by").select(f"_by.{by}", "mean", "p50", "p90")


def by_task(df: DataFrame, task: str, group: str, value: str) -> DataFrame:
    """``task`` and ``mean``: the mean over groups of the means within groups, so that large groups count once."""
    return df.groupBy(task, group).agg(F.avg(value).alias("_m")).groupBy(task).agg(F.avg("_m").alias("mean"))


def credit(df: DataFrame, slack: DataFrame, keys: list[str], y: str, strength: float) -> DataFrame:
    """``df`` with ``credit``: exp(-strength * slack) for positives that ``slack`` lists by ``keys``, else 1."""
    s = slack.select(*keys, F.col("slack").alias("_slack")).dropDuplicates(keys)
    c = F.when((F.col(y) == 1) & F.col("_slack").isNotNull(), F.exp(-strength * F.col("_slack"))).otherwise(1.0)
    return df.join(s, keys, "left").withColumn("credit", c).drop("_slack")
