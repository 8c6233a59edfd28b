"""The N best items of every group, by ranking salted subgroups first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.skew import ROWS, hot_keys


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5, rows: int = ROWS) -> DataFrame:
    """The ``n`` items of highest ``score`` in each ``group``: the three columns and ``rank`` from 1.

    An item listed several times in a group counts once, with its highest score. Higher
    scores come first, equal ones by smaller item; 0.0 and -0.0 are equal. Rows whose
    group or item is null, or whose score is null, NaN or infinite, are never kept; a
    group with fewer items keeps all of them, one without any has no rows. Other columns
    are ignored. An empty table gives an empty result.

    A group is hashed into as many subgroups as it has times ``rows`` rows, by item and by
    where the row was read, so that neither a large group nor an item repeated without
    end meets in one task. Each subgroup ranks its items and keeps ``n``, then the
    survivors, ``n`` a subgroup, are ranked by group. That is exact: in the subgroup
    with an item's highest score, whatever goes before the item also goes before it in
    the whole group, and its lower scores elsewhere lose to that one in the end. All
    rows are shuffled once, by (group, subgroup), and the survivors once.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    s = F.col(score).cast("double")
    valid = df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), (s + F.lit(0.0)).alias("_s")).filter(
        "_g is not null and _i is not null and _s > double('-infinity') and _s < double('infinity')")  # NaN exceeds infinity
    sub = F.pmod(F.xxhash64("_i", F.spark_partition_id()), F.coalesce("_parts", F.lit(1))).cast("int")
    salted = valid.join(F.broadcast(hot_keys(valid, ["_g"], rows).select("_g", "_parts")), "_g", "left")
    first = _ranked(salted.select("_g", sub.alias("_sub"), "_i", "_s"), ["_g", "_sub"], n)
    last = _ranked(first.select("_g", "_i", "_s"), ["_g"], n)
    return last.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), F.col("_r").alias("rank"))


def _ranked(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """Each item once for ``by``, the ``n`` first; one shuffle serves both."""
    best = rows.repartition(*by).groupBy(*by, "_i").agg(F.max("_s").alias("_s"))
    return best.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_s"), F.asc("_i")))).filter(F.col("_r") <= n)
