"""Joins and ranks that hold up when one key owns a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import materialize

#: Rows of one key that a task may hold. A key of more is cut into parts of about as many.
ROWS = 250_000
#: A list of keys that is sent to every task has no more rows than this. Keys beyond
#: ``ROWS`` can be more only above ROWS * MOST_HOT rows in all (5e10); from there on a
#: part grows with the table, so that its share of a task's work stays the same.
MOST_HOT = 200_000


def part_rows(total: int, rows: int = ROWS) -> int:
    """How many rows of one key make a part, in a table of ``total`` rows."""
    return max(1, rows, -(-total // MOST_HOT))


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = ROWS) -> DataFrame:
    """Keys with more rows than a task may hold, with their counts ``_n`` and into how many ``_parts`` they are to be cut.

    Counting combines on the map side, so no key's rows are gathered. By counting there are
    at most ``MOST_HOT``. Null keys are never hot, as they join nothing. A written table.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    counts = materialize(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(known & (F.col("_n") > rows)), "hot")
    size = part_rows(df.count(), rows) if counts.count() > MOST_HOT else rows
    return counts.filter(F.col("_n") > size).withColumn("_parts", F.ceil(F.col("_n") / size).cast("int"))


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[Column], how: str = "inner", rows: int = ROWS, hot: DataFrame | None = None,
) -> DataFrame:
    """``left`` join ``right`` on ``keys``, with the hot keys of ``left`` in parts of about ``rows`` rows.

    ``spread`` are columns of ``left`` that differ within a key. Rows of ``right`` are
    repeated only for hot keys, once for each part. ``how`` is inner, left, left_semi or
    left_anti. The list of hot keys is broadcast; ``hot_keys`` bounds it.
    """
    keys = list(keys)
    if hot is None:
        hot = hot_keys(left, keys, rows)
    hot = F.broadcast(hot.select(*keys, "_parts"))
    a = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def distributed_rank(df: DataFrame, order: Sequence[str], within: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """0-based rank of each row by ``order`` inside each value of ``within``.

    No group is gathered in one task: rows are range-partitioned and sorted, each takes
    its place in its partition, and the places are shifted by the counts of the
    partitions before, a table of one row per partition and group. A group that spans
    several partitions is the only kind that repeats there. With many rows equal in all of
    ``within`` and ``order`` one partition holds them: add a column that tells them apart.
    """
    keys = [*within, *order]
    parts = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    placed = materialize(parts.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    groups = placed.groupBy("_part", *within).agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = groups.select("_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(within)], (before - F.col("_first")).alias("_shift"))
    on = F.col("p._part") == F.col("s._part")
    for i, k in enumerate(within):
        on = on & F.col(f"p.{k}").eqNullSafe(F.col(f"s._k{i}"))
    out = placed.alias("p").join(shift.alias("s"), on)
    return out.select(*[F.col(f"p.{c}") for c in df.columns], (F.col("_at") + F.col("_shift")).alias(name))
