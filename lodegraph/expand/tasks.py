"""Intents drawn from a company register's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.algo.paths import hops
from lodegraph.operators.skew import salted_join

#: An alert needs so many co-officers with a country.
ENOUGH = 50


def alert_targets(adj: DataFrame, countries: DataFrame, rel: int = 0, enough: int = ENOUGH) -> DataFrame:
    """``id``, ``country``, ``n``: for each officer the rarest country among co-officers other than its own.

    ``countries`` has ``id`` and ``country``. Each shared entity counts a co-officer again; ties go by the country's name. Officers
    with fewer than ``enough`` co-officers whose country is known are left out. Co-officers are never paired up: each entity
    counts its officers by country, every officer adds the counts of its entities and takes itself out.
    """
    officer = countries.filter("country is not null").select("id", "country").dropDuplicates(["id"])
    e = adj.filter((F.col("rel") == rel) & F.col("nbr").isNotNull()).select(F.col("id").alias("e"), F.col("nbr").alias("id")).distinct()
    held = salted_join(e, officer, ["id"], [F.col("e")]).groupBy("e", "country").agg(F.count("*").alias("n"))
    mine = adj.filter((F.col("rel") == rel) & F.col("nbr").isNotNull()).select("id", F.col("nbr").alias("e")).distinct()
    sums = salted_join(mine, held, ["e"], [F.col("id")]).groupBy("id", "country").agg(F.sum("n").alias("n"))
    # An officer takes itself out of the entities that list it.
    itself = mine.join(e, ["id", "e"], "left_semi").groupBy("id").agg(F.count("*").alias("_times"))
    own = officer.select("id", F.col("country").alias("_own"))
    both = sums.join(own, "id", "left").join(itself, "id", "left")
    both = both.withColumn("n", F.when(F.col("country") == F.col("_own"), F.col("n") - F.coalesce("_times", F.lit(0))).otherwise(F.col("n"))).filter("n > 0")
    both = both.withColumn("_all", F.sum("n").over(Window.partitionBy("id")))
    rare = both.filter((F.col("_all") >= enough) & ~F.col("country").eqNullSafe(F.col("_own")))
    return rare.groupBy("id").agg(F.min(F.struct("n", "country")).alias("m")).select("id", "m.country", "m.n")


def connect_targets(edges: DataFrame, seed: int, officers: DataFrame, nearest: int = 4, farthest: int = 6) -> DataFrame:
    """``id`` and ``hops`` of the officers that lie ``nearest`` to ``farthest`` edges from an officer."""
    start = edges.sparkSession.createDataFrame([(seed,)], "id long")
    return hops(edges, start, farthest).filter(F.col("hops") >= nearest).join(officers.select("id").distinct(), "id", "left_semi")


def answers_left(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions (``model``, ``question``, ``text``) without a stored answer, each once, with the ``key`` it will be stored under."""
    from lodegraph.functions.json_values import answer_key

    k = answer_key(F.col("model"), F.col("question"), F.col("text"))
    return asked.select("model", "question", "text", k.alias("key")).dropDuplicates(["key"]).join(answers.select("key"), "key", "left_anti")


def answer_value(kind: Column, probability: Column, score: Column, top: Column) -> Column:
    """An answer as a number: the chance of a yes, or a score as a part of its scale; NaN without one."""
    return F.coalesce(F.when(kind == "probability", probability).when(kind == "score", score / top), F.lit(float("nan")))
