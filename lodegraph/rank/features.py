"""What a candidate and its call say in numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.skew import distributed_rank, salted_join
from lodegraph.session import materialize

RELATIONS = 8
DOMAINS = 8
# Fixed value: hops and costs of a side that has not reached the candidate.
FAR = 1e3
# What a model's columns are called, and in which order.
NAMES = [
    "domain", "goal", *(f"peek{r}" for r in range(RELATIONS)), *(f"left{r}" for r in range(RELATIONS)), *(f"known_dom{d}" for d in range(DOMAINS)), "log_degree", "log_left", "log_relevant",
    "hops", "hops_far", "two_sided", "cost", "cost_far", "known", "watched", "is_watched", "alerts", "probes", "pushed", "domain_interest", "spent", "side_balance", "steps", "batch", "rank_cost",
]


def features(candidates: DataFrame) -> DataFrame:
    """One row of numbers for each candidate, after ``grp`` and ``id``.

    ``candidates`` has ``grp``, ``id``, ``domain``, ``peek``, ``fetched``, ``hops``, ``cost`` (two sides each, null: not reached), ``known``, ``known_by_domain``, ``watched``,
    ``is_watched``, ``alerts``, ``probes``, ``pushed``, and of its call ``goal``, ``relation_interest``, ``domain_interest``, ``budget``, ``fetched_total``, ``by_side``, ``steps``. The call's
    size and the place by cost within it come from the group, ties by id.
    """
    at = lambda a, i: F.coalesce(F.get(F.col(a), F.lit(i)), F.lit(0)).cast("double")
    left = [F.greatest(at("peek", r) - at("fetched", r), F.lit(0.0)) for r in range(RELATIONS)]
    total = lambda cs: sum(cs[1:], cs[0])
    sides = lambda a: [F.coalesce(F.get(F.col(a), F.lit(i)).cast("double"), F.lit(FAR)) for i in (0, 1)]
    hops, cost = sides("hops"), sides("cost")
    n = F.col("_n")
    one, two = at("by_side", 0), at("by_side", 1)
    values: dict[str, Column] = {"domain": F.col("domain").cast("double"), "goal": F.when(F.col("goal") == "connect", 0.0).otherwise(1.0)}
    values |= {f"peek{r}": at("peek", r) for r in range(RELATIONS)} | {f"left{r}": left[r] for r in range(RELATIONS)}
    values |= {f"known_dom{d}": at("known_by_domain", d) for d in range(DOMAINS)}
    values |= {
        "log_degree": F.log1p(total([at("peek", r) for r in range(RELATIONS)])), "log_left": F.log1p(total(left)), "log_relevant": F.log1p(total([at("relation_interest", r) * left[r] for r in range(RELATIONS)])),
        "hops": F.least(*hops), "hops_far": F.greatest(*hops), "two_sided": (F.greatest(*hops) < FAR).cast("double"), "cost": F.least(*cost), "cost_far": F.greatest(*cost),
        "known": F.col("known").cast("double"), "watched": F.col("watched").cast("double"), "is_watched": F.col("is_watched").cast("double"), "alerts": F.col("alerts").cast("double"),
        "probes": F.coalesce(F.col("probes").cast("double"), F.lit(-1.0)), "pushed": F.aggregate("pushed", F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))),
        "domain_interest": F.coalesce(F.get("domain_interest", F.col("domain").cast("int")), F.lit(0.0)).cast("double"), "spent": F.col("fetched_total") / F.greatest("budget", F.lit(1)),
        "side_balance": (one - two) / F.greatest(one + two, F.lit(1.0)), "steps": F.log1p(F.col("steps").cast("double")), "batch": F.log1p(n.cast("double")),
    }
    values["rank_cost"] = F.col("_k") / F.greatest(n - 1, F.lit(1))
    # Places and sizes of large groups come from many tasks.
    placed = distributed_rank(candidates.withColumn("_cost", F.least(*cost)), ["_cost", "id"], ["grp"], "_k")
    counts = candidates.groupBy("grp").agg(F.count("*").alias("_n"))
    return salted_join(placed, counts, ["grp"], [F.col("_k")]).select("grp", "id", *[values[c].alias(c) for c in NAMES])


def priority(p: Column, log_relevant: Column, alpha: float = 1.0) -> Column:
    """A model's chance that a candidate is on the path, per edge it costs."""
    return F.log(p) - alpha * log_relevant


def test_tasks(tasks: DataFrame, share: float = 0.2, salt: str = "") -> DataFrame:
    """``task`` and ``test``: whole components of tasks that share a seed, drawn by a checksum of their smallest name."""
    from lodegraph.algo.components import spanning_forest

    rows = tasks.select("task", "seeds").filter("task is not null").dropDuplicates(["task"])
    # Tasks go by their place among all, as a hash of the name could give two of them one number.
    ids = materialize(distributed_rank(rows, ["task"], name="n"), "tasks")
    seeds = ids.select("n", F.explode("seeds").alias("seed")).dropna().distinct()
    least = seeds.groupBy("seed").agg(F.min("n").alias("m"))
    labels, _ = spanning_forest(seeds.join(least, "seed").select(F.col("m").alias("a"), F.col("n").alias("b")))
    rooted = ids.join(labels, ids.n == labels.node, "left").select("task", F.coalesce("root", "n").alias("root"))
    name = rooted.groupBy("root").agg(F.min("task").alias("name"))
    test = F.crc32(F.concat(F.lit(salt), "name").cast("binary")) < int(share * 2**32)
    return rooted.join(name, "root").select("task", test.alias("test"))
