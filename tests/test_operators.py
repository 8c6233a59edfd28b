import math
import random

import pytest

from lodegraph.algo.components import spanning_forest
from lodegraph.algo.paths import cheapest_path, closure, costs, hops, joining, path_slack, shared_with_target
from lodegraph.operators.profiles import counts_below, edge_audit, exact_quantiles, relation_histogram
from lodegraph.operators.skew import distributed_rank, hot_keys, salted_join
from pyspark.sql import functions as F

ADJ = "id long, rel tinyint, pos int, nbr long, seen_at string, n_all string"
KNOWN = "log long, id long, peek array<int>, degree long, nbr string"


def test_edge_audit_cases(spark):
    adj = spark.createDataFrame([(1, 0, 0, 5, "", "x"), (1, 0, 3, 5, "", "x"), (1, 0, 1, 6, "", "x"), (1, 2, 0, None, "", "x"), (1, None, 0, 9, "", "x"), (None, 0, 0, 9, "", "x"), (2, 1, 0, 7, "", "x"), (2, 9, 0, 7, "", "x")], ADJ)
    known = spark.createDataFrame([(1, 1, [2], 2, ""), (1, 1, [2], 2, ""), (2, 2, [0, 1], 1, ""), (3, 3, None, 1, ""), (4, 4, [0, None, 0], None, ""), (5, None, [3], 3, ""), (6, 1, [0], 0, "")], KNOWN)
    got = sorted(tuple(r) for r in edge_audit(adj, known).select("id", "rel").collect())
    assert got == [(2, -1), (3, -1)]  # 9 is no relation of its own but counts in the total
    none = edge_audit(adj.limit(0), known.limit(0))
    assert none.count() == 0 and none.columns == ["id", "rel", "recorded", "listed"]
    assert relation_histogram(adj).filter("id = 1").first().n_0 == 2


@pytest.mark.parametrize("kind", ["long", "double"])
def test_quantiles_equal_sorting(spark, kind):
    r = random.Random(3)
    make = (lambda: r.choice([r.randrange(-(10**6), 10**6), r.randrange(5), 2**63 - 1, -(2**63)])) if kind == "long" else (lambda: r.choice([r.gauss(0, 1e5), 0.0, -0.0, math.inf, 1e300]))
    rows = [(1 if r.random() < 0.5 else r.randrange(2, 30), make()) for _ in range(3000)] + [(None, make()), (99, None)]
    df = spark.createDataFrame(rows, f"k int, v {kind}").withColumn("_v", F.lit("clash"))
    ps = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(x.k, x.prob): x.v for x in exact_quantiles(df, "k", "v", ps, bins=4, leaf=3).collect()}
    want = {}
    for k in {k for k, _ in rows if k is not None}:
        v = sorted(x for a, x in rows if a == k and x is not None)
        want |= {(k, p): v[max(math.ceil(p * len(v) - 1e-9), 1) - 1] for p in ps if v}
    assert got == want
    assert exact_quantiles(df.limit(0), "k", "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(df, "k", "v", [])


def test_counts_below(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, 2, 3]), r.choice([r.randrange(-50, 50), r.randrange(-(2**63), 2**63)])) for _ in range(400)] + [(None, 1), (5, None)]
    df = spark.createDataFrame(rows, "k int, v long")
    bounds = [-(2**63), -7, 2**40, 2**63 - 1]
    for bins in (64,):
        got = {x.k: (x.n, *[x[f"below_{i}"] for i in range(len(bounds))]) for x in counts_below(df, "k", "v", bounds, bins).collect()}
        of = {k: [v for a, v in rows if a == k and v is not None] for k in (1, 2, 3)}
        assert got == {k: (len(v), *[sum(x < b for x in v) for b in bounds]) for k, v in of.items()}
    assert counts_below(df.limit(0), "k", "v", [1]).count() == 0


def test_salted_join_and_rank(spark):
    left = spark.createDataFrame([(7 if i % 3 == 0 else i, i) for i in range(600)] + [(None, 1)], "k long, x long")
    right = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c")], "k long, y string")
    plain = left.join(right, "k")
    assert hot_keys(left, ["k"], 50).first().k == 7
    got = salted_join(left, right, ["k"], [F.col("x")], hot=hot_keys(left, ["k"], 50))
    assert sorted(got.collect()) == sorted(plain.collect())
    for how in ("left_semi", "left_anti", "left"):
        assert salted_join(left, right, ["k"], [F.col("x")], how).count() == left.join(right, "k", how).count()
    ranked = distributed_rank(left.filter("k is not null"), ["x"], ["k"])
    rows = sorted(left.filter("k is not null").collect())
    seen, want = {}, set()
    for k, x in rows:
        want.add((k, x, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + 1
    assert {tuple(r) for r in ranked.collect()} == want


def test_components(spark, tmp_path):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000), (None, 3)] + [(9000, 9001 + i) for i in range(50)]
    labels, forest = spanning_forest(spark.createDataFrame(edges, "a long, b long"), forest_path=str(tmp_path / "forest"))
    assert spark.read.parquet(str(tmp_path / "forest")).count() == forest.count()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert {x.node: x.root for x in labels.collect()} == {x: find(x) for x in parent}
    f = [tuple(x) for x in forest.collect()]
    assert len(f) == len(parent) - len({find(x) for x in parent}) and len(set(f)) == len(f)
    labels, forest = spanning_forest(spark.createDataFrame([], "a long, b long"))
    assert labels.count() == 0 and forest.count() == 0


def test_paths(spark):
    pairs = [(1, 2), (2, 3), (3, 9), (1, 4), (4, 9), *[(4, 100 + i) for i in range(10)], (200, 201)]
    e = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "id long, nbr long")
    deg = e.groupBy("id").agg(F.count("*").alias("degree"))
    cost, widest, path = cheapest_path(e, deg, 1, 9)
    assert path == [9, 3, 2, 1] and widest == 2 and cost == pytest.approx(2 * math.log(3))
    assert cheapest_path(e, deg, 1, 200) is None
    assert {r.id: r.hops for r in hops(e, spark.createDataFrame([(1,)], "id long"), 2).collect()} == {1: 0, 2: 1, 4: 1, 3: 2, 9: 2} | {100 + i: 2 for i in range(10)}
    assert closure(e, spark.createDataFrame([(200,), (77,)], "id long").select("id")).count() == 3
    slack = {r.id: r.slack for r in path_slack(e, deg, 1, 9, cost).collect()}
    assert set(slack) == {1, 2, 3, 9} and all(v == pytest.approx(0) for v in slack.values())
    assert costs(e, deg, 1, 0.5).count() == 3
    w = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 9, 1), (4, 9, 0)], "x long, y long, rel int")
    assert joining(w, deg, 1, 9)[2].count() == 3
    adj = spark.createDataFrame([(1, 0, 50), (50, 0, 1), (50, 0, 2), (50, 0, 3)], "id long, rel int, nbr long")
    attrs = spark.createDataFrame([(2, "country", "X")], "id long, key string, value string")
    assert {r.id for r in shared_with_target(adj, attrs, 1, 0, "country", "X").collect()} == {1, 2, 50}
