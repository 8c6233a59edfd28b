"""What loading, lists and deletions leave on disk or send through shuffles."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from lodegraph import natives
from lodegraph.log import View, delta, derive_next
from lodegraph.schema import as_log
from lodegraph.session import materialize, scratch, scratch_dir, settled
from lodegraph.sources.tables import Edges, Nodes, load


def shuffle_files(spark) -> set[str]:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name for d in dirs for p in Path(d).rglob("shuffle_*.data")}


def tables(spark) -> set[str]:
    return {p.name for p in Path(scratch_dir(spark).removeprefix("file:")).glob("lodegraph-tables/*/*")}


def shop(spark):
    people = spark.createDataFrame([("a", 3.0), ("a", 2.0), ("b", None), (None, 1.0)], "name string, age double")
    buys = spark.createDataFrame([("a", "x", 5), ("a", "x", 4), ("b", "x", None), ("b", "y", 1)], "who string, what string, n int")
    nodes = [Nodes("person", people, F.col("name"), {"age": (F.col("age"), "number")}), Nodes("thing", spark.createDataFrame([("x",)], "t string"), F.col("t"))]
    return nodes, [Edges("buys", buys, ("person", F.col("who")), ("thing", F.col("what")), None, {"n": (F.col("n"), "integer")})]


def test_a_write_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    with scratch(spark):
        materialize(spark.range(1000).groupBy(F.col("id") % 7).count())
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) <= before


def test_loading_leaves_one_table(spark):
    before = tables(spark)
    log = load(*shop(spark))
    assert len(tables(spark) - before) == 1
    rows = [(r.id, r.kind, r.type, r.value, r.src, r.tgt, r.parent, r.key, r.val_json) for r in log.orderBy("id").collect()]
    assert rows == [
        (1, "node", "person", "a", None, None, None, None, None), (2, "node", "person", "b", None, None, None, None, None), (3, "node", "thing", "x", None, None, None, None, None),
        (4, "edge", "buys", "", 1, 3, None, None, None), (5, "edge", "buys", "", 2, 3, None, None, None),
        (6, "prop", None, None, None, None, 1, "age", "2.0"), (7, "prop", None, None, None, None, 4, "n", "4"),
    ]
    assert derive_next(log).filter("next is not null").isEmpty()


def test_settled_keeps_what_was_there(spark):
    kept = materialize(spark.range(3), "kept")
    before = tables(spark)
    out = settled(spark, lambda: materialize(kept, "inner").join(kept, "id"), "outer")
    assert out.count() == 3 and kept.count() == 3 and len(tables(spark) - before) == 1


def links(spark):
    nodes = spark.createDataFrame([(i, "node", "n", None, None) for i in (1, 2, 3)], "id long, kind string, type string, src long, tgt long")
    edges = spark.createDataFrame([(4, "edge", "q", 1, 2), (5, "edge", "p", 1, 2), (6, "edge", "p", 2, 1), (7, "edge", "p", 1, 1)], nodes.schema)
    return as_log(nodes.union(edges))


def test_edge_lists_send_one_list(spark):
    lists = natives.edge_lists(View(derive_next(links(spark))))
    assert lists._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1
    rows = {r.id: (r.edges, r.inbound, r.outbound) for r in lists.collect()}
    assert rows == {1: ([6, 7, 5, 4], [6, 7], [7, 5, 4]), 2: ([5, 4, 6], [5, 4], [6]), 3: ([], [], [])}


def test_neighbours_are_gathered_once(spark):
    found = natives.neighbours(View(derive_next(links(spark))))
    assert "collect_set(" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: (r.neighbor_count, r.neighbors) for r in found.collect()} == {1: (1, [2]), 2: (1, [1]), 3: (0, [])}


def test_deletions_write_after_each_join(spark):
    before = tables(spark)
    new = as_log(spark.createDataFrame([(8, "deletion", 2)], "id long, kind string, target long"))
    rows, ends = delta(derive_next(links(spark)), new)
    assert {tuple(r) for r in ends.collect()} == {(2, 8), (4, 8), (5, 8), (6, 8)} and rows.count() == 1
    assert any(t.startswith("below-") for t in tables(spark) - before)


def test_clusters_leave_one_table_and_send_few_pairs(spark):
    import numpy as np

    from lodegraph.llm import duplicates

    rng = np.random.default_rng(5)
    x, y = (rng.integers(-(1 << 62), 1 << 62, n) for n in (200, 40))
    one, two = np.sort(x), np.sort(np.concatenate((x[20:], y)))
    bits = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(duplicates._sketch(one), duplicates._sketch(two), strict=True))
    assert 0 < bits <= len(np.setxor1d(one, two)) and duplicates._key(one) != duplicates._key(two)
    words = [f"w{i}" for i in range(60)]
    texts = {1: words, 2: [*words[:59], "x"], 3: words, 4: words[:30] + [f"z{i}" for i in range(30)], 5: [f"v{i}" for i in range(60)]}
    rows = [(i, " ".join(t), None) for i, t in texts.items()] + [(2, "another text of the same number that is like none", None), (6, None, 5)]
    before = tables(spark)
    found = duplicates.clusters(spark.createDataFrame(rows, "doc_id long, text string, reissue_of long"))
    assert {r.node: r.root for r in found.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    assert len(tables(spark) - before) == 1
