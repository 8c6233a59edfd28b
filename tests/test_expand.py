import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.expand import wire
from lodegraph.expand.expander import Expander, run_many
from lodegraph.expand.policy import Bfs, Candidate, Context, Decision, Guided, Rules, Take, Task, guided_priority
from lodegraph.expand.source import Attr, Via, fetch, peek, semi_join_chain
from lodegraph.expand import learned
from lodegraph.expand.sessions import Sessions
from lodegraph.expand.world import planted_alert, planted_path, random_world, scenario
from lodegraph.rank.features import NAMES, features, test_tasks as held_out
from lodegraph.rank.metrics import bootstrap, capped, credit, per_group, weights


def test_runs_find_what_is_planted():
    w, task, truth = planted_path(3000, 2)
    done = lambda x: x.report.connected_at is not None
    for policy in (Bfs(7), Guided()):
        x = Expander(w, policy, task, log_batches=True)
        r = x.run(done)
        assert r.connected_at == r.done_at == r.fetched <= task.budget and x.connected(*task.seeds)
        assert r.fetched == sum(len(s.edges) for s in r.trace) + (r.fetched - r.edges) and r.edges == len(x.written)
        assert all(w.linked(a, b, rel) for a, b, rel in x.written)
        assert sum(r.hits(s, truth) for s in r.trace) == len(truth & x.written) and r.route(truth) >= {task.seeds[0]}
    w, task = planted_alert(2000)
    plain, pushed = (Expander(w, Guided(p), task).run() for p in (False, True))
    assert pushed.alert_at < plain.alert_at and pushed.filtered and plain.alerts == 1 and len(plain.matched) == 2


def test_budget_and_rounds():
    w, task, _ = planted_path(3000, 3, budget=50)
    for k in (1, 4):
        r = Expander(w, Bfs(20), task, parallel=k).run()
        assert r.fetched <= 50
    assert Expander(w, Rules(3, 0), task).run().fetched == 0


def test_wire_round_trips():
    d = Decision(-1.5, [Take(2, 7, Via(1, Attr("k", "v"))), Take(0, 3)])
    assert wire.parse_decision(json.loads(json.dumps(wire.decision_json(d)))) == d
    for bad in ({}, {"priority": "x"}, {"priority": 1, "take": [{"rel": -1}]}, {"priority": 1, "take": [{"rel": 1, "filter": {"via": 1}}]}):
        with pytest.raises(ValueError):
            wire.parse_decision(bad)
    w, task, truth = planted_path(500, 2)
    r = Expander(w, Guided(), task, log_batches=True).run()
    assert json.loads(next(wire.trace_lines(r, truth)))["candidate"]["cost"].count(None) == 1
    assert {"label", "depth"} <= set(json.loads(next(wire.batch_lines(r, w, lambda i: i % 2 == 0)))["candidates"][0])
    assert json.loads(json.dumps(wire.task_json(task, w)))["goal"] == "connect"


def test_many_runs(spark):
    w, task, _ = planted_path(1000, 2)
    got = run_many(spark, w, [("a", Bfs(7), task), ("b", Guided(), task)]).collect()
    assert {r.run for r in got} == {"a", "b"} and all(r.connected_at for r in got)


def test_sources_as_tables(spark):
    w = random_world(400, 4)
    rows = [(i, r, p, n) for (i, r), ns in w.adj.items() for p, n in enumerate(ns)]
    adj = spark.createDataFrame(rows, "id long, rel int, pos int, nbr long")
    assert {r.id: r.peek for r in peek(adj).collect()} == {i: w.peek(i) for i in {x[0] for x in rows}}
    picks = spark.createDataFrame([(rows[0][0], rows[0][1], 0, 2)], "id long, rel int, offset int, limit int")
    assert [r.nbr for r in fetch(adj, picks).orderBy("at").collect()] == w.fetch(rows[0][0], rows[0][1], 0, 2)
    w.attributes = {i: {"c": "x"} for i in range(0, len(w), 7)}
    attrs = spark.createDataFrame([(i, "c", "x") for i in w.attributes], "id long, key string, value string")
    got = {(r.id, r.nbr) for r in semi_join_chain(adj, attrs, 3, [4], "c", "x").collect()}
    assert got == {(i, n) for (i, r), _ in w.adj.items() if r == 3 for n in w.fetch_where(i, 3, Via(4, Attr("c", "x")), 10**6)}


def test_priority_of_a_table_is_that_of_the_policy(spark):
    task = Task(relation_interest=[1.0, 0.5, 0, 0, 0, 0, 0, 0], domain_interest=[1.0, 0.3], budget=1000)
    cs = [Candidate(i, i % 3, [i, 2, 5, 0, 0, 0, 0, 0], [0] * 8, cost=[i / 3, 9.0]) for i in range(9)]
    want = {c.id: d.priority if d.take else None for c, d in zip(cs, Guided().decide(task, Context(budget=1000), cs), strict=True)}
    df = spark.createDataFrame([(c.id, c.peek, min(c.cost), c.domain) for c in cs], "id int, peek array<int>, cost double, domain int")
    got = {r.id: r.p for r in df.select("id", guided_priority(F.col("peek"), F.col("cost"), F.col("domain"), task.relation_interest, task.domain_interest).alias("p")).collect()}
    assert {k: v if v is None else round(v, 9) for k, v in got.items()} == {k: v if v is None else round(v, 9) for k, v in want.items()}


def test_metrics(spark):
    rows = [(1, 0.9, 0, 5.0), (1, 0.9, 1, 1.0), (1, 0.1, 1, 1.0), (2, 0.5, 1, 1.0), (3, 1.0, 1, None), (3, 0.5, 0, 2.0), (None, 1.0, 1, 1.0), (1, None, 1, 1.0), (3, 0.2, None, 1.0), (3, float("nan"), 1, 1.0)]
    df = spark.createDataFrame(rows, "g int, s double, y int, c double")
    got = {r.g: tuple(r)[1:] for r in per_group(df, "g", "s", "y", "c", 2).collect()}
    d2 = 1 / np.log2(3)
    assert got[1] == pytest.approx((d2 / (1 + d2), 0.5, 0.0, 5.0)) and got[3] == pytest.approx((1, 1, 1, 0)) and set(got) == {1, 3}
    big = spark.createDataFrame([(1, i, int(i < 3)) for i in range(100)], "g int, i int, y int")
    k = capped(big, "g", "y", 10)
    assert k.count() == 10 and k.filter("y = 1").count() == 3
    assert {(r.y, r.weight) for r in weights(k, big, "g", "y").collect()} == {(1, 1.0), (0, 97 / 7)}
    low, high = bootstrap(spark.range(200).select(F.col("id").cast("double").alias("x")), "x", "x", 300)
    assert 85 < low < 99.5 < high < 115
    s = spark.createDataFrame([(1, 0, 0.5)], "g int, i int, slack double")
    assert credit(big, s, ["g", "i"], "y", 2.0).filter("i = 0").first().credit == pytest.approx(np.exp(-1))


def test_features_and_split(spark):
    row = (1, 5, 0, [3, 1, 0, 0, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0, 0, 0], [2, None], [0.5, None], 4, [1] * 8, 0, False, 0, None, [True] + [False] * 7, "connect", [1.0] * 8, [0.7] * 8, 100, 50, [30, 10], 3)
    schema = "grp long, id long, domain int, peek array<int>, fetched array<int>, hops array<int>, cost array<double>, known int, known_by_domain array<int>, watched int, is_watched boolean, alerts int, probes int, pushed array<boolean>, goal string, relation_interest array<double>, domain_interest array<double>, budget long, fetched_total long, by_side array<int>, steps int"
    f = features(spark.createDataFrame([row, (1, 6, *row[2:6], [9.0, 9.0], *row[7:])], schema)).orderBy("id").collect()
    a = f[0].asDict()
    assert list(a)[2:] == NAMES and a["left0"] == 2 and a["hops"] == 2 and a["hops_far"] == 1000 and a["two_sided"] == 0 and a["spent"] == 0.5 and a["side_balance"] == 0.5 and a["probes"] == -1 and a["pushed"] == 1
    assert [x["rank_cost"] for x in f] == [0.0, 1.0] if f[0]["cost"] <= f[1]["cost"] else [1.0, 0.0]
    t = spark.createDataFrame([("a", [1]), ("b", [1, 2]), ("c", [2]), ("d", [9]), ("e", None)], "task string, seeds array<long>")
    got = {r.task: r.test for r in held_out(t, 0.5).collect()}
    assert len(got) == 5 and got["a"] == got["b"] == got["c"]


def test_registers(spark, tmp_path):
    from lodegraph.sources.registers import load

    (tmp_path / "nodes-entities.csv").write_text('node_id,name,note\n1,"Acme, ""Ltd""\nline",x\n1,again,\nbad,row,\n')
    (tmp_path / "nodes-officers.csv").write_text("node_id,name,country_codes\n2,Ann,XX\n")
    for f in ("intermediaries", "addresses", "others"):
        (tmp_path / f"nodes-{f}.csv").write_text("node_id,name\n")
    (tmp_path / "relationships.csv").write_text("node_id_start,node_id_end,rel_type,link\n2,1,officer_of,Director Of\n2,1,officer_of,director of\n2,9,officer_of,x\n2,1,nonsense,x\n")
    e, adj = load(spark, str(tmp_path))
    rows = {r.id: r for r in e.collect()}
    assert rows[1].text == 'entity name: Acme, "Ltd"\nline; linked by: director of' and rows[2].text == "officer name: Ann; links: director of" and rows[2].country == "XX"
    assert sorted((r.id, r.rel, r.pos, r.nbr) for r in adj.collect()) == [(1, 0, 0, 2), (2, 0, 0, 1)]


def test_live_standing(spark, tmp_path):
    from lodegraph.streaming.live import watch
    from lodegraph.writer import Transaction

    t = Transaction()
    a = t.node("t", "a").id
    for v in (1, 5, 6, 0, 7):
        t.set(a, "k", v)
    log, seen = t.frame(spark), []
    for i, cond in enumerate(("id <= 3", "id > 3")):
        log.filter(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = watch(spark, str(tmp_path / "in"), str(tmp_path / "kept"), ["n(k>4)"], str(tmp_path / "cp"), lambda df, n: seen.extend((n, r.at) for r in df.collect()), once=True)
        s.awaitTermination(120)
        assert s.exception() is None
    assert sorted(x for _, x in seen) == [3, 6]


@pytest.mark.parametrize("name,easy,hard", [("path-5hop", Guided(), None), ("path-7hop", Guided(), Rules(4, 2)), ("pivot-busy", Guided(True), Rules(4, 2)), ("alert", Guided(True), Guided()), ("explore", Guided(), None)])
def test_scenarios(name, easy, hard):
    w, task, truth = scenario(name, 6000, 5, 4000)
    done = lambda x: x.report.connected_at is not None
    x = Expander(w, easy, task)
    r = x.run(done)
    assert all(w.linked(a, b, rel) for a, b, rel in truth) and r.fetched <= task.budget
    if task.goal == "explore":
        assert r.probes > 10 and r.nodes > 20
    else:
        assert r.done_at is not None and (r.alerts or x.connected(*task.seeds))
    if hard is not None:
        other = Expander(w, hard, task).run(done)
        assert other.done_at is None or other.done_at > r.done_at


def test_learned_policy(spark, tmp_path):
    w, task, truth = scenario("path-5hop", 3000, 3, 3000)
    goal = lambda x: x.report.connected_at is not None
    guided = Expander(w, Guided(), task, log_batches=True)
    report = guided.run(goal)
    on = {x for a, b, _ in truth for x in (a, b)}
    for policy in ("guided", "uniform"):
        (tmp_path / f"connect.5.{policy}.jsonl").write_text("\n".join(wire.batch_lines(report, w, on.__contains__)))
    (tmp_path / "other.5.guided.jsonl").write_text("{}")
    tasks = spark.createDataFrame([("connect.5", "connect", task.relation_interest, task.domain_interest)], "task string, goal string, relation_interest array<double>, domain_interest array<double>")
    rows = learned.load(spark, str(tmp_path), tasks)
    assert rows.count() == 2 * sum(len(b.candidates) for b in report.batches) and rows.filter("y = 1").count() > 0
    assert learned.concat([rows, rows]).select("grp").distinct().count() == 4 * len(report.batches)
    # The numbers of a call are those of a table of calls.
    b = max(report.batches, key=lambda b: len(b.candidates))
    call = wire.context_json(b.context)
    mine = {c.id: x for c, x in zip(b.candidates, learned.numbers(task, b.context, b.candidates), strict=True)}
    same = [r for r in rows.filter("run = 'connect.5.guided'").collect() if r.id in mine and r.batch == pytest.approx(np.log1p(len(b.candidates))) and r.steps == pytest.approx(np.log1p(call["steps"]))]
    assert len(same) == len(mine) and all(list(mine[r.id]) == pytest.approx([r[n] for n in NAMES]) for r in same)
    x = Expander(w, learned.Learned([lambda x: np.where(x[:, NAMES.index("cost")] < 4, 0.9, 0.1)]), task)
    assert x.run(goal).connected_at is not None
    w, task, _ = scenario("alert", 3000, 3, 3000)
    ask = learned.answer_columns({5: {"hub": {"score": 3}, "person": {"probability": 0.2}}})
    seen = []
    pushed = Expander(w, learned.Learned([lambda x: seen.append(x.shape[1]) or np.full(len(x), 0.5)], push=True, answers=ask), task).run()
    assert pushed.alert_at is not None and pushed.filtered and set(seen) == {len(NAMES) + 10} and ask([5])[0][3] == 1.0 and np.isnan(ask([6])).all()


def test_answers_within_a_budget():
    asked = []
    client = learned.Answers(lambda text, qs: asked.append((text, qs)) or ({q: {"probability": 0.5} for q in qs}, 1.0), lambda text, qs: 1.0)
    texts = {1: "a", 2: "b", 3: "a"}
    assert client.get(texts, ["person"])[1] == {"person": None} and not asked
    got = client.get(texts, ["person"], 1.5)
    assert got[1] == got[3] and got[1]["person"] and got[2]["person"] is None and client.spent == 1.0 and len(asked) == 1
    assert client.get(texts, ["person"], 9.0)[2]["person"] and len(asked) == 2


def test_sessions():
    w, task, truth = scenario("path-5hop", 2000, 3, 2000)
    s = Sessions()
    run = s.start(w, task, truth=truth)
    seq, first = 0, s.poll(run)
    assert first["task"]["goal"] == "connect" and first["ask"]["seq"] == 1
    with pytest.raises(ValueError):
        s.answer(run, 1, [])
    with pytest.raises(LookupError):
        s.answer(run, 7, [{"priority": 0}])
    while (p := s.poll(run, seq, 5))["state"] == "running" and seq < 400:
        if "ask" not in p:
            continue
        seq = p["ask"]["seq"]
        takes = [[{"rel": r, "limit": 20} for r in range(8) if c["peek"][r] > c["fetched"][r]] for c in p["ask"]["candidates"]]
        s.answer(run, seq, [{"priority": -sum(c["peek"]), "take": t} for c, t in zip(p["ask"]["candidates"], takes, strict=True)])
    assert s.poll(run, seq, 0.1)["report"]["steps"] > 0 and s.trace(run) and s.batches(run)
    s.stop(run)
    late = s.start(w, task, timeout=0.05)
    s._run(late).join(5)
    assert s.poll(late)["state"] == "cancelled" and s.list() == [late]
    own = s.start(w, task, Guided())
    assert s.poll(own)["state"] == "done"
    with pytest.raises(LookupError):
        s.poll("no such run")
