import json

import pytest

from lodegraph import ingest
from lodegraph.functions import json_values as J
from lodegraph.store import Refused, Store, Who, error
from lodegraph.writer import Locked, Stored, Transaction
from pyspark.sql import functions as F


def test_merge():
    assert J.merge({"a": 1, "b": {"c": 1}}, {"b": {"d": 2}}) == {"a": 1, "b": {"c": 1, "d": 2}}
    assert J.merge([3, 1], [2, 1]) == [1, 2, 3] and J.merge(["b"], ["a", "b"]) == ["a", "b"] and J.merge([1], ["a"]) == ["a"]
    assert J.merge(5, [2]) == [2] and J.merge({"a": 1}, 2) == 2 and J.merge(None, [2, 2]) == [2] and J.merge([True], [1]) == [1]
    assert (J.scalar(True), J.scalar(None), J.scalar(1.5), J.scalar([])) == ("True", "", "1.5", None)
    assert (J.whole(2.0), J.whole(2.5), J.whole(float("inf"))) == (2, 2.5, None)


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(J.date_seconds(F.lit("1970-01-02T00:00:10.5Z"))) == 86410 and one(J.date_seconds(F.lit("1970-01-02"))) == 86400 and one(J.date_seconds(F.lit("soon"))) is None
    assert one(J.is_uuid(F.lit("c232ab00-9414-11ec-b3c8-9e6bdeced846"))) and not one(J.is_uuid(F.lit("C232ab00-9414-11ec-b3c8-9e6bdeced846")))
    assert one(J.uuid_seconds(F.lit("c232ab00-9414-11ec-b3c8-9e6bdeced846"))) == pytest.approx(1645557742.0)
    assert one(J.words(F.lit("a, b_c a-é"))) == ["a", "b_c", "é"]
    udf = F.pandas_udf(J.merge_json, "string")
    assert one(udf(F.lit("[3,1]"), F.lit("[2]"))) == "[1,2,3]"


def test_input_and_depths():
    t = Transaction()
    n = lambda v: {"type": "t", "value": v}
    ingest.apply(t, {"chains": [[n("a"), {"type": "e"}, n("b"), {"type": "e"}, n("c")]], "meta": {"x": [2]}})
    depth = lambda: {e.value: t.value(e.id, "depth") for e in t.entries if e.kind == "node"}
    assert depth() == {"a": None, "b": None, "c": None}
    ingest.apply(t, {"seed": True, "nodes": [n("a")]})
    assert depth() == {"a": 0, "b": 1, "c": 2} and t.fifo_len(ingest.SEEDS) == 1
    ingest.apply(t, {"edges": [{"src": n("a"), "tgt": n("b"), "type": "e", "cost": 0.5}]})
    assert depth() == {"a": 0, "b": 0.5, "c": 1.5}
    ingest.apply(t, {"edges": [{"src": n("a"), "tgt": n("b"), "type": "e", "cost": 0.9}]})
    assert t.value(t._edges[2, 3, "e", ""], "cost") == 0.5 and t.props(0) == {"x": [2]}
    before = t.next_id()
    for bad, code in (([], 400), ({"chains": [[n("a"), {"type": "e"}]]}, 409), ({"nodes": [n("new"), {"type": "t"}]}, 409), ({"nodes": [{"ID": 99}]}, 409), ({"meta": 1}, 400)):
        with pytest.raises(ingest.BadInput) as e:
            ingest.apply(t, bad)
        assert e.value.code == code and t.next_id() == before
    assert t.fifo_pop(ingest.SEEDS) and t.fifo_len(ingest.SEEDS) == 0


def test_commits(spark, tmp_path):
    g = Stored(tmp_path / "g")
    with g.write() as t:
        a = t.node("t", "a").id
        t.set(a, "k", {"x": [1, "é"]})
        t.kv_put("d", "k", 1)
    with pytest.raises(RuntimeError), g.write() as t:
        t.node("t", "lost")
        raise RuntimeError
    with g.write() as t:
        assert t.value(a, "k") == {"x": [1, "é"]} and t.kv_get("d", "k") == 1 and t.next_id() == 3
        with pytest.raises(KeyError), t.nested():
            t.node("t", "b")
            raise KeyError
        t.delete(a)
        with pytest.raises(Locked), g.write():
            pass
    assert g.log(spark).count() == 3 and g.counts() == (0, 0)
    assert {r.id: r.next for r in g.history(spark).collect()} == {1: 3, 2: 3, 3: None}
    g.sync()
    with g.write() as t:
        t.index_values("w")
        b, c = t.node("t", "b").id, t.node("t", "c").id
        for x, v in ((b, 1), (c, 2), (b, 2)):
            t.set(x, "w", v)
        assert [e.parent for e in t.valued("w", 2)] == [c, b] and t.valued("w", 1) == [] and t.valued("other", 1) == []
        t.delete(b)
        t.delete(c)
    assert g.read().indexed == {"w"} and g.counts() == (0, 0)
    g.snapshot(spark, str(tmp_path / "s"))
    with pytest.raises(Exception, match="exists"):
        g.snapshot(spark, str(tmp_path / "s"))
    with g.write() as t:
        t.reset()
    assert g.log(spark).count() == 0 and g.next_id() == 1


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    body = {"seed": True, "chains": [[{"type": "a", "value": 1}, {"type": "e"}, {"type": "b", "value": 2, "p": "x"}]]}
    g = s.create(body)
    assert s.exists(g) and s.status(g)["nodes_count"] == 2 and len(s.seeds(g)) == 1
    assert s.query(g, ["n(type='a')->n(p='x')"]).count() == 1 and s.crawl(g, ["n(type='a')"]).count() == 2
    assert s.query(g, ["n(p='x')"], start=1).first().chain[0].value == "2"
    assert s.post(g, {"nodes": [{"type": "c", "value": True}]})["updates"] == 1
    nodes, edges = s.dump(g)
    assert {r.value: json.loads(r.props) for r in nodes.collect()}["2"] == {"p": "x", "seed": True, "depth": 0} and edges.count() == 1
    ix, es = s.d3(g)
    assert sorted(r["index"] for r in ix.collect()) == [0, 1, 2] and tuple(es.select("source", "target").first()) == (0, 1)
    s.kv(g, "k", put={"a": 1})
    assert s.kv(g, "k", put={"b": 2}) == {"a": 1, "b": 2} and s.kv(g, "k", put=3, replace=True) == 3 and s.kv(g, remove=True) == {}
    s.meta(g, {"name": "alpha", "roles": {"ann": "read write", "bob": {"read": False}}})
    with pytest.raises(Refused):
        s.status(g)
    ann = Who("ann")
    assert s.list() == [] and len(s.list(ann)) == 1 and s.list(Who("bob")) == [] and s.list(Who("ann", ("admin",))) == []
    assert len(s.list(ann, filters=["n(meta.name~/beta/)", "n(nodes_count>2, graph)"])) == 1 and s.list(ann, filters=["n(ID)"]) == []
    assert s.object(g, 1, {"q": 1}, ann)["q"] == 1
    other = s.create({"chains": [[{"type": "x", "value": v}, {"type": "e"}, {"type": "x", "value": "hub"}] for v in "abc"]})
    assert s.object(other, 2) == {"ID": 2, "type": "x", "value": "hub", "edge_count": 3, "inbound_count": 3, "outbound_count": 0, "neighbor_count": 3}
    one = s.object(other, 3, {"cost": 0.5})
    assert one["src"] == {"ID": 1, "type": "x", "value": "a"} and one["tgt"]["value"] == "hub" and one["cost"] == 0.5
    answer = list(s.answer(other, ["n(value='a')", "e()", "e()"]))
    assert answer[0] == ["e()", "n(value='a')"] and len(answer) == 5 and answer[-1][1][0]["value"] in ("", "a")
    lock = tmp_path / other / "lock"
    lock.touch()  # a writer is at work: reads go on
    assert s.status(other)["nodes_count"] == 4 and len(s.list()) == 1 and s.kv(other) == {} and s.seeds(other) == [] and s.meta(other) == {}
    with pytest.raises(Locked) as held:
        s.post(other, {})
    lock.unlink()
    assert error(held.value)["code"] == 409 and error(LookupError("x")) == {"code": 404, "reason": "Not Found", "message": "x"} and "bulk" not in error(ValueError("y"))["message"]
    manifest = (tmp_path / other / "manifest.json").read_text()
    assert s.post(other, {})["updates"] == 0 and (tmp_path / other / "manifest.json").read_text() == manifest
    at = int(s.headers(other)["X-lg-maxID"])
    nodes = spark.createDataFrame([("x", "a"), ("x", "new")], "type string, value string")
    assert s.ingest(other, nodes) == 1 and s.status(other)["nodes_count"] == 5 and s.headers(other, 1) == {"X-lg-maxID": str(at + 1), "X-lg-updates": "1"}
    assert s.post(other, {"edges": [{"src": {"type": "x", "value": "new"}, "tgt": {"type": "x", "value": "a"}, "type": "f"}]})["updates"] == 1
    s.adopt("00000000-0000-0000-0000-000000000001", s._stored(other).log(spark))
    assert s.status("00000000-0000-0000-0000-000000000001")["edges_count"] == s.status(other)["edges_count"] == 4
    s.delete(other)
    s.delete("00000000-0000-0000-0000-000000000001")
    s.reset(g, who=ann)
    assert s.status(g)["nodes_count"] == 2
    assert s.query_all(["n()"]).count() == 2
    s.delete(g)
    assert not s.exists(g)
    with pytest.raises(ValueError):
        s.exists("../x")


def test_bulk_writes_equal_those_one_by_one(spark, tmp_path):
    from lodegraph import bulk
    from lodegraph.kept import Kept
    from lodegraph.schema import as_log, typed

    kept = Kept(spark, str(tmp_path / "kept"))
    t = Transaction()
    a = t.node("t", "a").id
    t.set(a, "k", 1)
    t.edge(a, t.node("t", "b").id, "e", "")
    kept.append(t.frame(spark))
    nodes = spark.createDataFrame([("t", "a"), ("t", "c"), ("t", "c"), ("u", "d"), (None, "x")], "type string, value string")
    edges = spark.createDataFrame([("t", "a", "t", "b", "e", None), ("t", "a", "u", "d", "e", "1"), ("t", "a", "u", "d", "e", "1")], "src_type string, src_value string, tgt_type string, tgt_value string, type string, value string")
    props = spark.createDataFrame([("t", "a", "k", 1), ("t", "c", "k", 7), ("t", "b", "k", 2)], "type string, value string, key string, v long").select("type", "value", "key", *typed(F.col("v"), "integer"))
    new = bulk.written(kept.history(), nodes, edges, props)
    assert sorted((r.id, r.kind, r.value or r.key) for r in new.collect()) == [(5, "node", "c"), (6, "node", "d"), (7, "edge", "1"), (8, "prop", "k"), (9, "prop", "k")]
    m = kept.append(new)
    assert (m["nodes"], m["edges"], m["next_id"]) == (4, 2, 10)
    with pytest.raises(bulk.Missing):
        bulk.written(kept.history(), edges=edges.withColumn("tgt_value", F.lit("nowhere")))
    gone = bulk.deletions(kept.history(), spark.createDataFrame([(a,)], "id long"))
    m = kept.append(gone, batch=3)
    assert (m["nodes"], m["edges"]) == (3, 0) and kept.append(gone, batch=3)["parts"][-1]["batch"] == 3
    with pytest.raises(bulk.Missing):
        bulk.deletions(kept.history(), spark.createDataFrame([(a,)], "id long"))
    before = sorted(map(str, kept.history().collect()))
    kept.compact()
    assert sorted(map(str, kept.history().select(*kept.history().columns).collect())) == before and kept.manifest()["parts"] == []
    late = as_log(spark.createDataFrame([(4, "deletion", 1)], "id long, kind string, target long")).withColumn("id", F.lit(9).cast("long"))
    assert kept.append(late.limit(0))["next_id"] == 11
    chain = spark.createDataFrame([([("t", "x"), ("e", None), ("t", "y"), ("e", "2"), ("t", "z")],), ([("t", "z")],), (None,)], "chain array<struct<type:string,value:string>>")
    n, e = bulk.chains(chain)
    assert sorted(r.value for r in n.collect()) == ["x", "y", "z"] and sorted((r.src_value, r.value, r.tgt_value) for r in e.collect()) == [("x", "", "y"), ("y", "2", "z")]
    with pytest.raises(bulk.Missing):
        bulk.chains(spark.createDataFrame([([("t", "x"), ("e", None)],)], chain.schema))
    d = bulk.depths(spark.createDataFrame([(1, 2), (3, 2), (9, 8)], "src long, tgt long"), spark.createDataFrame([(1,)], "id long"))
    assert {r.id: r.depth for r in d.collect()} == {1: 0, 2: 1, 3: 2}


def test_codecs():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from lodegraph.functions import codecs as C

    leaf = st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text(max_size=40)
    values = st.recursive(leaf, lambda v: st.lists(v, max_size=20) | st.dictionaries(st.text(max_size=9), v, max_size=20), max_leaves=30)

    @settings(max_examples=150, deadline=None)
    @given(values, st.lists(st.integers(0, 2**64 - 1), max_size=8))
    def round_trips(v, ns):
        assert C.unpack(C.pack(v)) == v and type(C.unpack(C.pack(v))) is type(v)
        assert list(C.varints(b"".join(map(C.varint, ns)))) == ns and sorted(ns) == sorted(ns, key=C.varint)
        with pytest.raises(ValueError):
            C.unpack(C.pack(v) + b"\xc0")

    round_trips()
    for n in (15, 16, 31, 32, 255, 256, 65_535, 65_536):
        assert C.unpack(C.pack("x" * n)) == "x" * n and C.unpack(C.pack([None] * n)) == [None] * n
    for bad in (b"", b"\xa2x", b"\xc1", b"\xc4\x01a", b"\xd9\xff", b"\x92\x01", b"\xa1\xff"):
        with pytest.raises(ValueError):
            C.unpack(bad)
    assert C.fnv64(b"") == 0xCBF29CE484222325 and C.fnv64(b"a") == 0xAF63DC4C8601EC8C
    r = C.SplitMix(0)
    assert r.next() == 0xE220A8397B1DCDAF and 0 <= r.below(10) < 10 and 0 <= r.unit() < 1
    assert C.parse_query("q=a%20b&q=c+d&empty&x=%C3%A9") == [("q", "a b"), ("q", "c d"), ("empty", ""), ("x", "é")] and C.unescape("%zz+1") == "%zz 1"


def test_scratch_is_scoped(spark):
    from lodegraph.session import materialize, scratch

    kept = materialize(spark.range(3), "outer")
    with scratch(spark):
        inner = materialize(spark.range(4), "inner")
        assert inner.count() == 4
        files = inner.inputFiles()
    import os

    assert kept.count() == 3 and files and not any(os.path.exists(f.replace("file://", "")) for f in files)
