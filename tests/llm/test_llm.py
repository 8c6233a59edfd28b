"""Each operator on nulls, empty and long texts, ties, repeats, empty tables and clashing names, and against slow versions."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import addresses, duplicates, mixing, names, packing, spam, spelling, splits, tokens, topn

ENT = "id long, domain tinyint, text string, seen_at string, value string"
DOC = "doc_id long, text string, source string, reissue_of long, tokens string"


def entities(spark, rows):
    return spark.createDataFrame([(i, d, t, "", "clash") for i, d, t in rows], ENT)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


# top n


def test_top_n(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, i, float(i % 7), "x") for i in range(500)] + [(1, 3, 99.0, "x"), (1, 3, -1.0, "x"), (2, 1, 0.0, "x"), (2, 2, -0.0, "x"), (3, 1, None, "x"), (4, 1, nan, "x"), (4, 2, inf, "x"), (4, 3, -inf, "x"), (4, 4, -3.0, "x"), (None, 1, 1.0, "x"), (5, None, 1.0, "x")]
    df = spark.createDataFrame(rows * 2, "g long, i long, s double, rank string")
    got = sorted((r.g, r["rank"], r.i) for r in topn.top_n(df, "g", "i", "s", 3, rows=50).collect())
    assert got == [(1, 1, 3), (1, 2, 6), (1, 3, 13), (2, 1, 1), (2, 2, 2), (4, 1, 4)]
    assert topn.top_n(df.limit(0), "g", "i", "s").count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "g", "i", "s", 0)


# splits


def test_splits_keep_groups_together(spark):
    b = [(1, "connect.pair-00000007.guided", None), (2, "CONNECT pair 7/guided", "connect.pair-7"), (3, None, " Connect_pair-0007 "), (4, None, "x.hub-9"), (5, "x.hub-9.model.v2", "x.hub-9"), (6, None, None), (6, None, None), (7, "", " "), (None, "a.b-1.c", None), (8, "z.w-3.p", None), (9, None, "q.q-4")]
    batches = spark.createDataFrame([(g, r, t, "clash") for g, r, t in b], "grp long, run string, task string, rep string")
    # The task that no call has leads from one to another; null seeds and null lists join nothing.
    tasks = spark.createDataFrame([("connect.pair-7", [1, None]), ("x.hub-00009", [1, 1]), ("z.w-3", [2]), ("no.call-5", [2, 3]), ("q.q-4", [3]), (None, [2, 3]), ("z.w-3", None)], "task string, seeds array<long>")
    calls, forest = splits.anchors(batches, tasks)
    assert {r.grp: r.anchor for r in calls.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 8, 9: 8}
    assert forest.count() >= 1
    out = splits.assign_splits(calls)
    per = collections.defaultdict(set)
    for r in out.collect():
        per[r.anchor].add(r.split)
    assert out.count() == 9 and all(len(s) == 1 for s in per.values())
    assert splits.anchors(batches.limit(0), tasks)[0].count() == 0 and splits.assign_splits(calls.limit(0)).count() == 0


def test_split_shares(spark):
    r = random.Random(1)
    rows, g = [], 0
    for a in range(3000):
        for _ in range(r.choice([1, 1, 2, 3, 9]) if a else 4000):
            rows.append((g, a))
            g += 1
    out = splits.assign_splits(spark.createDataFrame(rows, "grp long, anchor long"), salt="s")
    got = {x.split: x.n / len(rows) for x in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(got["train"] - 0.8) < 0.02 and abs(got["validation"] - 0.1) < 0.02 and abs(got["test"] - 0.1) < 0.02


# spelling


def test_near_spellings():
    r = random.Random(2)
    for _ in range(300):
        w = "".join(r.choice("abcd") for _ in range(r.randrange(4, 9)))
        i = r.randrange(len(w) - 1)
        for v in (w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]):
            assert spelling.deletes(w) & spelling.deletes(v) and spelling.within(w, v, 1)
    assert not spelling.within("abcd", "dcba", 2) and spelling.unscan("vafafm3rceg") == "vafafmerceg" and spelling.unscan("173a") == "173a"


def test_spellings_follow_the_usual_one(spark):
    words = spark.createDataFrame([("b", "cegzedfa", 50), ("b", "cegzedfaa", 1), ("b", "cegzdefa", 2), ("b", "cegzedda", 40), ("c", "cegzedfo", 1), ("b", "abc", 1), ("b", "abd", 9)], "block string, w string, n long")
    got = {(r.block, r.w): r.canonical for r in spelling.cluster_spellings(words, ["block"], "w", "n").collect()}
    assert got == {("b", "cegzedfa"): "cegzedfa", ("b", "cegzedfaa"): "cegzedfa", ("b", "cegzdefa"): "cegzedfa", ("b", "cegzedda"): "cegzedda", ("c", "cegzedfo"): "cegzedfo", ("b", "abc"): "abc", ("b", "abd"): "abd"}


# addresses


@pytest.mark.parametrize("text,box,number,unit,street", [
    ("Suite 9, Millrace Centre, 63 Puburgagdil Lane, Togdilda, AA06 07663, X", None, "63", "9", ("puburgagdil", "lane")), ("#15,166 rykissymvavstr.,zedsasvu", None, "166", "15", ("rykissymvav", "strasse")),
    ("P.O.Box 06577; Dadkyfbu", "6577", None, None, None), ("27th Floor - #159 Lupetwumxys Boulevard - Fimnyjki", None, "159", "27", ("lupetwumxys", "boulevard")), ("AV. NALALSASNAN 140B NOBKISDE", None, "140b", None, ("nalalsasnan", "avenida")),
    ("Fifth Floor | 74C Wyrarruhvez Drive | Congosju", None, "74c", "5", ("wyrarruhvez", "drive")), ("#25 Sumyhnyjhux Square, nr 197 Fejrodho", None, "197", "25", ("sumyhnyjhux", "square")), ("TYMUDVULHAH-WEG No 164, Go5huxve", None, "164", None, ("tymudvulhah", "weg")),
])
def test_address_parts(text, box, number, unit, street):
    p = addresses.parse_address(text)
    assert (p["box"], p["number"], p["unit"]) == (box, number, unit)
    assert street is None or {"name": street[0], "kind": street[1]} in p["streets"]


def test_same_location(spark):
    full = [(100 + i, 3, f"address address: {i} Puburgagdil Lane, Togdilda, AA06 07663, X; countries: X") for i in range(40, 50)]
    full += [(200 + i, 3, f"address address: {i} Puburgagdil Road, Togdilda, AA06 07700, X") for i in range(40, 44)] + [(300 + i, 3, f"address address: {i} Puburgagdil Lane, Wumpapvu, AA07 07663, X") for i in range(40, 44)]
    odd = [(1, 3, "address name: PUBRUGAGDIL LN. No. 40 / TOGDILDAA; countries: X"), (2, None, "address address: aa0607663, 40 puburgagdil la."), (3, 3, "address address: Flat 2, 40 Puburgagdil Lane, Togdilda"), (4, 3, "address address: #2, 40 Puburgagdil Ln, Togdilda, AA06 07663"),
           (5, 3, "address address: P.O. Box 12, Togdilda, AA06 00006"), (6, 3, "address address: POB 12, Togdilda"), (7, 3, "address address: POB 12, Wumpapvu"), (8, 3, None), (9, 3, ""), (10, 3, "address countries: X"), (11, 2, "intermediary name: 40 Puburgagdil Lane, Togdilda"),
           (None, 3, "address address: 40 Puburgagdil Lane, Togdilda"), (12, 3, "address address: " + "x " * 60_000), (13, 3, "address address: 40a Puburgagdil Lane, Togdilda, AA06 07663")]
    got = pairs(addresses.same_location(entities(spark, (full + odd) * 2)))
    assert got == [(1, 2), (1, 140), (2, 140), (3, 4), (5, 6)]
    assert addresses.same_location(entities(spark, odd).limit(0)).count() == 0
    bare = [(1, 3, "address address: Old Mill, Togdilda, AA06 07663"), (2, 3, "address address: AA06-07663 Togdilda; Old Mill"), (3, 3, "address address: New Mill, Togdilda, AA06 07663"), (4, 3, "address address: Old Mill")]
    assert pairs(addresses.same_location(entities(spark, full + bare))) == [(1, 2)]
    dutch = [(i, 3, f"address address: {12 + i // 2} Puburgagdil Lane, Togdilda, 10{i % 2}7 AB") for i in range(4)]
    assert pairs(addresses.same_location(entities(spark, dutch), postcode=r"\b(\d{2})\d(\d) ?[a-z]{2}\b")) == [(0, 1), (2, 3)]
    assert sorted(tuple(r) for r in addresses.location_classes(entities(spark, full + odd)).collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 3, 1), (5, 5, 1), (6, 5, 1), (140, 1, 2)]


# names


def test_organisations():
    same = ["Cikakvulsuj Fund II S.A.", "CIKAKVULSUJ FD NO. 2 SOC. ANON.", "The Cikakvulsuj Fund (II)", "Soc. Anon. Cikakvulsuj Fnd 2", "Cikakvulsuj Fund (2) (S A)"]
    assert len({(o["core"], o["line"], o["number"]) for o in map(names.organisation, same)}) == 1
    assert names.organisation("Kicus Cywsym Aviat.")["line"] == "aviation" and names.organisation("gmbh xicywkubcik fnd 7")["number"] == 7
    for person in ("Samuel A. Popixconmam", "S. A. Syformerlal", "Adv. Christopher Geforcusweb", "Zachary Al-Deticguwdut (nominee)"):
        assert names.organisation(person) is None


def test_same_name(spark):
    nicks = spark.createDataFrame([("Sam", "Samuel"), ("Nick", "Nicholas"), ("Nick", "Dominic"), ("Liz", "Elizabeth"), (None, "X")], "nick string, formal string")
    base = []
    for i, (g, s) in enumerate(itertools.product(["Samuel", "Nicholas", "Dominic", "Elizabeth", "Katherine", "Kristopher"], ["Popixconmam", "Zyjuzheldil", "Gasewcikwaw", "Vuhahlaldop"])):
        base.append((1000 + i, 1, f"officer name: {g} {s}; countries: X"))
    of = lambda g, s: next(i for i, _, t in base if f"{g} {s};" in t)
    odd = [(1, 1, "officer name: POPIXCONMAM, SAM A."), (2, 0, "entity name: Dr. Samuél Popixcomam (deceased"), (3, 1, "officer name: Liz Zyjuz-Heldil"), (4, 1, "officer name: E. Zyjuzheldil"), (5, 1, "officer name: K Zyjuzheldil"), (6, 2, "intermediary name: Wogos Pixmiv Trading Inc."),
           (7, 0, "entity name: Wogos Pixmiv Trdg Incorporated"), (8, 0, "entity name: Wogos Pixmiv Capital Inc."), (9, 0, None), (10, 0, ""), (11, 3, "address name: Samuel Popixconmam"), (12, None, "officer name: Samuel Popixconmam"), (None, 1, "officer name: Samuel Popixconmam"), (13, 1, "officer name: " + "Very " * 30_000)]
    got = pairs(names.same_name(entities(spark, (base + odd) * 2), nicks))
    sam, liz = of("Samuel", "Popixconmam"), of("Elizabeth", "Zyjuzheldil")
    assert got == sorted([*itertools.combinations([1, 2, 12, sam], 2), *itertools.combinations([3, 4, liz], 2), (6, 7)])
    assert names.same_name(entities(spark, base).limit(0), nicks).count() == 0


def test_same_name_in_either_order(spark):
    nicks = spark.createDataFrame([("Sam", "Samuel")], "nick string, formal string")
    base = [(100 + i, 1, f"officer name: {g} {s}") for i, (g, s) in enumerate(itertools.product(["Gwendolyn", "Samuel", "Zachary"], ["Popixconmam", "Zyjuzheldil", "Gasewcikwaw", "Vuhahlaldop"]))]
    # Family names that open two spellings, so that they count as given names, and some that none else has.
    odd = ["Nymersofbef Gwendolyn", "NYMERSOFBEF GWENDOLYN", "Gwendolyn Nymersofbef", "Dywyrjembab Zachary", "DYWYRJEMBAB ZACHARY N.", "Zachary Dywyrjembab", "Qorvex Tildamun", "Tildamun Qorvex", "Wawaw Jajxys S.", "Wawawjajxys, Samuel"]
    got = pairs(names.same_name(entities(spark, base + [(i, 1, f"officer name: {n}") for i, n in enumerate(odd)]), nicks))
    assert got == sorted([*itertools.combinations([0, 1, 2], 2), *itertools.combinations([3, 4, 5], 2), (6, 7), (8, 9)])


def test_rare_and_short_given_names(spark):
    nicks = spark.createDataFrame([("Sam", "Samuel")], "nick string, formal string")
    fam = ["Popixconmam", "Zyjuzheldil", "Gasewcikwaw", "Vuhahlaldop", "Wosulbimtar", "Kebarnuzzol", "Tofimexlaru", "Hyrodancefi", "Jilvapsetum", "Qudornebbas", "Rexolimfuta", "Cabunditzor"]
    common = ["Alexander", "Benedict", "Cornelius", "Dominic", "Ferdinand", "Gwendolyn", "Hildegard", "Josephine", "Leonard", "Nathaniel", "Paula", "Samuel"]
    base = [f"{g} {f}" for g in common for f in fam] + [f"Paul {f}x" for f in fam[:4]]
    # Paul is as long as a short form of Paula may be, Marian near Marion, and both are rarer than the tenth commonest.
    odd = ["Paul Brixendolva", "P. Brixendolva", "Paula Brixendolva", "Paul Cestumarfil", "Paul Dozwimkarel", "Marian Ethoplynger", "Marian Fuzgaldomir", "Marion Fuzgaldomir", "Marion Gontrapilsed", "Marion Hexluvandom", "M. Ethoplynger"]
    rows = [(100 + i, 1, f"officer name: {n}") for i, n in enumerate(base)] + [(i, 1, f"officer name: {n}") for i, n in enumerate(odd)]
    got = pairs(names.same_name(entities(spark, rows), nicks))
    assert (0, 2) not in got and (5, 10) in got


def test_given_names(spark):
    counts = {"paula": 12, "paul": 5, "marion": 30, "marian": 25, "samuel": 30, "samu": 2, "samuell": 3, "alexander": 40, "cornelius": 40}
    code = lambda i: "".join("bcdfghklmnprtvwz"[(i >> s) & 15] + "aeiu"[(i >> s) & 3] for s in (0, 2, 4, 6, 8))
    rows = [(f"{w} {code(97 * k + i)}{w[:2]}q", 1) for k, (w, c) in enumerate(counts.items()) for i in range(c)] + [("Dr. L" + "o" * 100 + "ng X. Samue1", 1), ("lex Q.", 1)]
    read = names.read_names(spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "id long, value string"))[1]
    got = {r.word: r for r in names.given_names(read, names._nicks(spark.createDataFrame([("lex", "Alexander")], "nick string, formal string"))).collect()}
    form = lambda w: [(f.form, f.weight) for f in got[w].forms]
    assert all(form(w) == [(w, 1.0)] for w in ("paul", "paula", "marian", "marion"))
    assert form("samu")[0][0] == form("samuell")[0][0] == form("samuei")[0][0] == "samuel" and form("lex") == [("alexander", 0.8)]
    assert got["paula"].opens == 12 and got["lex"].opens == 41 and got["lex"].known and not got[spelling.short_id("l" + "o" * 100 + "ng")].known


def test_cuts_of_long_words_meet(spark):
    r = random.Random(2)
    base = "".join(r.choice("abcdefg") for _ in range(65))
    near = [base, base[:30] + base[31:], base[:64], base + "x", base[:10] + "zz" + base[11:], base[:40] + "q" + base[41:]]
    for a, b in itertools.combinations(near, 2):
        assert (set(spelling.hashed_cuts(a)) & set(spelling.hashed_cuts(b)) != set()) == (spelling.deletes(a) & spelling.deletes(b) != set())
    df = spark.createDataFrame(list(enumerate([*near, "y" * 200_000, "y" * 199_999])), "i int, w string")
    key = spelling.with_cuts(df, "w", "k")
    met = key.alias("a").join(key.alias("b"), "k").filter("a.i < b.i").select("a.i", "b.i").distinct().count()
    assert met == 1 + sum(bool(spelling.deletes(a) & spelling.deletes(b)) for a, b in itertools.combinations(near, 2))


# packing


def test_best_fit():
    r = random.Random(4)
    for one in (False, True):
        sizes = [r.randrange(1, 100) for _ in range(400)]
        conflicts = [[r.randrange(150), 1000 + i] for i in range(400)]
        sources = [r.choice("ab") for _ in sizes]
        bins = packing.best_fit(sizes, conflicts, sources, 100, one)
        for b in set(bins):
            mine = [i for i in range(400) if bins[i] == b]
            assert sum(sizes[i] for i in mine) <= 100 and (not one or len({sources[i] for i in mine}) == 1)
            keys = [k for i in mine for k in set(conflicts[i])]
            assert len(keys) == len(set(keys))
    assert packing.best_fit([10] * 3, [[1]] * 3, [None] * 3, 100) == [0, 1, 2] and packing.best_fit([], [], [], 9) == []


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, r, "clash") for i, t, s, r in rows], DOC)


def test_packing(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(1, 60))), r.choice(["A", None]), None) for i in range(300)]
    rows += [(1000, "word " * 500, "A", None), (1001, None, "A", None), (1002, "", None, None), (None, "x", "A", None), (1003, "Same Text", "A", None), (1004, "same  text ", "A", None), (1005, "new", "A", 1003)]
    d = documents(spark, rows + rows[:5])
    targets = spark.createDataFrame([("s", 64), ("l", 512)], "name string, capacity_tokens int")
    got = packing.pack(d, targets, shard=100).collect()
    enc = tokens.encoding(tokens.VOCABULARY)
    size = {i: tokens.count(t, enc) for i, t, _, _ in rows if i is not None}
    for name, cap in (("s", 64), ("l", 512)):
        mine = [x for x in got if x.name == name]
        held, of = collections.Counter(), collections.defaultdict(list)
        for x in mine:
            held[x.container] += x.tokens
            of[x.doc_id].append(x)
        assert max(held.values()) <= cap and {k: sum(x.tokens for x in v) for k, v in of.items()} == {k: n for k, n in size.items() if n}
        assert all(len(v) == 1 for k, v in of.items() if size[k] <= cap)
        assert len({of[k][0].container for k in (1003, 1004)}) == 2 and of[1005][0].container != of[1003][0].container
        assert sum(held.values()) / (len(held) * cap) > 0.9
    assert packing.fill_report(packing.pack(d, targets)).count() == 2 and packing.pack(d.limit(0), targets).count() == 0
    with pytest.raises(ValueError):
        packing.pack(d, spark.createDataFrame([("x", 0)], "name string, capacity_tokens int"))


def test_near_duplicates_are_apart(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randrange(1, 90))] for _ in range(60)]
    texts = {i: " ".join(b) for i, b in enumerate(base)}
    for i, b in enumerate(base):  # further texts with a few words changed, at an end or inside
        for j in range(3):
            c = ["Corrected", "reissue", *b] if j == 0 else [r.choice(words) if r.random() < 0.03 else w for w in b]
            texts[100 * (j + 1) + i] = " ".join(c)
    texts |= {1000: "!?", 1001: " ! ? ", 1002: "! ?", 1003: "short one", 1004: "Short  one!", 1005: None, 1006: ""}
    d = documents(spark, [(i, t, None, {1003: 1005, 7: 8}.get(i)) for i, t in texts.items()] + [(None, "short one", None, None)])
    shingles = {i: set(duplicates.runs(t).tolist()) for i, t in texts.items() if t and t.strip()}
    root = {i: i for i in texts}
    near = {(a, b) for a, b in itertools.combinations(sorted(shingles), 2) if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])}
    for _ in texts:
        for a, b in near | {(1003, 1005), (7, 8)}:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in duplicates.clusters(d).collect()}
    assert len(near) > 40 and {i: got.get(i, i) for i in texts} == root
    assert duplicates.clusters(d.limit(0)).count() == 0
    where = {x.doc_id: x.container for x in packing.pack(d, spark.createDataFrame([("x", 2048)], "name string, capacity_tokens int")).collect()}
    assert all(where[a] != where[b] for a, b in near)


def test_runs_of_many_texts_are_those_of_each():
    r = random.Random(3)
    texts = [" ".join(r.choice("abc") for _ in range(r.choice([0, 1, 4, 5, 6, 40]))) for _ in range(50)] + ["!?", "  ", "A b", "a  B"]
    for t, got in zip(texts, duplicates.runs_of(texts), strict=True):
        words = t.lower().split()
        want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        assert len(got) == len(want) and got.tolist() == duplicates.runs(t).tolist()
    assert duplicates.runs("A b").tolist() == duplicates.runs("a  B").tolist() and duplicates.runs_of([]) == []


def test_tokens_of_long_texts():
    enc = tokens.encoding(tokens.VOCABULARY)
    t = "the harbour dredging levy is late " * 20_000
    assert tokens.count(t, enc) == len(enc.encode_ordinary(t)) and tokens.count("x" * 500_000, enc) > 0 and tokens.count(None, enc) == 0


# mixing


def test_rates():
    r = np.random.default_rng(1)
    for mean, cap in ((0.3, 1), (1.7, 2), (3.9, 4), (0.01, 6)):
        rate = mixing.rate_for(mean, cap)
        assert mixing.mean_copies(rate, cap) == pytest.approx(mean, abs=1e-6) and np.minimum(r.poisson(rate, 200_000), cap).mean() == pytest.approx(mean, abs=0.02)
    for mean, cap in ((1, 3), (700, 701), (745, 2000), (800, 5000), (2500, 2501), (10_000, 100_000), (9_999.5, 10_000)):
        rate = mixing.rate_for(mean, cap)
        low, upto = mixing.chances(rate, cap)
        drawn = low + np.searchsorted(upto, r.random(100_000), side="right")
        assert mixing.mean_copies(rate, cap) == pytest.approx(mean, rel=1e-9) and drawn.mean() == pytest.approx(mean, rel=0.01) and drawn.max() <= cap
    assert mixing.rate_for(5, 5) == float("inf") and mixing.rate_for(0, 5) == 0.0 and mixing.mean_copies(0.0, 5) == 0.0


def test_mixture(spark):
    rows = [(i, "alpha beta gamma " * (1 + i % 5), ["Big", "big ", "small", "mid-dle", None, "other"][i % 6], None) for i in range(6000)] + [(9000, None, "big", None), (9001, "", "small", None)]
    d = documents(spark, rows + rows[:10])
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("mid_dle", 0.3, 2), ("absent", 0.1, 2), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    m, s = mixing.mixture(d, targets, seed=5)
    got = m.collect()
    share = {r.source: r for r in s.collect()}
    assert set(share) == {"big", "small", "mid_dle", "absent"} and share["absent"].tokens == 0
    for k, w in (("big", 0.5), ("small", 0.2), ("mid_dle", 0.3)):
        assert abs(share[k].actual_share - w) < 0.03 and share[k].most_copies <= share[k].max_repeats
        assert sum(r.tokens for r in got if r.source == k) == share[k].tokens
    assert [r.place for r in got] == sorted(r.place for r in got) and len({(r.doc_id, r["copy"]) for r in got}) == len(got)
    assert mixing.mixture(d, targets, seed=5)[0].collect() == got and mixing.mixture(d.limit(0), targets)[0].count() == 0
    assert mixing.mixture(d, targets, total=1e12)[1].filter("most_copies < max_repeats and documents > 0").count() == 0
    with pytest.raises(ValueError):
        mixing.mixture(d, targets.union(targets))


# spam


PROSE = "We heard from tenants in the capital that the forms run to sixty pages, and the minister has not answered the letter of the committee. "


def test_spam(spark):
    links = "\n".join(f"http://www.shop{i}.example/sofa/{i}" for i in range(30))
    tags = ", ".join(["buy sofa", "cheap sofa", "sofa sale", "best lamp"] * 20)
    menu = "\n".join(["Home > lamp > cheap lamp", "Related: sofa, buy lamp, best tent"] * 15)
    roll = "The House divided: Ayes 30, Noes 2.\nAyes:\n" + "\n".join(f"Name{chr(97 + i)}xy Surname{chr(97 + i)}ab" for i in range(26))
    rows = [(1, PROSE * 10), (2, links), (3, tags), (4, menu), (5, roll), (6, PROSE + links), (7, PROSE * 6 + "\nhttp://a.example/b\nhttp://c.example/d"), (8, None), (9, ""), (10, " \n "), (None, links), (11, PROSE + "\n" + tags), (12, PROSE * 4000), (13, (links + "\n") * 300)]
    rows += [(100 + i, PROSE * (2 + i % 5)) for i in range(60)]
    d = spark.createDataFrame([(i, t, "clash") for i, t in rows + rows[:4]], "doc_id long, text string, share string")
    assert sorted(r.doc_id for r in spam.spam_pages(d).collect()) == [2, 3, 4, 6, 11, 13]
    s = {r.doc_id: r for r in spam.page_shares(d).collect()}
    assert s[8].words == s[9].words == 0 and s[8].share == 0 and s[2].share == 1
    assert spam.spam_pages(d.limit(0)).count() == 0


def test_paths_equal_slow_viterbi():
    r, m = np.random.default_rng(3), spam.Model.first()
    docs = [np.stack([r.integers(0, b, n) for b in spam.BINS], 1) for n in (1, 2, 5, 4, 3)]
    k = len(spam.STATES)
    codes = [d @ spam._PLACES for d in docs]
    for d, got in zip(docs, m.paths(codes), strict=True):
        score = {}
        for path in itertools.product(range(k), repeat=len(d)):
            x = np.log(m.start[path[0]]) + sum(np.log(m.move[a, b]) for a, b in zip(path, path[1:], strict=False))
            score[path] = x + sum(np.log(m.emit[f][s, d[t, f]]) for t, s in enumerate(path) for f in range(len(spam.BINS)))
        best = max(score.values())
        assert score[tuple(got.tolist())] == pytest.approx(best)
    assert m.counts(codes).sum() == pytest.approx(5 + 10 + 15 * len(spam.BINS)) and m.counts([]).sum() == 0
    long = np.tile(codes[2], 30_000)  # far more pieces than go together: alone, with the same answer as among others
    alone, among = m.paths([long])[0], m.paths([*codes, long])
    assert (alone == among[-1]).all() and all((a == b).all() for a, b in zip(among, m.paths(codes), strict=False))
