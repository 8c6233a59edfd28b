"""Made-up worlds to expand: power-law graphs, with planted things to find."""

from __future__ import annotations

import numpy as np

from lodegraph.expand.policy import Task
from lodegraph.expand.source import RELATIONS, Attr, Relation, World

# The domains with their shares and the exponents of their popularity, and the relations with their ends and edges per entity.
DOMAINS = ("person", "org", "phone", "email", "account", "ip", "device")
SHARES = (0.40, 0.02, 0.10, 0.10, 0.20, 0.08, 0.10)
EXPONENTS = (0.2, 1.1, 0.5, 0.3, 0.4, 1.0, 0.6)
_RELATIONS = (("works_at", 0, 1, 0.40), ("has_phone", 0, 2, 0.24), ("has_email", 0, 3, 0.32), ("owns", 0, 4, 0.48), ("login_from", 4, 5, 0.80), ("uses_device", 4, 6, 0.30), ("registered_with", 4, 3, 0.20))
WORLD_RELATIONS = tuple(Relation(n, a, b) for n, a, b, _ in _RELATIONS)


class Builder:
    """A world in the making: entities of each domain, edges, attributes."""

    def __init__(self, n: int, seed: int):
        self.rng = np.random.default_rng(seed)
        self.domain: list[int] = []
        self.of: dict[int, list[int]] = {d: [] for d in range(len(DOMAINS))}
        self.edges: set[tuple[int, int, int]] = set()
        self.attrs: dict[int, dict[str, str]] = {}
        for d, share in enumerate(SHARES):
            for _ in range(max(2, int(n * share))):
                self.entity(d)
        for r, (_, a, b, per) in enumerate(_RELATIONS):
            for x, y in zip(self.popular(a, int(n * per)), self.popular(b, int(n * per)), strict=True):
                self.link(int(x), int(y), r)

    def entity(self, d: int) -> int:
        self.domain.append(d)
        self.of[d].append(len(self.domain) - 1)
        return len(self.domain) - 1

    def popular(self, d: int, k: int) -> np.ndarray:
        """``k`` entities of a domain, the i-th drawn in proportion to (i + 1) to the power of minus the domain's exponent."""
        w = np.arange(1, len(self.of[d]) + 1, dtype=float) ** -EXPONENTS[d]
        return np.asarray(self.of[d])[np.searchsorted(np.cumsum(w) / w.sum(), self.rng.random(k))]

    def link(self, a: int, b: int, r: int) -> None:
        if a != b:
            self.edges.add((min(a, b), max(a, b), r))

    def degrees(self) -> np.ndarray:
        d = np.zeros(len(self.domain), int)
        for a, b, _ in self.edges:
            d[a] += 1
            d[b] += 1
        return d

    def around(self, d: int, degree: float) -> int:
        """The entity of a domain whose number of edges is nearest to ``degree``."""
        n = self.degrees()
        return min(self.of[d], key=lambda x: (abs(n[x] - degree), x))

    def busiest(self, d: int, place: int = 0) -> int:
        n = self.degrees()
        return sorted(self.of[d], key=lambda x: (-n[x], x))[place]

    def chain(self, start: int, steps: list[tuple[int, int]]) -> set[tuple[int, int, int]]:
        """Links ``start`` to the first of (entity, relation), that to the next, and so on; the edges."""
        out = set()
        for x, r in steps:
            self.link(start, x, r)
            out.add((min(start, x), max(start, x), r))
            start = x
        return out

    def build(self) -> World:
        return World(DOMAINS, WORLD_RELATIONS, self.domain, sorted(self.edges), self.attrs)


def random_world(n: int, seed: int = 1) -> World:
    return Builder(n, seed).build()


def planted_path(n: int, seed: int = 1, budget: int = 20_000) -> tuple[World, Task, set[tuple[int, int, int]]]:
    """Two people joined by five edges over quiet entities: person - phone - person - account - device - account."""
    b = Builder(n, seed)
    path = [b.entity(d) for d in (0, 2, 0, 4, 6, 4)]
    rels = [1, 1, 3, 5, 5]
    for x, y, r in zip(path, path[1:], rels, strict=False):
        b.link(x, y, r)
    for p in path:
        if b.domain[p] == 0:
            b.link(p, int(b.popular(1, 1)[0]), 0)
    truth = {(min(x, y), max(x, y), r) for x, y, r in zip(path, path[1:], rels, strict=False)}
    return b.build(), Task("How are they connected?", [path[0], path[-1]], "connect", budget=budget), truth


def planted_alert(n: int, seed: int = 1, budget: int = 20_000, colleagues: int = 200) -> tuple[World, Task]:
    """A person whose busy employer also employs one watched person."""
    b = Builder(n, seed)
    seed_, org = b.entity(0), b.entity(1)
    b.link(seed_, org, 0)
    staff = [b.entity(0) for _ in range(colleagues)]
    for s in staff:
        b.link(s, org, 0)
    b.attrs[staff[int(b.rng.integers(len(staff)))]] = {"flag": "watched"}
    interest = [0.0] * RELATIONS
    interest[0] = 1.0
    task = Task("Alert when a colleague is watched.", [seed_], "alert", interest, standing=[f'n(type="person", value="{seed_}")-n(type="org")-n(type="person", flag="watched")'], target=Attr("flag", "watched"), shape=[[0, 1, 0]], budget=budget)
    return b.build(), task


PERSON, ORG, PHONE, EMAIL, ACCOUNT, IP, DEVICE = range(7)
WORKS, HAS_PHONE, HAS_EMAIL, OWNS, LOGIN, USES, REGISTERED = range(7)
Edge = tuple[int, int, int]
# How much each relation and domain matters to a task.
_MONEY = ([0.05, 0.2, 0.5, 1.0, 1.0, 1.0, 1.0, 0.0], [1.0, 0.05, 0.3, 0.7, 1.0, 0.8, 0.8, 0.0])
_PIVOT = ([0.0, 0.2, 0.2, 1.0, 1.0, 0.2, 0.2, 0.0], [1.0, 0.0, 0.2, 0.2, 1.0, 1.0, 0.2, 0.0])
_WATCH = ([0.0, 0.2, 0.2, 1.0, 0.1, 0.2, 0.2, 0.0], [1.0, 0.0, 0.2, 0.2, 1.0, 0.2, 0.2, 0.0])
_MAP = ([0.3, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0], [1.0, 0.3, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0])


def _decoy(b: Builder, owner: int, place: int) -> None:
    """An account of the owner that logs in where very many do."""
    account = b.entity(ACCOUNT)
    b.link(owner, account, OWNS)
    b.link(account, b.busiest(IP, place), LOGIN)


def _five(b: Builder, budget: int) -> tuple[Task, set[Edge]]:
    one, two = b.entity(PERSON), b.entity(PERSON)
    first = b.entity(ACCOUNT)
    truth = b.chain(one, [(first, OWNS), (b.around(IP, 200), LOGIN), (b.entity(ACCOUNT), LOGIN), (b.entity(EMAIL), REGISTERED), (two, HAS_EMAIL)])
    for x in (one, two):
        b.link(x, b.busiest(ORG), WORKS)
    b.link(first, b.busiest(IP), LOGIN)
    _decoy(b, two, 0)
    return Task("How does money get from one to the other?", [one, two], "connect", *map(list, _MONEY), budget=budget), truth


def _seven(b: Builder, budget: int) -> tuple[Task, set[Edge]]:
    one, two = b.entity(PERSON), b.entity(PERSON)
    steps = [(b.entity(EMAIL), HAS_EMAIL), (b.entity(ACCOUNT), REGISTERED), (b.around(DEVICE, 500), USES), (b.entity(ACCOUNT), USES), (b.around(IP, 50), LOGIN), (b.entity(ACCOUNT), LOGIN), (two, OWNS)]
    truth = b.chain(one, steps)
    for x, place in ((one, 0), (two, 1)):
        b.link(x, b.busiest(ORG, 1 - place), WORKS)
        _decoy(b, x, place)
    return Task("How does money get from one to the other?", [one, two], "connect", *map(list, _MONEY), budget=budget), truth


def _pivot(b: Builder, budget: int) -> tuple[Task, set[Edge]]:
    me, them = b.entity(PERSON), b.entity(PERSON)
    b.attrs[me], b.attrs[them] = {"watch": "S"}, {"watch": "T"}
    place = b.around(IP, 5000)
    b.chain(me, [(b.entity(ACCOUNT), OWNS), (place, LOGIN)])
    truth = b.chain(them, [(b.entity(ACCOUNT), OWNS), (place, LOGIN)])
    b.link(me, b.busiest(ORG), WORKS)
    for busy in (0, 1):
        _decoy(b, me, busy)
    names = ["person", "account", "ip", "account", "person"]
    slots = [f"n(type='{n}'" + {0: ", watch='S'", 4: ", watch='T'"}.get(i, "") + ")" for i, n in enumerate(names)]
    shape = [[DOMAINS.index(n) for n in names]]
    return Task("Whom on list T does this person share a login with?", [me], "alert", *map(list, _PIVOT), watch="watch", standing=["-".join(slots)], target=Attr("watch", "T"), shape=shape, budget=budget), truth


def _shared(b: Builder, budget: int) -> tuple[Task, set[Edge]]:
    me, partner = b.entity(PERSON), b.entity(PERSON)
    people = b.of[PERSON][:-2]
    for x in b.rng.choice(people, max(1, len(people) * 3 // 1000), replace=False):
        b.attrs[int(x)] = {"watch": "B"}
    b.attrs[me], b.attrs[partner] = {"watch": "A"}, {"watch": "B"}
    b.link(me, b.busiest(ORG), WORKS)
    busy = [b.busiest(IP, 0), b.busiest(IP, 1)]
    accounts = [b.entity(ACCOUNT) for _ in range(30)]
    for i, a in enumerate(accounts):
        b.chain(me, [(a, OWNS), (busy[i % 3 == 0], LOGIN)])
    truth = b.chain(partner, [(accounts[17], OWNS)])
    text = "n(type='person', watch='A')-n(type='account')-n(type='person', watch='B')"
    return Task("Alert when this person shares an account with anyone on list B.", [me], "alert", *map(list, _WATCH), watch="watch", standing=[text], target=Attr("watch", "B"), shape=[[PERSON, ACCOUNT, PERSON]], budget=budget), truth


def _explore(b: Builder, budget: int) -> tuple[Task, set[Edge]]:
    return Task("Whom is this person connected to?", [b.around(PERSON, 20)], "explore", *map(list, _MAP), probes=["n(ID=[id])-n()-n(type='person')"], budget=budget), set()


SCENARIOS = {"path-5hop": _five, "path-7hop": _seven, "pivot-busy": _pivot, "alert": _shared, "explore": _explore}


def scenario(name: str, n: int, seed: int = 1, budget: int = 20_000) -> tuple[World, Task, set[Edge]]:
    """A world of about ``n`` entities with something planted, the task to find it, and the edges that are the answer.

    ``path-5hop`` and ``path-7hop`` join two people over an address or device that many share; ``pivot-busy`` leads
    from a watched person over an address of very many accounts to another; in ``alert`` one of thirty accounts is
    shared with a watched person; ``explore`` maps a neighbourhood and probes the graph before each step.
    """
    b = Builder(n, seed)
    task, truth = SCENARIOS[name](b, budget)
    return b.build(), task, truth
