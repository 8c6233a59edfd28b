"""Policies: which candidates to expand, in which order, and how much of each."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegraph.expand.source import RELATIONS, Attr, Relation, Via

UNREACHED = (1 << 32) - 1


@dataclass
class Task:
    """An intent. ``goal`` is connect, alert or explore; ``shape`` lists the domains along a hit, by distance from the seed."""

    prompt: str = ""
    seeds: list[int] = field(default_factory=list)
    goal: str = "explore"
    relation_interest: list[float] = field(default_factory=lambda: [1.0] * RELATIONS)
    domain_interest: list[float] = field(default_factory=lambda: [1.0] * RELATIONS)
    watch: str | None = None
    standing: list[str] = field(default_factory=list)
    target: Attr | Via | None = None
    shape: list[list[int]] = field(default_factory=list)
    probes: list[str] = field(default_factory=list)
    budget: int = 1000


@dataclass
class Candidate:
    """What a policy sees of an entity; the two numbers of ``hops`` and ``cost`` are the two sides of a connect task."""

    id: int
    domain: int
    peek: list[int]
    fetched: list[int]
    hops: list[int] = field(default_factory=lambda: [UNREACHED, UNREACHED])
    cost: list[float] = field(default_factory=lambda: [math.inf, math.inf])
    known: int = 0
    known_by_domain: list[int] = field(default_factory=lambda: [0] * RELATIONS)
    watched: int = 0
    is_watched: bool = False
    alerts: int = 0
    probes: int | None = None
    pushed: list[bool] = field(default_factory=lambda: [False] * RELATIONS)

    def remaining(self) -> list[int]:
        return [max(p - f, 0) for p, f in zip(self.peek, self.fetched, strict=True)]

    def nearest(self) -> int:
        return min(self.hops)

    def side(self) -> int:
        return int(self.hops[1] < self.hops[0])


@dataclass(frozen=True)
class Take:
    rel: int
    limit: int
    filter: Attr | Via | None = None


@dataclass
class Decision:
    """Nothing is expanded without ``take``; higher priorities go first."""

    priority: float = 0.0
    take: list[Take] = field(default_factory=list)


@dataclass
class Context:
    relations: Sequence[Relation] = ()
    filters: bool = False
    fetched: int = 0
    by_side: list[int] = field(default_factory=lambda: [0, 0])
    budget: int = 0
    steps: int = 0


class Policy(ABC):
    #: A round takes only candidates whose priority is this near the round's best.
    spread = math.inf

    @abstractmethod
    def name(self) -> str: ...

    @abstractmethod
    def decide(self, task: Task, ctx: Context, batch: Sequence[Candidate]) -> list[Decision]: ...


def _all(c: Candidate, want) -> list[Take]:
    return [Take(r, n) for r, n in enumerate(c.remaining()) if n and want(r)]


@dataclass
class Bfs(Policy):
    """Everything, nearest first, to a depth."""

    depth: int

    def name(self) -> str:
        return f"bfs(depth={self.depth})"

    def decide(self, task: Task, ctx: Context, batch: Sequence[Candidate]) -> list[Decision]:
        return [Decision(-float(c.nearest()), _all(c, lambda r: True)) if c.nearest() < self.depth else Decision() for c in batch]


@dataclass
class Rules(Policy):
    """The task's relations only, to a depth, and no entity with more than ``cap`` edges."""

    depth: int
    cap: int

    def name(self) -> str:
        return f"rules(depth={self.depth}, cap={self.cap})"

    def decide(self, task: Task, ctx: Context, batch: Sequence[Candidate]) -> list[Decision]:
        fits = lambda c: c.nearest() < self.depth and sum(c.peek) <= self.cap
        return [Decision(-float(c.nearest()), _all(c, lambda r: task.relation_interest[r] > 0)) if fits(c) else Decision() for c in batch]


@dataclass
class Guided(Policy):
    """Cheapest specific routes first, weighed by what the task cares about and by signals; optionally with pushdown."""

    pushdown: bool = False
    spread = 1.0

    def name(self) -> str:
        return "guided+pushdown" if self.pushdown else "guided"

    def decide(self, task: Task, ctx: Context, batch: Sequence[Candidate]) -> list[Decision]:
        breadth = max((ctx.budget - ctx.fetched) // 64 if ctx.budget > ctx.fetched else 0, 16)
        return [self._one(task, ctx, c, breadth) for c in batch]

    def _one(self, task: Task, ctx: Context, c: Candidate, breadth: int) -> Decision:
        left = c.remaining()
        wanted = [r for r in range(RELATIONS) if task.relation_interest[r] > 0 and left[r]]
        signal = 1 + 4 * (c.watched + c.is_watched) + 8 * c.alerts + 2 * math.log1p(c.probes or 0)
        interest = task.domain_interest[c.domain] if c.domain < len(task.domain_interest) else 0.0
        weight = interest * signal * fit(task, c)
        if not wanted or weight <= 0:
            return Decision()
        route = min(c.cost)
        if self.pushdown and (push := pushed_fetch(task, ctx, c)):
            return Decision(-(route + math.log(2)) / weight, [Take(push[0], breadth, push[1])])
        cost = route + math.log1p(sum(left[r] for r in wanted))
        return Decision(-cost / weight, [Take(r, min(left[r], breadth)) for r in wanted])


def fit(task: Task, c: Candidate) -> float:
    """1 if the candidate's domain and distance can extend a hit of the task's shape, or without a shape; else a twentieth."""
    at = c.nearest()
    extends = any(at + 1 < len(s) and s[at] == c.domain for s in task.shape)
    return 1.0 if extends or not task.shape else 0.05


def between(relations: Sequence[Relation], a: int, b: int) -> int | None:
    """The relation that joins two domains, either way round."""
    return next((i for i, r in enumerate(relations) if {(r.start, r.end)} & {(a, b), (b, a)}), None)


def pushed_fetch(task: Task, ctx: Context, c: Candidate) -> tuple[int, Attr | Via] | None:
    """The filtered request that leads from a candidate on the task's shape towards its target."""
    if not ctx.filters or task.target is None:
        return None
    at = c.nearest()
    for s in task.shape:
        if at + 1 >= len(s) or s[at] != c.domain:
            continue
        steps = [between(ctx.relations, a, b) for a, b in zip(s[at:], s[at + 1 :], strict=False)]
        if None in steps:
            continue
        test = task.target
        for rel in reversed(steps[1:]):
            test = Via(rel, test)
        if not c.pushed[steps[0]]:
            return steps[0], test
    return None


def guided_priority(remaining: Column, cost: Column, domain: Column, relation_interest: Sequence[float], domain_interest: Sequence[float], signal: Column | None = None, fits: Column | None = None) -> Column:
    """``Guided``'s priority for a whole table of candidates; null where it would expand nothing."""
    at = lambda r: F.coalesce(F.get(remaining, F.lit(r)), F.lit(0)).cast("double")
    left = sum((at(r) for r, i in enumerate(relation_interest) if i > 0), F.lit(0.0))
    interest = F.coalesce(F.get(F.array(*[F.lit(float(i)) for i in domain_interest]), domain.cast("int")), F.lit(0.0))
    weight = interest * (F.lit(1.0) if signal is None else signal) * (F.lit(1.0) if fits is None else fits)
    return F.when((left > 0) & (weight > 0), -(cost + F.log1p(left)) / weight)
