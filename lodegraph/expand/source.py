"""Sources of edges to expand: tables for whole runs of requests, and an index for one run."""

from __future__ import annotations

import bisect
from abc import ABC, abstractmethod
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.skew import distributed_rank, salted_join

RELATIONS = 8


@dataclass(frozen=True)
class Relation:
    """A kind of edge between two domains, from ``start`` to ``end``."""

    name: str
    start: int
    end: int


@dataclass(frozen=True)
class Attr:
    """Holds for an entity that has an attribute with this value."""

    key: str
    value: str


@dataclass(frozen=True)
class Via:
    """Holds for an entity with a neighbour along ``rel`` for which ``then`` holds."""

    rel: int
    then: Attr | Via


def _edges(adj: DataFrame) -> DataFrame:
    return adj.select("id", "rel", "pos", "nbr").filter("id is not null and rel is not null and nbr is not null").groupBy("id", "rel", "nbr").agg(F.min("pos").alias("pos"))


def peek(adj: DataFrame) -> DataFrame:
    """``id`` and ``peek``: distinct edges of each relation, without fetching any."""
    from lodegraph.operators.profiles import relation_histogram

    h = relation_histogram(adj, RELATIONS)
    return h.select("id", F.array(*[F.col(f"n_{r}") for r in range(RELATIONS)]).alias("peek"))


def fetch(adj: DataFrame, picks: DataFrame) -> DataFrame:
    """The edges of many requests at once: ``id``, ``rel``, ``nbr`` and its place ``at``.

    ``picks`` has ``id``, ``rel``, ``offset`` and ``limit``; places count from 0 in the order of ``pos``, then ``nbr``. Only what is
    asked for is placed, by a distributed rank, so that an entity with very many edges takes no task for itself.
    """
    asked = picks.select("id", "rel", "offset", "limit")
    edges = salted_join(_edges(adj), asked.select("id", "rel").distinct(), ["id", "rel"], [F.col("nbr")], "left_semi")
    placed = distributed_rank(edges, ["pos", "nbr"], ["id", "rel"], "at")
    got = salted_join(placed, asked, ["id", "rel"], [F.col("at")])
    return got.filter((F.col("at") >= F.col("offset")) & (F.col("at") < F.col("offset") + F.col("limit")))


def label_depth(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """``id``, ``rel``, ``depth``: at which place (from 0) an entity's first labelled neighbour of a relation is listed."""
    placed = distributed_rank(_edges(adj), ["pos", "nbr"], ["id", "rel"], "at")
    return placed.join(labels.select(F.col("id").alias("nbr")).distinct(), "nbr", "left_semi").groupBy("id", "rel").agg(F.min("at").alias("depth"))


def semi_join_chain(adj: DataFrame, attrs: DataFrame, rel: int, via: Sequence[int], key: str, value: str) -> DataFrame:
    """Edges along ``rel`` whose far end leads over the relations ``via`` to an entity with an attribute: ``id``, ``rel``, ``nbr``.

    ``attrs`` has ``id``, ``key`` and ``value``. One semi-join for each step, from the target back.
    """
    e = adj.select("id", "rel", "nbr").dropna().distinct()
    ok = attrs.filter((F.col("key") == key) & (F.col("value") == value)).select(F.col("id").alias("nbr")).distinct()
    for r in reversed(via):
        ok = e.filter(F.col("rel") == r).join(ok, "nbr", "left_semi").select(F.col("id").alias("nbr")).distinct()
    return e.filter(F.col("rel") == rel).join(ok, "nbr", "left_semi").select("id", "rel", "nbr")


class Source(ABC):
    """What an expansion run asks of the outside: counts are free, edges are paid for one by one."""

    domains: Sequence[str]
    relations: Sequence[Relation]
    can_filter = False

    @abstractmethod
    def domain(self, id_: int) -> int: ...

    def attrs(self, id_: int) -> dict[str, str]:
        return {}

    def text(self, id_: int) -> str:
        return ""

    @abstractmethod
    def peek(self, id_: int) -> list[int]: ...

    @abstractmethod
    def fetch(self, id_: int, rel: int, offset: int, limit: int) -> list[int]: ...

    def fetch_where(self, id_: int, rel: int, test: Attr | Via, limit: int) -> list[int] | None:
        """Neighbours that pass a filter; None if this source cannot filter."""
        return None


class World(Source):
    """A source in memory: sorted adjacency for each relation."""

    can_filter = True

    def __init__(self, domains: Sequence[str], relations: Sequence[Relation], domain_of: Sequence[int], edges: Iterable[tuple[int, int, int]], attrs: dict[int, dict[str, str]] | None = None, texts: dict[int, str] | None = None):
        self.domains, self.relations, self.domain_of = domains, relations, domain_of
        self.attributes, self.texts, self.scanned = attrs or {}, texts or {}, 0
        out: dict[tuple[int, int], set[int]] = {}
        for a, b, r in edges:
            out.setdefault((a, r), set()).add(b)
            out.setdefault((b, r), set()).add(a)
        self.adj = {k: sorted(v) for k, v in out.items()}

    def __len__(self) -> int:
        return len(self.domain_of)

    def domain(self, id_: int) -> int:
        return self.domain_of[id_]

    def attrs(self, id_: int) -> dict[str, str]:
        return self.attributes.get(id_, {})

    def text(self, id_: int) -> str:
        return self.texts.get(id_, "")

    def peek(self, id_: int) -> list[int]:
        return [len(self.adj.get((id_, r), ())) for r in range(RELATIONS)]

    def degree(self, id_: int) -> int:
        return sum(self.peek(id_))

    def fetch(self, id_: int, rel: int, offset: int, limit: int) -> list[int]:
        return self.adj.get((id_, rel), [])[offset : offset + limit]

    def matches(self, id_: int, test: Attr | Via) -> bool:
        if isinstance(test, Attr):
            return self.attrs(id_).get(test.key) == test.value
        return any(self.matches(n, test.then) for n in self.adj.get((id_, test.rel), ()))

    def fetch_where(self, id_: int, rel: int, test: Attr | Via, limit: int) -> list[int]:
        out = []
        for n in self.adj.get((id_, rel), ()):
            self.scanned += 1
            if self.matches(n, test):
                out.append(n)
                if len(out) == limit:
                    break
        return out

    def linked(self, a: int, b: int, rel: int) -> bool:
        row = self.adj.get((a, rel), [])
        at = bisect.bisect_left(row, b)
        return at < len(row) and row[at] == b
