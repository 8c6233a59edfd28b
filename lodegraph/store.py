"""A folder of graphs: listing, permissions, queries across graphs, and the calls of a graph service as methods."""

from __future__ import annotations

import json
import re
import shutil
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from http import HTTPStatus
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import ingest
from lodegraph.bulk import written
from lodegraph.functions.json_values import merge
from lodegraph.lgql import parse, query, standing
from lodegraph.lgql.predicates import descend, holds
from lodegraph.lgql.parser import ParseError
from lodegraph.log import View
from lodegraph.natives import degrees, neighbour_counts
from lodegraph.schema import LOG, shred
from lodegraph.writer import Locked, NotFound, Stored

KV = "kv"
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")


class Refused(PermissionError):
    pass


@dataclass(frozen=True)
class Who:
    """Whoever asks: a user, and the roles in which they ask (none: in any they have)."""

    user: str | None = None
    roles: tuple[str, ...] = ()


def roles_of(meta: dict[str, Any], user: str) -> set[str]:
    """The roles that a graph's ``roles`` gives a user: the keys of an object with a true value, or the words of anything else."""
    roles = meta.get("roles")
    given = roles.get(user) if isinstance(roles, dict) else None
    if isinstance(given, dict):
        return {k for k, v in given.items() if v}
    if given is None:
        return set()
    return {w for w in re.split(r"\W+", given if isinstance(given, str) else json.dumps(given)) if w}


def allowed(meta: dict[str, Any], who: Who) -> bool:
    """A graph without ``roles`` is open to all; else the user must have a role of it, one of those asked for if any are."""
    if "roles" not in meta:
        return True
    have = roles_of(meta, who.user) if who.user else set()
    return bool(have & set(who.roles)) if who.roles else bool(have)


class Store:
    """Graphs by UUID below a folder. Every method that names a graph checks the permissions of ``who`` first."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, Path(path)

    def _stored(self, id_: str) -> Stored:
        if not _UUID.fullmatch(id_):
            raise ValueError("not a UUID")
        return Stored(self.path / id_)

    def graph(self, id_: str, who: Who = Who()) -> Stored:
        g = self._stored(id_)
        if not (g.path / "manifest.json").exists():
            raise LookupError(id_)
        if not allowed(g.props(), who):
            raise Refused(id_)
        return g

    def exists(self, id_: str) -> bool:
        return (self._stored(id_).path / "manifest.json").exists()

    def create(self, body: dict[str, Any] | None = None, id_: str | None = None) -> str:
        id_ = id_ or str(uuid.uuid1())
        with self._stored(id_).write() as t:
            ingest.apply(t, body or {}, create=True)
        return id_

    def post(self, id_: str, body: dict[str, Any], create: bool = False, who: Who = Who()) -> dict[str, int]:
        """Writes an input; ``max_id`` and ``updates`` say what was logged."""
        with self.graph(id_, who).write() as t:
            n = ingest.apply(t, body, create)
            return {"max_id": t.next_id() - 1, "updates": n}

    def delete(self, id_: str, who: Who = Who()) -> None:
        shutil.rmtree(self.graph(id_, who).path)

    def adopt(self, id_: str, log: DataFrame) -> None:
        """Takes over a whole log from elsewhere; an existing graph is an error."""
        if self.exists(id_):
            raise FileExistsError(id_)
        missing = {f.name for f in LOG.fields} - set(log.columns)
        if missing:
            raise ValueError(f"not a log: {sorted(missing)} missing")
        g = self._stored(id_)
        g.append(self.spark, lambda history: log.select(*LOG.names))

    def ingest(self, id_: str, nodes: DataFrame | None = None, edges: DataFrame | None = None, props: DataFrame | None = None, who: Who = Who()) -> int:
        """Writes whole tables (see ``bulk.written``); the number of new log rows."""
        return self.graph(id_, who).append(self.spark, lambda history: written(history, nodes, edges, props))

    def reset(self, id_: str, seeds: bool = True, kv: bool = True, who: Who = Who()) -> None:
        """Erases a graph but for its seeds, which are put in again, and its kv, unless told otherwise."""
        with self.graph(id_, who).write() as t:
            old_seeds, old_kv = [v for _, v in t.kv_iter(ingest.SEEDS)], dict(t.kv.get(KV, {}))
            t.reset()
            if kv:
                t.kv[KV] = old_kv
            for s in old_seeds if seeds else []:
                ingest.apply(t, s, create=True)

    def seeds(self, id_: str, who: Who = Who()) -> list[Any]:
        return [v for _, v in sorted(self.graph(id_, who).side()["kv"].get(ingest.SEEDS, {}).items())]

    def meta(self, id_: str, new: dict[str, Any] | None = None, who: Who = Who()) -> dict[str, Any]:
        g = self.graph(id_, who)
        if not new:
            return g.props()
        with g.write() as t:
            for k, v in new.items():
                ingest.merged(t, 0, k, v)
            return t.props(0)

    def kv(self, id_: str, key: str | None = None, put: Any = None, replace: bool = False, remove: bool = False, who: Who = Who()) -> Any:
        """All of a graph's kv, or one key; a value given is merged in, or replaces with ``replace``."""
        g = self.graph(id_, who)
        if put is None and not remove:
            have = g.side()["kv"].get(KV, {})
            return dict(sorted(have.items())) if key is None else have.get(key)
        with g.write() as t:
            if remove:
                for k in [key] if key is not None else [k for k, _ in t.kv_iter(KV)]:
                    t.kv_del(KV, k)
            elif put is not None:
                for k, v in ({key: put} if key is not None else put).items():
                    t.kv_put(KV, k, v if replace else merge(t.kv_get(KV, k), v))
            return dict(t.kv_iter(KV)) if key is None else t.kv_get(KV, key)

    def object(self, id_: str, entry: int, new: dict[str, Any] | None = None, who: Who = Who()) -> dict[str, Any]:
        """A live node or edge with its own fields and its properties; ``new`` is merged in first.

        A node has its counts of edges and neighbours, an edge the summaries of its ends instead of their ids.
        """
        g = self.graph(id_, who)
        if new is not None:
            with g.write() as t:
                e = t.live(entry)
                (ingest.node if e.kind == "node" else ingest.edge)(t, {**new, "ID": entry})
                ingest.depths(t, t.start + 1)
        row, props = g.object(self.spark, entry)
        if row is None:
            raise NotFound(f"{entry} is no live node or edge")
        return rendered(self.spark, g.history(self.spark), row) | props

    def status(self, id_: str, who: Who = Who()) -> dict[str, Any]:
        g = self.graph(id_, who)
        nodes, edges = g.counts()
        meta = g.props()
        return {"graph": id_, "enabled": meta.get("enabled", True), "nodes_count": nodes, "edges_count": edges, "maxID": g.next_id() - 1, "size": g.size(), "meta": meta}

    def list(self, who: Who = Who(), enabled: bool | None = None, filters: Sequence[str] = (), created_after: float | None = None, created_before: float | None = None) -> list[dict[str, Any]]:
        """Status of every graph that ``who`` may see; ``filters`` are patterns of one slot on the status, any of which must match."""
        rows = []
        for p in sorted(self.path.iterdir()) if self.path.exists() else []:
            if not _UUID.fullmatch(p.name):
                continue
            try:
                s = self.status(p.name, who)
            except (Refused, LookupError):
                continue
            u = uuid.UUID(p.name)
            s["created"] = (u.time - 0x01B21DD213814000) / 1e7 if u.version == 1 else None
            if enabled is not None and s["enabled"] != enabled:
                continue
            if created_after is not None and (s["created"] is None or s["created"] <= created_after):
                continue
            if created_before is not None and (s["created"] is None or s["created"] >= created_before):
                continue
            rows.append(s)
        return [s for s, ok in zip(rows, matches(self.spark, rows, filters), strict=True) if ok] if filters else rows

    def view(self, id_: str, stop: int | None = None, who: Who = Who()) -> View:
        """The graph as it is, or as it was after position ``stop``."""
        return View(self.graph(id_, who).history(self.spark), None if stop is None else stop + 1)

    def query(self, id_: str, texts: Iterable[str], start: int | None = None, stop: int | None = None, limit: int = 0, who: Who = Who()) -> DataFrame:
        """``pattern``, ``chain`` (and ``at`` with ``start``) for the distinct patterns in their sorted order."""
        texts = sorted(set(texts))
        if start is None:
            return query(self.view(id_, stop, who), texts, limit)
        if start < 1:
            raise ValueError("start must be positive")
        s = standing(self.graph(id_, who).history(self.spark), texts, start, stop)
        return s.orderBy("at", "pattern").limit(limit) if limit else s

    def answer(self, id_: str, texts: Iterable[str], limit: int = 0, who: Who = Who()) -> Iterator[Any]:
        """A query's answer as the service gives it: first the sorted distinct patterns, then ``[pattern, [object, ..]]`` for each chain."""
        texts = sorted(set(texts))
        yield texts
        for r in self.query(id_, texts, limit=limit, who=who).toLocalIterator():
            yield [r.pattern, [{"ID": c.id, "type": c.type, "value": c.value} | ({"srcID": c.src, "tgtID": c.tgt} if c.kind == "edge" else {}) for c in r.chain]]

    def headers(self, id_: str, updates: int | None = None) -> dict[str, str]:
        """What an answer's headers say of the graph: its greatest id, and how many rows a write logged."""
        out = {"X-lg-maxID": str(self._stored(id_).next_id() - 1)}
        return out | ({} if updates is None else {"X-lg-updates": str(updates)})

    def query_all(self, texts: Iterable[str], who: Who = Who()) -> DataFrame:
        """The same over every graph that ``who`` may see, with the graph's id first."""
        texts, out = sorted(set(texts)), None
        for s in self.list(who):
            part = query(self.view(s["graph"], None, who), texts).select(F.lit(s["graph"]).alias("graph"), "pattern", "chain")
            out = part if out is None else out.union(part)
        if out is None:
            raise LookupError("no graph")
        return out

    def crawl(self, id_: str, texts: Iterable[str], who: Who = Who()) -> DataFrame:
        """``id`` of every node connected to a node or edge that the patterns find."""
        from lodegraph.algo.paths import closure

        v = self.view(id_, None, who)
        found = self.query(id_, texts, who=who).select(F.explode("chain").alias("c"))
        seeds = found.select(F.coalesce("c.src", "c.id").alias("id"))
        return closure(v.edges.select(F.col("src").alias("id"), F.col("tgt").alias("nbr")), seeds)

    def dump(self, id_: str, who: Who = Who()) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges with their properties as JSON text."""
        v = self.view(id_, None, who)
        props = v.props.groupBy("parent").agg(F.concat(F.lit("{"), F.concat_ws(",", F.array_sort(F.collect_list(F.concat(F.to_json(F.struct("key")).substr(F.lit(8), F.length(F.to_json(F.struct("key"))) - 8), F.lit(":"), "val_json")))), F.lit("}")).alias("props"))
        p = props.select(F.col("parent").alias("_p"), "props")
        add = lambda df: df.join(p, F.col("id") == F.col("_p"), "left").drop("_p").withColumn("props", F.coalesce("props", F.lit("{}")))
        nodes = add(v.nodes).join(degrees(v), "id").join(neighbour_counts(v), "id")
        return nodes, add(v.edges)

    def d3(self, id_: str, who: Who = Who()) -> tuple[DataFrame, DataFrame]:
        """Nodes with places from 0 by id, and edges between places."""
        from lodegraph.operators.skew import distributed_rank

        v = self.view(id_, None, who)
        nodes = distributed_rank(v.nodes, ["id"], name="index")
        at = nodes.select(F.col("id").alias("_id"), "index")
        edges = v.edges.join(at.withColumnRenamed("index", "source"), F.col("src") == F.col("_id")).drop("_id")
        return nodes, edges.join(at.withColumnRenamed("index", "target"), F.col("tgt") == F.col("_id")).drop("_id").select("id", "type", "value", "source", "target")


def rendered(spark: SparkSession, history: DataFrame, row: dict[str, Any]) -> dict[str, Any]:
    """The fields that a node or edge has of itself: a node its counts, an edge the id, type and value of its ends."""
    out = {"ID": row["id"], "type": row["type"], "value": row["value"]}
    live = history.filter("next is null")
    if row["kind"] == "edge":
        ends = {r.id: {"ID": r.id, "type": r.type, "value": r.value} for r in live.filter(F.col("id").isin(row["src"], row["tgt"])).select("id", "type", "value").collect()}
        return out | {"src": ends[row["src"]], "tgt": ends[row["tgt"]]}
    me = row["id"]
    mine = live.filter((F.col("kind") == "edge") & ((F.col("src") == me) | (F.col("tgt") == me)))
    other = F.when(F.col("src") == me, F.col("tgt")).otherwise(F.col("src"))
    n = mine.agg(
        F.count("*").alias("edge_count"), F.count_if(F.col("tgt") == me).alias("inbound_count"), F.count_if(F.col("src") == me).alias("outbound_count"),
        F.countDistinct(F.when(other != me, other)).alias("neighbor_count")).first()
    return out | n.asDict()


def error(e: Exception) -> dict[str, Any]:
    """What went wrong, as the body of an answer."""
    codes = ((ParseError, 400), (ingest.BadInput, getattr(e, "code", 400)), (Refused, 403), (FileExistsError, 409), (Locked, 409), (NotFound, 404), (LookupError, 404), (ValueError, 400))
    code = next((c for kind, c in codes if isinstance(e, kind)), 500)
    text = f"query syntax error: {e}" if isinstance(e, ParseError) else str(e)
    return {"code": code, "reason": HTTPStatus(code).phrase, "message": text}


def matches(spark: SparkSession, objects: Sequence[Any], texts: Sequence[str]) -> list[bool]:
    """Whether any one-slot pattern holds for each plain object; its keys are all properties, native fields do not exist."""
    if not objects:
        return []
    rows = [(i, *[shred(o)[k] for k in ("val_kind", "val_json")]) for i, o in enumerate(objects)]
    df = spark.createDataFrame(rows, "i int, kind string, json string")
    none = {k: F.lit(None) for k in ("bool", "int", "num", "str")}
    ok = F.lit(False)
    for text in texts:
        p = parse(text)
        if len(p.slots) != 1:
            raise ValueError("a listing filter has one slot")
        every = F.lit(True)
        for f in p.slots[0].filters:
            every = every & holds(f.test, descend({"kind": F.col("kind"), "json": F.col("json"), **none}, f.path))
        ok = ok | every
    return [r.ok for r in df.select("i", ok.alias("ok")).orderBy("i").collect()]


__all__ = ["Refused", "Store", "Who", "allowed", "error", "matches", "rendered", "roles_of"]
