"""JSON input: chains, nodes and edges with properties that merge, and the depths that follow from them."""

from __future__ import annotations

import math
from typing import Any

from lodegraph.functions.json_values import merge, scalar, whole
from lodegraph.writer import Entry, NotFound, Transaction

SEEDS = "seeds"
# Keys of an object that are fields of its own, never properties.
NODE_FIELDS = {"ID", "type", "value", "typeID", "valueID", "edge_count", "inbound_count", "outbound_count", "neighbor_count", "edges", "edgeIDs", "inbound", "inboundIDs", "outbound", "outboundIDs", "neighbors", "neighborIDs", "neighbor_types"}
EDGE_FIELDS = {"ID", "type", "value", "typeID", "valueID", "src", "tgt", "srcID", "tgtID"}


class BadInput(ValueError):
    """``code`` says what kind of mistake it is: 400 malformed, 409 contradicting the graph."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def apply(t: Transaction, body: Any, create: bool = False) -> int:
    """Writes one input and then the depths it implies; gives the number of new log rows. A failed input writes nothing.

    ``seed``, ``meta``, ``chains``, ``nodes`` and ``edges`` are taken in this order. With ``create``, ids in the input are ignored.
    """
    if not isinstance(body, dict):
        raise BadInput(400, "body must be an object")
    with t.nested():
        start = t.next_id()
        seed = bool(body.get("seed"))
        if seed:
            t.fifo_push(SEEDS, [body])
        meta = body.get("meta", {})
        if not isinstance(meta, dict):
            raise BadInput(400, "meta must be an object")
        for k, v in meta.items():
            merged(t, 0, k, v)
        for chain in _list(body, "chains"):
            _chain(t, chain, create, seed)
        for n in _list(body, "nodes"):
            node(t, n, create, seed)
        for e in _list(body, "edges"):
            edge(t, e, create=create, seed=seed)
        depths(t, start)
        return t.next_id() - start


def _list(body: dict, key: str) -> list:
    x = body.get(key, [])
    if not isinstance(x, list):
        raise BadInput(400, f"{key} must be an array")
    return x


def merged(t: Transaction, parent: int, key: str, value: Any) -> None:
    t.set(parent, key, merge(t.value(parent, key), value))


def _props(t: Transaction, at: Entry, obj: dict, fields: set[str], create: bool, seed: bool, only=lambda k, v: True) -> None:
    props = {k: v for k, v in obj.items() if k not in fields and (k != "seed" or (create and not seed))}
    if seed:
        props["seed"] = True
    for k, v in props.items():
        if only(k, v):
            merged(t, at.id, k, v)


def _chain(t: Transaction, chain: Any, create: bool, seed: bool) -> None:
    if not isinstance(chain, list):
        raise BadInput(400, "chain must be an array")
    if len(chain) % 2 == 0:
        raise BadInput(409, "a chain has an odd number of objects")
    nodes = [node(t, n, create, seed) for n in chain[::2]]
    for e, src, tgt in zip(chain[1::2], nodes, nodes[1:], strict=False):
        edge(t, e, src, tgt, create, seed)


def _by_id(t: Transaction, obj: dict, kind: str) -> Entry:
    try:
        if isinstance(obj["ID"], bool) or not isinstance(obj["ID"], int):
            raise NotFound
        return t.live(obj["ID"], kind)
    except NotFound:
        raise BadInput(409, f"bad {kind}: {obj}") from None


def node(t: Transaction, obj: Any, create: bool = False, seed: bool = False) -> Entry:
    if not isinstance(obj, dict):
        raise BadInput(409, f"bad node: {obj}")
    if "ID" in obj and not create:
        e = _by_id(t, obj, "node")
    else:
        type_, value = (scalar(obj[k]) if k in obj else None for k in ("type", "value"))
        if type_ is None or value is None:
            raise BadInput(409, f"bad node: {obj}")
        e = t.node(type_, value)
    _props(t, e, obj, NODE_FIELDS, create, seed)
    return e


def edge(t: Transaction, obj: Any, src: Entry | None = None, tgt: Entry | None = None, create: bool = False, seed: bool = False) -> Entry:
    """``cost`` must lie in 0..1 and only falls; other costs are ignored."""
    if not isinstance(obj, dict):
        raise BadInput(409, f"bad edge: {obj}")
    if "ID" in obj and not create:
        e = _by_id(t, obj, "edge")
    else:
        a = src or node(t, obj.get("src"), create, seed)
        b = tgt or node(t, obj.get("tgt"), create, seed)
        type_, value = (scalar(obj[k]) if k in obj else None for k in ("type", "value"))
        if type_ is None or ("value" in obj and value is None):
            raise BadInput(409, f"bad edge: {obj}")
        e = t.edge(a.id, b.id, type_, value or "")
    now = t.value(e.id, "cost")
    falls = lambda k, v: k != "cost" or (_number(v) and 0 <= v <= 1 and (not _number(now) or v < now))
    _props(t, e, obj, EDGE_FIELDS, create, seed, falls)
    return e


def _number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def depths(t: Transaction, start: int) -> None:
    """Brings ``depth`` of nodes up to date with everything logged from ``start``, in log order, until nothing changes.

    A seed has depth 0; an edge, or a cost of it, pulls its farther end to the nearer one's depth plus 1, or plus
    the cost; a depth caps those of its neighbours at one more.
    """
    def depth(n: int) -> float:
        d = t.value(n, "depth")
        return float(d) if _number(d) else math.inf

    def alive(n: int, kind: str) -> bool:
        e = t.entry(n)
        return e is not None and not e.next and e.kind == kind

    def relax(a: int, b: int, cost: float) -> None:
        if not (alive(a, "node") and alive(b, "node")):
            return
        da, db = depth(a), depth(b)
        if da + cost < db:
            t.set(b, "depth", whole(da + cost))
        elif db + cost < da:
            t.set(a, "depth", whole(db + cost))

    at = start
    while (e := t.entry(at)) is not None:
        at += 1
        if e.kind == "edge":
            relax(e.src, e.tgt, 1.0)
        elif e.kind == "prop" and e.key == "seed" and alive(e.parent, "node") and e.data:
            t.set(e.parent, "depth", 0)
        elif e.kind == "prop" and e.key == "depth" and alive(e.parent, "node") and _number(e.data):
            for n in sorted({x for x in (y for o in t.edges_of(e.parent) for y in (o.src, o.tgt)) if x != e.parent}):
                if depth(n) > e.data + 1:
                    t.set(n, "depth", whole(e.data + 1.0))
        elif e.kind == "prop" and e.key == "cost" and alive(e.parent, "edge") and _number(e.data):
            o = t.entry(e.parent)
            relax(o.src, o.tgt, float(e.data))
