"""JSON of what crosses to a policy outside, and of the traces it learns from."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from lodegraph.expand.expander import Edge, Report, Step
from lodegraph.expand.policy import UNREACHED, Candidate, Context, Decision, Take, Task
from lodegraph.expand.source import Attr, Source, Via

UNLIMITED = (1 << 32) - 1


def filter_json(f: Attr | Via | None) -> dict[str, Any] | None:
    if f is None:
        return None
    return {"key": f.key, "value": f.value} if isinstance(f, Attr) else {"via": f.rel, "then": filter_json(f.then)}


def parse_filter(v: Any) -> Attr | Via:
    if isinstance(v, dict) and isinstance(v.get("key"), str) and isinstance(v.get("value"), str):
        return Attr(v["key"], v["value"])
    if isinstance(v, dict) and isinstance(v.get("via"), int) and 0 <= v["via"] < 256 and "then" in v:
        return Via(v["via"], parse_filter(v["then"]))
    raise ValueError("malformed filter")


def task_json(t: Task, s: Source) -> dict[str, Any]:
    return {
        "prompt": t.prompt, "seeds": t.seeds, "goal": t.goal, "domains": list(s.domains), "relations": [{"name": r.name, "from": r.start, "to": r.end} for r in s.relations],
        "relation_interest": t.relation_interest, "domain_interest": t.domain_interest, "watch": t.watch, "standing": t.standing, "target": filter_json(t.target), "shape": t.shape,
        "probes": t.probes, "budget": t.budget, "filters": s.can_filter,
    }


def context_json(c: Context) -> dict[str, Any]:
    return {"fetched": c.fetched, "by_side": c.by_side, "budget": c.budget, "steps": c.steps}


def candidate_json(c: Candidate) -> dict[str, Any]:
    """Hops of sides not reached, and infinite costs, are null."""
    return {
        "id": c.id, "domain": c.domain, "peek": c.peek, "fetched": c.fetched, "hops": [None if h == UNREACHED else h for h in c.hops], "cost": [x if math.isfinite(x) else None for x in c.cost],
        "known": c.known, "known_by_domain": c.known_by_domain, "watched": c.watched, "is_watched": c.is_watched, "alerts": c.alerts, "probes": c.probes, "pushed": c.pushed,
    }


def decision_json(d: Decision) -> dict[str, Any]:
    return {"priority": d.priority, "take": [{"rel": t.rel, "limit": t.limit, "filter": filter_json(t.filter)} for t in d.take]}


def parse_decision(v: Any) -> Decision:
    """Without ``take`` nothing is expanded; without ``limit`` all is taken."""
    p = v.get("priority") if isinstance(v, dict) else None
    if isinstance(p, bool) or not isinstance(p, (int, float)):
        raise ValueError("decision needs a numeric priority")
    take = []
    for t in v.get("take") or []:
        if isinstance(t.get("rel"), bool) or not isinstance(t.get("rel"), int) or not 0 <= t["rel"] < 256:
            raise ValueError("take needs a relation index")
        limit = t.get("limit")
        take.append(Take(t["rel"], min(limit, UNLIMITED) if isinstance(limit, int) and limit >= 0 else UNLIMITED, None if t.get("filter") is None else parse_filter(t["filter"])))
    return Decision(float(p), take)


def report_json(r: Report) -> dict[str, Any]:
    return {k: getattr(r, k) for k in ("steps", "rounds", "fetched", "calls", "filtered", "nodes", "edges", "done_at", "alert_at", "connected_at", "alerts", "probes", "decisions")}


def step_json(r: Report, s: Step, truth: set[Edge], route: set[int]) -> dict[str, Any]:
    return {"before": s.before, "candidate": candidate_json(s.candidate), "decision": decision_json(s.decision), "edges": len(s.edges), "hits": r.hits(s, truth), "route": s.candidate.id in route}


def trace_lines(r: Report, truth: set[Edge]) -> Iterator[str]:
    route = r.route(truth)
    return (json.dumps(step_json(r, s, truth, route)) for s in r.trace)


def batch_lines(r: Report, source: Source, label: Callable[[int], bool]) -> Iterator[str]:
    """Policy calls with an oracle's label of each candidate, and per relation how far its first labelled neighbour still is."""
    for b in r.batches:
        rows = [candidate_json(c) | {"label": label(c.id), "depth": depth(source, c, label)} for c in b.candidates]
        yield json.dumps({"context": context_json(b.context), "candidates": rows, "decisions": [decision_json(d) for d in b.decisions]})


def depth(source: Source, c: Candidate, label: Callable[[int], bool]) -> list[int | None]:
    left = lambda r: source.fetch(c.id, r, c.fetched[r], max(c.peek[r] - c.fetched[r], 0))
    return [next((i for i, n in enumerate(left(r)) if label(n)), None) for r in range(len(c.peek))]


def entity_lines(source: Source, ids: Iterable[int]) -> Iterator[str]:
    return (json.dumps({"id": i, "domain": source.domain(i), "text": source.text(i)}) for i in ids)
