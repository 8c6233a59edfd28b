"""Expansion runs that are steered from outside: started, polled, answered and stopped."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Sequence
from typing import Any

from lodegraph.expand.expander import Expander, Report
from lodegraph.expand.policy import Candidate, Context, Decision, Policy, Task
from lodegraph.expand.source import Source
from lodegraph.expand.wire import batch_lines, candidate_json, context_json, parse_decision, report_json, task_json, trace_lines


class Cancelled(RuntimeError):
    """The run was stopped, or nobody answered in time."""


class Remote(Policy):
    """A policy that asks whoever polls: each question has a number, and waits for the answer to that number."""

    def __init__(self, timeout: float = 60.0):
        self.timeout, self.seq = timeout, 0
        self.question: dict[str, Any] | None = None
        self._answer: list[Decision] | None = None
        self._size = 0
        self._stopped = False
        self._changed = threading.Condition()

    def name(self) -> str:
        return "remote"

    def decide(self, task: Task, ctx: Context, batch: Sequence[Candidate]) -> list[Decision]:
        with self._changed:
            self.seq += 1
            self._answer, self._size = None, len(batch)
            self.question = {"seq": self.seq, "context": context_json(ctx), "candidates": [candidate_json(c) for c in batch]}
            self._changed.notify_all()
            answered = self._changed.wait_for(lambda: self._answer is not None or self._stopped, self.timeout)
            self.question = None
            if self._stopped or not answered:
                self._stopped = True
                self._changed.notify_all()
                raise Cancelled("stopped" if answered else "no answer in time")
            return self._answer or []

    def wait(self, after: int, timeout: float) -> dict[str, Any] | None:
        """The question that is open, once its number exceeds ``after``; None if there is none in time."""
        with self._changed:
            self._changed.wait_for(lambda: self._stopped or (self.question is not None and self.seq > after), timeout)
            return self.question if self.question is not None and self.seq > after else None

    def answer(self, seq: int, decisions: Sequence[Any]) -> None:
        """Answers the open question; another number, or another number of decisions, is an error."""
        parsed = [parse_decision(d) for d in decisions]
        with self._changed:
            if self.question is None or seq != self.seq:
                raise LookupError(f"question {seq} is not open")
            if len(parsed) != self._size:
                raise ValueError(f"{self._size} decisions are asked for")
            self._answer = parsed
            self._changed.notify_all()

    def stop(self) -> None:
        with self._changed:
            self._stopped = True
            self._changed.notify_all()


class _Run(threading.Thread):
    def __init__(self, source: Source, task: Task, policy: Policy, truth: set, goal: bool, parallel: int):
        super().__init__(daemon=True)
        self.source, self.task, self.policy, self.truth, self.goal, self.parallel = source, task, policy, truth, goal, parallel
        self.state, self.error, self.report = "running", None, Report()

    def run(self) -> None:
        try:
            x = Expander(self.source, self.policy, self.task, parallel=self.parallel, log_batches=True)
            self.report = x.report
            x.run((lambda x: x.report.connected_at is not None) if self.goal else (lambda x: False))
            self.state = "done"
        except Cancelled as e:
            self.state, self.error = "cancelled", str(e)
        except Exception as e:  # what a policy raises ends its own run only
            self.state, self.error = "failed", repr(e)


class Sessions:
    """Runs by id. Each lives in a thread of its own; for many runs with policies that need nobody, see ``expander.run_many``."""

    def __init__(self) -> None:
        self._runs: dict[str, _Run] = {}

    def start(self, source: Source, task: Task, policy: Policy | None = None, truth: set | None = None, parallel: int = 1, timeout: float = 60.0) -> str:
        """The id of a new run; without a ``policy`` it waits for answers."""
        id_ = str(uuid.uuid4())
        run = _Run(source, task, policy or Remote(timeout), truth or set(), task.goal == "connect", parallel)
        self._runs[id_] = run
        run.start()
        return id_

    def _run(self, id_: str) -> _Run:
        if id_ not in self._runs:
            raise LookupError(id_)
        return self._runs[id_]

    def list(self) -> list[str]:
        return sorted(self._runs)

    def poll(self, id_: str, after: int = 0, timeout: float = 30.0) -> dict[str, Any]:
        """State and report of a run, its task with the first question, and the open question behind number ``after`` if there is one."""
        run = self._run(id_)
        asked = run.policy.wait(after, timeout) if isinstance(run.policy, Remote) and run.state == "running" else None
        if not isinstance(run.policy, Remote):
            run.join(timeout)
        out = {"id": id_, "state": run.state, "error": run.error, "report": report_json(run.report)}
        return out | ({"ask": asked} if asked else {}) | ({"task": task_json(run.task, run.source)} if after == 0 else {})

    def answer(self, id_: str, seq: int, decisions: Sequence[Any]) -> None:
        policy = self._run(id_).policy
        if not isinstance(policy, Remote):
            raise LookupError(f"{id_} has a policy of its own")
        policy.answer(seq, decisions)

    def trace(self, id_: str) -> list[str]:
        run = self._run(id_)
        return list(trace_lines(run.report, run.truth))

    def batches(self, id_: str) -> list[str]:
        """The calls so far, candidates labelled by whether they lie on the truth."""
        run = self._run(id_)
        on = {x for a, b, _ in run.truth for x in (a, b)}
        return list(batch_lines(run.report, run.source, on.__contains__))

    def stop(self, id_: str) -> None:
        """Ends a run and forgets it."""
        run = self._run(id_)
        if isinstance(run.policy, Remote):
            run.policy.stop()
        run.join(10)
        del self._runs[id_]
