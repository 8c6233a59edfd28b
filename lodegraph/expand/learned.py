"""A policy that asks a classifier, what the classifier is trained on, and the questions whose answers it may read."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.expand.policy import UNREACHED, Candidate, Context, Decision, Policy, Take, Task, pushed_fetch
from lodegraph.expand.source import RELATIONS
from lodegraph.rank.features import FAR, NAMES, features
from lodegraph.session import materialize

# What is asked of an entity's text, with the kind of answer, and of a candidate in the light of a task.
QUESTIONS: dict[str, str] = {
    "nominee": "probability", "provider": "probability", "mass_address": "probability", "hub": "score", "person": "probability", "specific": "probability", "secrecy": "probability", "shell": "probability",
    "active": "probability", "notable": "probability",
}
RELEVANCE: dict[str, str] = {"tie": "score", "link": "probability", "fits": "probability"}
#: The highest level of each score.
TOPS = {"hub": 3, "tie": 2}
#: Chances of the classifier from one numpy row per candidate.
Chances = Callable[[np.ndarray], np.ndarray]


def numbers(task: Task, ctx: Context, batch: Sequence[Candidate]) -> np.ndarray:
    """The columns of ``rank.features.NAMES`` for one call, as ``features`` has them for a table of calls."""
    rows = np.zeros((len(batch), len(NAMES)))
    at = {n: i for i, n in enumerate(NAMES)}

    def put(name: str, values: Iterable[float]) -> None:
        rows[:, at[name]] = list(values)

    peek, left = np.array([c.peek for c in batch], float), np.array([c.remaining() for c in batch], float)
    known = np.array([c.known_by_domain for c in batch], float)
    for r in range(RELATIONS):
        put(f"peek{r}", peek[:, r])
        put(f"left{r}", left[:, r])
        put(f"known_dom{r}", known[:, r])
    sides = np.array([[FAR if h == UNREACHED else float(h) for h in c.hops] for c in batch])
    prices = np.array([[x if math.isfinite(x) else FAR for x in c.cost] for c in batch])
    interest = np.array((task.relation_interest + [0.0] * RELATIONS)[:RELATIONS])
    one, two = ctx.by_side
    put("domain", (c.domain for c in batch))
    put("goal", (0.0 if task.goal == "connect" else 1.0 for _ in batch))
    put("log_degree", np.log1p(peek.sum(1)))
    put("log_left", np.log1p(left.sum(1)))
    put("log_relevant", np.log1p(left @ interest))
    for name, x in (("hops", sides.min(1)), ("hops_far", sides.max(1)), ("cost", prices.min(1)), ("cost_far", prices.max(1))):
        put(name, x)
    put("two_sided", sides.max(1) < FAR)
    for name in ("known", "watched", "is_watched", "alerts"):
        put(name, (float(getattr(c, name)) for c in batch))
    put("probes", (-1.0 if c.probes is None else c.probes for c in batch))
    put("pushed", (sum(c.pushed) for c in batch))
    put("domain_interest", (task.domain_interest[c.domain] if c.domain < len(task.domain_interest) else 0.0 for c in batch))
    put("spent", (ctx.fetched / max(ctx.budget, 1) for _ in batch))
    put("side_balance", ((one - two) / max(one + two, 1) for _ in batch))
    put("steps", (math.log1p(ctx.steps) for _ in batch))
    put("batch", (math.log1p(len(batch)) for _ in batch))
    place = np.empty(len(batch))
    place[sorted(range(len(batch)), key=lambda i: (prices[i].min(), batch[i].id))] = np.arange(len(batch))
    put("rank_cost", place / max(len(batch) - 1, 1))
    return rows


@dataclass
class Learned(Policy):
    """The classifiers' mean chance that a candidate is on the path, per edge it costs; optionally with filtered requests.

    ``answers`` gives further columns by entity (see ``answer_columns``); ``scale`` widens what is taken at once.
    """

    models: Sequence[Chances]
    push: bool = False
    scale: float = 1.0
    answers: Callable[[Sequence[int]], np.ndarray] | None = None

    def name(self) -> str:
        return "learned+pushdown" if self.push else "learned"

    def decide(self, task: Task, ctx: Context, batch: Sequence[Candidate]) -> list[Decision]:
        if not batch:
            return []
        x = numbers(task, ctx, batch)
        if self.answers is not None:
            x = np.hstack([x, self.answers([c.id for c in batch])])
        chance = np.mean([m(x) for m in self.models], 0)
        rating = np.log(np.maximum(chance, 1e-300))
        price = x[:, NAMES.index("log_relevant")]
        wide = max(int(self.scale * (ctx.budget - ctx.fetched) / 64), 16)
        return [self._one(task, ctx, c, float(r), float(p), wide) for c, r, p in zip(batch, rating, price, strict=True)]

    def _one(self, task: Task, ctx: Context, c: Candidate, rating: float, price: float, wide: int) -> Decision:
        wanted = [Take(r, min(n, wide)) for r, n in enumerate(c.remaining()) if n and task.relation_interest[r] > 0]
        interest = task.domain_interest[c.domain] if c.domain < len(task.domain_interest) else 0.0
        if not wanted or interest <= 0:
            return Decision()
        if self.push and (filtered := pushed_fetch(task, ctx, c)):
            # What comes back can only be what completes a hit: it is priced as one edge.
            return Decision(rating - math.log(2), [Take(filtered[0], wide, filtered[1])])
        return Decision(rating - price, wanted)


def answer_columns(answers: dict[int, dict[str, dict[str, float] | None]], questions: dict[str, str] = QUESTIONS) -> Callable[[Sequence[int]], np.ndarray]:
    """For ``Learned``: a number for each question and entity, NaN without an answer."""

    def value(q: str, answer: dict[str, float] | None) -> float:
        if answer is None:
            return math.nan
        return answer["probability"] if questions[q] == "probability" else answer["score"] / TOPS[q]

    return lambda ids: np.array([[value(q, answers.get(i, {}).get(q)) for q in questions] for i in ids])


_CANDIDATE = "id long, domain int, peek array<int>, fetched array<int>, hops array<int>, cost array<double>, known int, known_by_domain array<int>, watched int, is_watched boolean, alerts int, probes int, pushed array<boolean>, label boolean"
_LINE = f"context struct<fetched:long, by_side:array<int>, budget:long, steps:int>, candidates array<struct<{', '.join(x.replace(' ', ':', 1) for x in _CANDIDATE.split(', '))}>>, decisions array<struct<priority:double, take:array<struct<rel:int>>>>"


def load(spark: SparkSession, path: str, tasks: DataFrame, kinds: Sequence[str] = ("connect", "alert")) -> DataFrame:
    """Logged calls (``<kind>.<code>.<policy>.jsonl`` files, as ``wire.batch_lines`` writes them) as rows of numbers.

    ``run``, ``task``, ``grp``, ``id``, ``y``, ``prior`` (minus infinity where nothing was taken) and the features. ``tasks`` has
    ``task``, ``goal``, ``relation_interest``, ``domain_interest``. Files of other kinds, and runs of unknown tasks, are left out; every
    line is a group, numbered by its file and place.
    """
    lines = spark.read.text(path).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1).alias("run"), F.monotonically_increasing_id().alias("grp"))
    parts = F.split("run", r"\.")
    lines = lines.filter((F.size(parts) >= 3) & parts[0].isin(*kinds)).withColumn("task", F.concat_ws(".", parts[0], parts[1]))
    calls = lines.select("run", "task", "grp", F.from_json("value", _LINE).alias("b")).join(tasks, "task")
    each = calls.select(
        "run", "task", "grp", "goal", "relation_interest", "domain_interest", F.col("b.context.budget").alias("budget"), F.col("b.context.fetched").alias("fetched_total"), F.col("b.context.by_side").alias("by_side"), F.col("b.context.steps").alias("steps"),
        F.inline(F.arrays_zip(F.col("b.candidates").alias("c"), F.col("b.decisions").alias("d")))).withColumnsRenamed({"candidates": "c", "decisions": "d"})
    rows = each.select("run", "task", "grp", "goal", "relation_interest", "domain_interest", "budget", "fetched_total", "by_side", "steps", "c.*", F.when(F.size("d.take") > 0, F.col("d.priority")).otherwise(float("-inf")).alias("prior"))
    rows = materialize(rows, "calls")  # groups keep their numbers
    keys = rows.select("grp", "id", "run", "task", F.col("label").cast("int").alias("y"), "prior")
    return keys.join(features(rows.drop("run", "task")), ["grp", "id"])


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    """Several loads as one, groups told apart by their part."""
    out = None
    for n, p in enumerate(parts):
        part = p.withColumn("grp", F.struct(F.lit(n).alias("part"), F.col("grp").alias("grp")))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("nothing to join")
    return out


class Answers:
    """Stored answers, and a client that asks for the rest within a budget.

    ``ask(text, questions)`` returns answers and what they cost; without a budget nothing is asked, and what
    is not stored is None. ``estimate(text, questions)`` says beforehand what a call will cost at most.
    """

    def __init__(self, ask: Callable[[str, list[str]], tuple[dict[str, Any], float]], estimate: Callable[[str, list[str]], float], model: str = "m"):
        self.ask, self.estimate, self.model, self.stored, self.spent = ask, estimate, model, {}, 0.0

    def key(self, question: str, text: str) -> str:
        import hashlib

        return hashlib.sha256("\x00".join([self.model, json.dumps(question), text]).encode()).hexdigest()

    def get(self, texts: dict[int, str], questions: Sequence[str], budget: float = 0.0) -> dict[int, dict[str, Any]]:
        """Answers by entity and question; asks, entity by entity, while the next call fits into what is left of ``budget``."""
        out: dict[int, dict[str, Any]] = {}
        for i, text in texts.items():
            todo = [q for q in questions if self.key(q, text) not in self.stored]
            if todo and self.estimate(text, todo) <= budget:
                found, cost = self.ask(text, todo)
                budget, self.spent = budget - cost, self.spent + cost
                self.stored |= {self.key(q, text): found.get(q) for q in todo}
            out[i] = {q: self.stored.get(self.key(q, text)) for q in questions}
        return out
