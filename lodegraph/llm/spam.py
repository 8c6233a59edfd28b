"""Pages of keywords, links or tags, by a hidden Markov model over their lines."""

from __future__ import annotations

import json
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.spelling import plain
from lodegraph.session import materialize

STATES = ("prose", "record", "links", "tags", "menu")
#: States whose words count as spam; records are the lists a transcript has (divisions, order papers, attendance).
NON_PROSE = (2, 3, 4)
_SPAM = np.isin(np.arange(len(STATES)), NON_PROSE)
#: Documents are decoded together up to so many pieces, the longest times their number.
ROOM = 400_000
#: Longer lines are read in pieces of so many words, so that a page in one line is many observations.
PIECE = 12

# Words that carry grammar rather than content, in the four languages of the transcripts.
GRAMMAR = set(
    "a about after all also am an and any are as at be because been before but by can could did do does for from had has have he her his how i if in into is it its just let me more my no nor not of on one or our out rather "
    "shall she should since so some still such than that the their them then there these they this those to too two under until up upon us was we were what when where whether which who why will with without would you your "
    "aber alle als am an auch auf aus bei bis da das dass dem den denn der des die dies diese dieser doch durch ein eine einem einen einer es fur gegen hat haben ich ihr im ist kein keine man mehr mit nach nicht noch nur oder "
    "seit sich sie sind so uber um und uns vom von vor wann war was wenn wer werden wie wir wird zu zum zur zwei "
    "au aux avec c ce ces cette comme contre d dans de depuis des donc du elle en est et etait il ils j je l la le les leur lui mais m meme moi mon n ne nos notre nous on ont ou par pas plus pour qu que qui quand s sa sans se selon ses si son sur t un une va vers votre vous y "
    "al como con contra cuando de del desde donde e el ella en entre era es esa ese eso esta este esto fue ha han hay la las lo los mas me mi muy ni no nos nosotros o para pero por porque que quien se segun ser si sin sobre solo son su sus tambien todo todos un una unos va y ya".split()
)
# Words of advertising in the same languages.
CUES = set(
    "buy cheap sale discount deal deals best review reviews price prices online official coupon coupons outlet wholesale compare shipping offer offers store top tags tag related looking "
    "kaufen gunstig billig angebot rabatt preis bestellen cher acheter prix promo soldes achat comprar barato oferta ofertas precio descuento tienda".split()
)
_LINK = re.compile(r"(?:https?|hxxps?)://\S+|www\.\S+|\b[\w-]+(?:(?:\.|\[\.\]| dot )[\w-]+)+(?:(?:/| slash )\S*)?(?= |$|[,;)\n])", re.I)
_TAGGED = re.compile(r"(?<!\S)[#+~@*•>][^\W\d_][\w-]*")
_MENU = re.compile(r"[|>»›·•]|(?<=\s)[/–-](?=\s)|\b(?:home|related|tags?)\b\s*[:>]", re.I)
_WORD = re.compile(r"[^\W_]+")
_DOMAIN = re.compile(r"://|^www\.|\[\.\]| dot |\.[a-z]{2,}(?:/|$)", re.I)

# What any link, and any tag or menu, has: most lines have neither and need no closer look.
_DOTTED = re.compile(r"\.[^\s.]")
_MARKS = frozenset("#+~@*•>|»›·_/–-")
_HEADS = ("home", "related", "tag")


# Bins of each feature: grammar words, links, advertising, marks, repeated words (the last: repeated at once).
BINS = (4, 3, 3, 3, 4)
_GRAMMAR_ENDS, _LINK_ENDS, _CUE_ENDS, _MARK_ENDS, _AGAIN_ENDS = (0.08, 0.22, 0.36), (0.1, 0.4), (0.001, 0.12), (0.05, 0.2), (0.34, 0.7)
#: Where the model starts: for each state the chance of each bin, feature by feature.
START = (
    ((0.05, 0.15, 0.35, 0.45), (0.93, 0.06, 0.01), (0.93, 0.06, 0.01), (0.90, 0.08, 0.02), (0.698, 0.20, 0.10, 0.002)),
    ((0.60, 0.25, 0.10, 0.05), (0.97, 0.02, 0.01), (0.97, 0.02, 0.01), (0.75, 0.15, 0.10), (0.595, 0.20, 0.20, 0.005)),
    ((0.80, 0.15, 0.04, 0.01), (0.03, 0.17, 0.80), (0.50, 0.30, 0.20), (0.60, 0.25, 0.15), (0.35, 0.30, 0.30, 0.05)),
    ((0.80, 0.15, 0.04, 0.01), (0.90, 0.08, 0.02), (0.20, 0.35, 0.45), (0.45, 0.25, 0.30), (0.10, 0.20, 0.30, 0.40)),
    ((0.75, 0.18, 0.06, 0.01), (0.80, 0.15, 0.05), (0.20, 0.35, 0.45), (0.10, 0.30, 0.60), (0.25, 0.30, 0.35, 0.10)),
)
#: Chance that the next piece has the same state, at the start of training.
STAY = 0.85


#: A piece's bins as one number: how much each feature counts in it.
_PLACES = np.cumprod((1, *BINS[:-1]))
_LINKED, _CUED, _MARKED, _AGAIN = (int(p) for p in _PLACES[1:])


def pieces(text: str) -> tuple[list[int], list[int]]:
    """For each line or piece of a long line: the bins of all features as one number, and its words.

    Words are runs of letters and digits, so a link counts as the words it is made of.
    Lines without any are left out.
    """
    found: list[tuple[int, int, int, int]] = []  # words, content words, where those end in all, code without repeats
    every: list[str] = []
    for line in plain(text).split("\n"):
        parts = line.split(" ")
        for i in range(0, len(parts), PIECE):
            piece = " ".join(parts[i : i + PIECE]) if len(parts) > PIECE else line
            words = _WORD.findall(piece)
            if not words:
                continue
            n, linked = len(words), 0.0
            dotted = ("." in piece and _DOTTED.search(piece)) or "://" in piece or " dot " in piece
            if dotted and (links := [m for m in _LINK.findall(piece) if _DOMAIN.search(m)]):
                rest = piece
                for m in links:
                    rest = rest.replace(m, " ", 1)
                words = _WORD.findall(rest)
                linked = sum(len(_WORD.findall(m)) for m in links) / n
            other = [w for w in words if w not in GRAMMAR]
            content = [w for w in other if not w.isdigit()]
            marks = 0.0
            if not _MARKS.isdisjoint(piece) or any(h in piece for h in _HEADS):
                marks = (2 * len(_TAGGED.findall(piece)) + len(_MENU.findall(piece)) + piece.count("_")) / n
            cues = len([w for w in other if w in CUES]) / n
            code = bisect(_GRAMMAR_ENDS, (len(words) - len(other)) / n)
            if linked or cues or marks:
                code += _LINKED * bisect(_LINK_ENDS, linked) + _CUED * bisect(_CUE_ENDS, cues) + _MARKED * bisect(_MARK_ENDS, marks)
            every += content
            found.append((n, len(content), len(every), code))
    many = {w for w, c in Counter(every).items() if c > 2}
    codes, sizes = [], []
    for n, k, end, code in found:
        if many and k:
            again = len([w for w in every[end - k : end] if w in many]) / k
            latest = every[max(0, end - PIECE) : end] if again >= 0.7 else ()
            at_once = len(latest) > 5 and len(set(latest)) <= 0.55 * len(latest)
            code += _AGAIN * (3 if at_once else bisect(_AGAIN_ENDS, again))
        codes.append(code)
        sizes.append(n)
    return codes, sizes


class Model:
    """Start, transition and emission chances; emissions are independent by feature."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls) -> Model:
        k = len(STATES)
        move = np.full((k, k), (1 - STAY) / (k - 1))
        np.fill_diagonal(move, STAY)
        start = np.array([0.8, 0.05, 0.05, 0.05, 0.05])
        return cls(start, move, [np.array([s[f] for s in START]) for f in range(len(BINS))])

    def paths(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest states of each document, given the codes of its pieces; many documents at a time.

        Documents of similar length go together, and no more than fit into ``ROOM``
        pieces, the longest times their number. A longer document goes alone and is
        decoded piece by piece with one carried score; only which state led to which
        is kept, five bytes a piece.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(docs)
        order = sorted((i for i in range(len(docs)) if len(docs[i])), key=lambda i: len(docs[i]))
        k = len(STATES)
        start, move = np.log(self.start), np.log(self.move)
        bins = np.arange(int(np.prod(BINS)))[:, None] // _PLACES % BINS
        emit = sum(np.log(e)[:, bins[:, f]].T for f, e in enumerate(self.emit))
        at = 0
        while at < len(order):
            size = 1
            while at + size < len(order) and (size + 1) * len(docs[order[at + size]]) <= ROOM:
                size += 1
            some = order[at : at + size]
            at += size
            ends = np.array([len(docs[i]) for i in some])
            long = int(ends[-1])
            codes = np.zeros((long, size), np.int16)
            for r, i in enumerate(some):
                codes[: ends[r], r] = docs[i]
            back = np.zeros((long, size, k), np.int8)
            score = start + emit[codes[0]]
            first = 0  # documents before it have ended
            final = score.copy()
            for t in range(1, long):
                while ends[first] <= t:
                    first += 1
                step = score[first:, :, None] + move
                back[t, first:] = step.argmax(1)
                score[first:] = step.max(1) + emit[codes[t, first:]]
                final[first:] = score[first:]
            state = final.argmax(1)
            path = np.zeros((long, size), np.int8)
            rows = np.arange(size)
            for t in range(long - 1, -1, -1):
                first = int(np.searchsorted(ends, t, side="right"))
                path[t, first:] = state[first:]
                state[first:] = back[t, rows[first:], state[first:]]
            for r, i in enumerate(some):
                out[i] = path[: ends[r], r].copy()
        return out

    def counts(self, docs: list[np.ndarray]) -> np.ndarray:
        """How often each start, transition and emission is used by the likeliest paths; counts of parts add up."""
        k, paths = len(STATES), self.paths(docs)
        some = [(d, p) for d, p in zip(docs, paths, strict=True) if len(p)]
        if not some:
            return np.zeros(k + k * k + k * sum(BINS))
        start = np.bincount([p[0] for _, p in some], minlength=k)
        steps = np.concatenate([p[:-1].astype(np.int64) * k + p[1:] for _, p in some])
        move = np.bincount(steps, minlength=k * k)
        code, state = np.concatenate([d for d, _ in some]).astype(np.int64), np.concatenate([p for _, p in some]).astype(np.int64)
        emit = [np.bincount(state * b + code // place % b, minlength=k * b) for b, place in zip(BINS, _PLACES, strict=True)]
        return np.concatenate([start, move, *emit]).astype(float)

    def trained(self, counts: np.ndarray, prior: float) -> Model:
        """The model that fits ``counts``, held to where it started by ``prior`` of all counts."""
        first, k = Model.first(), len(STATES)
        start, rest = counts[:k], counts[k:]
        move, rest = rest[: k * k].reshape(k, k), rest[k * k :]
        emit = []
        for b in BINS:
            emit.append(rest[: k * b].reshape(k, b))
            rest = rest[k * b :]

        def mix(c: np.ndarray, p: np.ndarray) -> np.ndarray:
            weight = prior * max(c.sum(), 1.0)
            x = c + weight * p
            return x / x.sum(-1, keepdims=True)

        return Model(mix(start, first.start), mix(move, first.move), [mix(c, p) for c, p in zip(emit, first.emit, strict=True)])

    def dump(self) -> str:
        return json.dumps([self.start.tolist(), self.move.tolist(), [e.tolist() for e in self.emit]])

    @classmethod
    def load(cls, text: str) -> Model:
        start, move, emit = json.loads(text)
        return cls(np.array(start), np.array(move), [np.array(e) for e in emit])


def _observe(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        seen = [pieces(t or "") for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "codes": [np.array(c, "<i2").tobytes() for c, _ in seen], "sizes": [np.array(s, "<i4").tobytes() for _, s in seen]})


def _docs(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(c, "<i2") for c in pdf["codes"]]


def observations(documents: DataFrame) -> DataFrame:
    """Each document's pieces as codes of their features, two bytes a piece, with their sizes, four."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return materialize(rows.mapInPandas(_observe, "doc_id long, codes binary, sizes binary"), "pieces")


def train(seen: DataFrame, rounds: int = 2, prior: float = 0.05) -> Model:
    """Viterbi training on all documents: every task counts its own paths, and the counts, under a hundred numbers, are added."""
    model = Model.first()
    for _ in range(rounds):
        text = model.dump()

        def tally(it: Iterator[pd.DataFrame], text: str = text) -> Iterator[pd.DataFrame]:
            m, total = Model.load(text), None
            for pdf in it:
                c = m.counts(_docs(pdf))
                total = c if total is None else total + c
            if total is not None:
                yield pd.DataFrame({"at": range(len(total)), "n": total})

        got = {r["at"]: r["n"] for r in seen.mapInPandas(tally, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()}
        if not got:
            break
        model = model.trained(np.array([got[i] for i in range(len(got))]), prior)
    return model


def page_shares(documents: DataFrame, rounds: int = 2, prior: float = 0.05) -> DataFrame:
    """``doc_id``, ``words``, ``non_prose`` and ``share`` of the words in link lists, tag lists and menus.

    Whole texts are read. Null and empty texts and texts without a word have 0 words and a share of 0. Rows
    without ``doc_id`` are left out; repeated rows give repeated results; other columns are
    ignored; an empty table gives an empty result.
    """
    seen = observations(documents)
    text = train(seen, rounds, prior).dump()

    def label(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model.load(text)
        for pdf in it:
            paths = m.paths(_docs(pdf))
            sizes = [np.frombuffer(s, "<i4").astype(np.int64) for s in pdf["sizes"]]
            words = [int(s.sum()) for s in sizes]
            spam = [int(s[_SPAM[p]].sum()) for s, p in zip(sizes, paths, strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "words": words, "non_prose": spam})

    out = seen.mapInPandas(label, "doc_id long, words long, non_prose long")
    return out.withColumn("share", F.when(F.col("words") > 0, F.col("non_prose") / F.col("words")).otherwise(F.lit(0.0)))


def spam_pages(documents: DataFrame, share: float = 0.5) -> DataFrame:
    """``doc_id`` of the documents of which more than ``share`` of the words are not prose or records."""
    return page_shares(documents).filter(F.col("share") > share).select("doc_id").distinct()
