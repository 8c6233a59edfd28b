"""Spellings of the same word: cleaning, edit keys, and clusters around the usual spelling."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import materialize

#: The cuts of longer words are hashed, as writing them out would cost the square of their length.
WRITTEN = 64
#: Ids of one key that a task pairs with all others of the key.
MEMBERS = 5_000
# Digits that scanners put for letters.
SCANNED = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "8": "b", "9": "g"})
_ACCENTS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_MIXED = re.compile(r"(?=\w*[^\W\d_]{2})\w*\d\w*")


def plain(text: str) -> str:
    """Lower case without accents; ß becomes ss."""
    if text.isascii():
        return text.lower()
    return _ACCENTS.sub("", unicodedata.normalize("NFKD", text.casefold()))


def unscan(word: str) -> str:
    """A word with scanned digits put back to letters; numbers such as 173a stay."""
    if word.isalpha() or re.fullmatch(r"\d+\w?", word):
        return word
    return word.translate(SCANNED) if _MIXED.fullmatch(word) else word


def deletes(word: str) -> set[str]:
    """The word and all it becomes without one letter."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class Near:
    """Words of a small list, found again with one edit."""

    def __init__(self, words: Iterable[str]):
        self.keys: dict[str, list[str]] = {}
        for w in words:
            for k in sorted(deletes(w)):
                self.keys.setdefault(k, []).append(w)

    def find(self, word: str) -> list[str]:
        """The words at most one edit away, by the alphabet."""
        hits = {w: None for k in deletes(word) for w in self.keys.get(k, ()) if within(word, w, 1)}
        return sorted(hits)


def within(a: str, b: str, most: int = 2) -> bool:
    """Whether at most ``most`` edits lead from a to b; swapped neighbours are one edit."""
    if abs(len(a) - len(b)) > most:
        return False
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if older and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        before = last
        if min(row) > most:
            return False
    return row[-1] <= most


def hashed_cuts(word: str) -> list[str]:
    """``deletes`` of a long word as hashes, in time that grows with its length: equal cuts have equal hashes.

    A cut's hash is that of the letters before plus that of those after, moved up by one
    place; the hash is a polynomial in the letters, modulo 2^64.
    """
    x = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0xD1B54A32D192ED03)
    base = np.uint64(0xBF58476D1CE4E5B9 | 1)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(x), base), dtype=np.uint64)
        before = np.concatenate(([np.uint64(0)], np.cumsum(x * powers, dtype=np.uint64)))
        # The letters behind a cut lose one power: their sum, times the inverse of the base.
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        cuts = before[:-1] + (before[-1] - before[1:]) * inverse
    return [f"\x01{int(h):x}" for h in np.unique(np.append(cuts, before[-1]))]


def short_id(word: str) -> str:
    """A word, or a hash that stands for one longer than ``WRITTEN``: rows by its letters would cost the square of its length."""
    return word if len(word) <= WRITTEN else "\x02" + hashlib.sha1(word.encode()).hexdigest()


def short_ids(word: Column) -> Column:
    """``short_id`` of a column."""
    return F.when(F.length(word) <= WRITTEN, word).otherwise(F.concat(F.lit("\x02"), F.sha1(word.cast("binary"))))


def with_cuts(words: DataFrame, letters: str, key: str, more: Callable[[Column], Column] | None = None) -> DataFrame:
    """``words`` with one row for each key of a word: itself, and from four letters on what it becomes without one of them.

    The column ``letters``, which has the word, is dropped. ``more`` adds keys. The keys of words
    longer than ``WRITTEN`` are hashes, those of the word without a letter among them, so that
    near words of that length on either side meet.
    """
    c, n = F.col(letters), F.length(letters)
    extra = F.array().cast("array<string>") if more is None else F.filter(more(c), lambda k: k.isNotNull())
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(c.substr(F.lit(1), i - 1), F.substring(c, i + 1, n)))
    keys = F.array_distinct(F.concat(F.array(c), F.when(n >= 4, cut).otherwise(F.array().cast("array<string>")), extra))
    kept = [c for c in words.columns if c != letters]
    short = words.filter(n <= WRITTEN + 2).select(*kept, F.explode(keys).alias(key))
    if words.filter(n >= WRITTEN).isEmpty():
        return short
    hashed = F.pandas_udf(lambda s: s.map(hashed_cuts), "array<string>")
    # Words about as long as the limit have both kinds of keys, as a near word may lie beyond it.
    long = words.filter(n >= WRITTEN).select(*kept, F.explode(F.concat(hashed(c), extra)).alias(key))
    return short.unionByName(long)


def cluster_spellings(words: DataFrame, block: Sequence[str], word: str, weight: str, ratio: float = 3.0, rounds: int = 2, more: Callable[[Column], Column] | None = None) -> DataFrame:
    """``block``, ``word`` and ``canonical``: the usual spelling that each rarer one stands for (its ``short_id``).

    ``words`` has one row per block and word with its ``weight``. Two spellings are near
    if both become the same by leaving out at most one letter each, which covers one
    edit, a swap and some pairs of edits. A word follows its heaviest near spelling of
    the same block if that outweighs it ``ratio`` times, or if it occurs at most twice
    itself; equal weights go by the alphabet. ``more`` adds keys to a word's own, for
    other ways to be near. Whoever it follows may follow another, ``rounds`` times.

    No pairs are formed: each edit key elects its heaviest word, and each word asks its
    own keys, so the cost is one row per letter and word. A key has no more words than
    there are letters to put into it. Words of three letters and fewer are never merged.
    """
    block = list(block)
    own = short_ids(F.col(word)).alias("_w")
    words = materialize(words.select(*block, word, weight), "spellings")
    keys = with_cuts(words.select(*block, own, F.col(weight).cast("double").alias("_n"), F.col(word).alias("_letters")), "_letters", "_key", more)
    # Of equal weights the first by the alphabet must win, so the order of weights is turned and the least taken.
    best = F.min(F.struct((-F.col("_n")).alias("m"), F.col("_w").alias("w"))).over(Window.partitionBy(*block, "_key"))
    seen = keys.withColumn("_best", best).filter(F.col("_best.w") != F.col("_w"))
    near = seen.groupBy(*block, "_w").agg(F.max("_n").alias("_n"), F.min("_best").alias("_best"))
    heavier = (-F.col("_best.m") > F.col("_n")) | ((-F.col("_best.m") == F.col("_n")) & (F.col("_best.w") < F.col("_w")))
    follows = near.filter(heavier & ((F.col("_n") <= 2) | (-F.col("_best.m") >= ratio * F.col("_n"))))
    follows = materialize(follows.select(*block, "_w", F.col("_best.w").alias("_to")), "follows")
    out = words.select(*block, word, own).join(follows, [*block, "_w"], "left").withColumn("_to", F.coalesce("_to", "_w"))
    for _ in range(rounds):
        step = follows.select(*block, F.col("_w").alias("_to"), F.col("_to").alias("_next"))
        out = out.join(step, [*block, "_to"], "left").withColumn("_to", F.coalesce("_next", "_to")).drop("_next")
    return out.select(*block, word, F.col("_to").alias("canonical"))


def ids_and_values(entities: DataFrame, domains: Sequence[int], words: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``id`` and ``value`` of the first field in the texts of some domains, without repeats.

    A row counts by its ``domain``, or by the word its text opens with where that is
    null. The value ends before the next ``; column: ``. Rows without an id, a text or one of
    ``fields`` in first place give nothing.
    """
    opens = "|".join(words)
    rows = entities.select(F.col("id").cast("long").alias("id"), "domain", "text").filter(
        F.col("id").isNotNull() & (F.col("domain").isin(*domains) | (F.col("domain").isNull() & F.col("text").rlike(f"^(?:{opens})\\b"))))
    pattern = rf"(?s)^\s*\w+ (?:{'|'.join(fields)}): (.*?)(?:; [A-Za-z][A-Za-z_ ]*: .*)?$"
    return rows.select("id", F.trim(F.regexp_extract("text", pattern, 1)).alias("value")).filter("value <> ''").distinct()


def pairs(members: DataFrame, key: Sequence[str]) -> DataFrame:
    """All ``id_a`` < ``id_b`` with the same key: the result is the pairs, so they are formed.

    ``members`` has ``id`` and the key columns. A key is cut into parts of ``MEMBERS`` ids,
    so that each task makes the pairs of so many with all others of the key.
    """
    from lodegraph.operators.skew import salted_join

    key = list(key)
    m = materialize(members.select("id", *key).dropna().distinct(), "members")
    a, b = m.withColumnRenamed("id", "id_a"), m.withColumnRenamed("id", "id_b")
    return salted_join(a, b, key, [F.col("id_a")], rows=MEMBERS).filter("id_a < id_b").select("id_a", "id_b").distinct()


def classes(members: DataFrame, key: Sequence[str]) -> DataFrame:
    """``id``, ``class`` and ``links`` of the members that share their key with others: the smallest id, and how many others."""
    from lodegraph.operators.skew import salted_join

    key = list(key)
    m = materialize(members.select("id", *key).dropna().distinct(), "members")
    least = m.groupBy(*key).agg(F.min("id").alias("class"), (F.count("*") - 1).alias("links")).filter("links > 0")
    return salted_join(m, least, key, [F.col("id")]).select("id", "class", "links")
