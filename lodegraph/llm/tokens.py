"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import materialize

#: The setting that names the vocabulary file to count with; it must lie at this path on every executor.
CONF = "spark.lodegraph.vocabulary"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts were cut into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in parts of so many characters at most, cut at white space where
#: there is any, so that one text never needs more memory than that.
PART = 200_000


@cache
def encoding(path: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, enc: tiktoken.Encoding) -> int:
    """Tokens of a whole text; null and empty texts have none."""
    if not text:
        return 0
    n, at = 0, 0
    while at < len(text):
        end = min(at + PART, len(text))
        if end < len(text) and (cut := text.rfind(" ", at + PART // 2, end)) > at:
            end = cut
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def token_counts(documents: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """``doc_id``, ``tokens`` and the columns ``keep`` of each document, as a written table.

    Each text is sent to Python once. ``path`` is the vocabulary file; by default that of the setting ``CONF``. Rows without ``doc_id`` are left out; repeated ids count once.
    """
    path = path or documents.sparkSession.conf.get(CONF, VOCABULARY)
    rows = documents.select("doc_id", "text", *keep).filter("doc_id is not null")
    schema = rows.drop("text").schema.add("tokens", "long")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in it:
            yield pdf.drop(columns="text").assign(tokens=[count(t, enc) for t in pdf["text"]])

    return materialize(rows.mapInPandas(run, schema).dropDuplicates(["doc_id"]), "tokens")
