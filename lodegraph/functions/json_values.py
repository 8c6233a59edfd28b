"""Functions on JSON values and identifiers, as columns where Spark has the parts, else on batches."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegraph.schema import canonical


def truthy(v: dict[str, Column]) -> Column:
    """Whether a typed value counts as true: not null, false, zero, or empty."""
    return F.coalesce(
        F.when(v["kind"] == "boolean", v["bool"]).when(v["kind"] == "number", v["num"] != 0).when(v["kind"] == "string", v["str"] != "")
        .when(v["kind"] == "array", v["json"] != "[]").when(v["kind"] == "object", v["json"] != "{}"), F.lit(False))


def scalar(v: Any) -> str | None:
    """A scalar as the text that is stored for types and values; None for arrays and objects."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "True" if v else "False"
    if isinstance(v, str):
        return v
    return json.dumps(v) if isinstance(v, (int, float)) else None


def whole(x: float) -> int | float | None:
    """A number as an integer if it is one; None if it is not finite."""
    if not math.isfinite(x):
        return None
    return int(x) if x == int(x) and abs(x) < 2**53 else x


def merge(old: Any, new: Any) -> Any:
    """``new`` merged into ``old``: objects key by key, arrays of one scalar kind as their sorted union, anything else replaced."""
    if isinstance(old, dict) and isinstance(new, dict):
        return {**old, **{k: merge(old.get(k), v) for k, v in new.items()}}
    if isinstance(new, list):
        items = (old if isinstance(old, list) else []) + new
        kinds = {bool if isinstance(x, bool) else float if isinstance(x, (int, float)) else type(x) for x in items}
        if len(kinds) <= 1 and kinds <= {bool, float, str}:
            out: list = []
            for x in sorted(items):
                if not out or out[-1] != x:
                    out.append(x)
            return out
        return new
    return new


def merge_json(old: pd.Series, new: pd.Series) -> pd.Series:
    """``merge`` on JSON texts; for ``pandas_udf`` with a string result. A null old value is none."""
    one = lambda a, b: None if b is None else canonical(merge(None if a is None else json.loads(a), json.loads(b)))
    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


UUID = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def uuid_seconds(c: Column) -> Column:
    """Seconds since 1970 of a time-based UUID; null for others."""
    hexes = F.concat(F.substring(c, 16, 3), F.substring(c, 10, 4), F.substring(c, 1, 8))
    ticks = F.conv(hexes, 16, 10).cast("decimal(20,0)")
    return F.when(is_uuid(c) & (F.substring(c, 15, 1) == "1"), (ticks - 0x01B21DD213814000).cast("double") / 1e7)


def date_seconds(c: Column) -> Column:
    """Seconds since 1970 of a date, or of a date and time with minutes, seconds or fractions, in UTC; null if it is neither."""
    p = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2})(?:\.\d+)?)?)?Z?\z"
    time = F.nullif(F.regexp_extract(c, p, 2), F.lit(""))
    text = F.concat(F.regexp_extract(c, p, 1), F.lit(" "), F.coalesce(time, F.lit("00:00")), F.lit(":"), F.coalesce(F.nullif(F.regexp_extract(c, p, 3), F.lit("")), F.lit("00")), F.lit("+00:00"))
    return F.when(c.rlike(p), F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ssxxx"))))


def words(c: Column) -> Column:
    """The distinct words of a text, split at anything but letters, digits and the underscore."""
    return F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


def user_roles(meta: Column) -> Column:
    """Which of a graph's roles a text of user or role names reaches is decided on arrays of words."""
    return F.coalesce(meta, F.array().cast("array<string>"))


def answer_key(model: Column, question: Column, text: Column) -> Column:
    """The key under which an answer is stored."""
    return F.sha2(F.concat_ws("\x00", model, question, text), 256)
