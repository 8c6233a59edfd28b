"""The change log's columns, and values in typed columns beside their JSON text."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE_FIELDS = [
    T.StructField("val_kind", T.StringType()), T.StructField("val_bool", T.BooleanType()), T.StructField("val_int", T.DecimalType(20, 0)),
    T.StructField("val_num", T.DoubleType()), T.StructField("val_str", T.StringType()), T.StructField("val_json", T.StringType()),
]
#: One row per change. ``kind`` is node, edge, prop or deletion; ids start at 1, parent 0 is the graph.
LOG = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("kind", T.StringType(), False), T.StructField("type", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("src", T.LongType()), T.StructField("tgt", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("key", T.StringType()), *VALUE_FIELDS,
    T.StructField("target", T.LongType()),
])
#: A log row with the position that ended it, and such positions alone.
HISTORY = T.StructType([*LOG.fields, T.StructField("next", T.LongType())])
ENDS = T.StructType([T.StructField("id", T.LongType()), T.StructField("next", T.LongType())])
VALUES = [f.name for f in VALUE_FIELDS]


def canonical(value: Any) -> str:
    """JSON text with sorted keys and no blanks: equal values have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def shred(value: Any) -> dict[str, Any]:
    """A JSON value as the typed columns of a log row. Booleans are not numbers; integers keep all their digits."""
    out: dict[str, Any] = dict.fromkeys(VALUES) | {"val_json": canonical(value)}
    if value is None:
        out["val_kind"] = "null"
    elif isinstance(value, bool):
        out |= {"val_kind": "boolean", "val_bool": value}
    elif isinstance(value, int):
        from decimal import Decimal

        out |= {"val_kind": "number", "val_num": float(value), "val_int": Decimal(value) if abs(value) < 10**20 else None}
    elif isinstance(value, float):
        out |= {"val_kind": "number", "val_num": value}
    elif isinstance(value, str):
        out |= {"val_kind": "string", "val_str": value}
    else:
        out["val_kind"] = "array" if isinstance(value, list) else "object"
    return out


def typed(c: Column, kind: str) -> list[Column]:
    """The value columns of a Spark column that holds strings, numbers or booleans throughout."""
    none = {n: F.lit(None).cast(f.dataType) for n, f in zip(VALUES, VALUE_FIELDS, strict=True)}
    if kind == "string":
        none |= {"val_str": c, "val_json": F.to_json(F.struct(c.alias("v")))}
        none["val_json"] = F.regexp_extract(none["val_json"], r"(?s)^\{\"v\":(.*)\}$", 1)
    elif kind == "integer":
        none |= {"val_int": c.cast("decimal(20,0)"), "val_num": c.cast("double"), "val_json": c.cast("string")}
    elif kind == "number":
        none |= {"val_num": c.cast("double"), "val_json": c.cast("string")}
    elif kind == "boolean":
        none |= {"val_bool": c, "val_json": c.cast("string")}
    else:
        raise ValueError(kind)
    none["val_kind"] = F.lit("number" if kind == "integer" else kind)
    return [none[n].alias(n) for n in VALUES]


def as_log(rows: DataFrame) -> DataFrame:
    """Rows with some of the log's columns, as log rows: the others are null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG.fields])
