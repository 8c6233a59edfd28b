"""Tests of the query language as columns, and the fields they are made on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph import natives
from lodegraph.lgql.parser import Filter, Test
from lodegraph.log import View

Value = Mapping[str, Column]
_NONE = {"kind": None, "bool": "boolean", "int": "decimal(20,0)", "num": "double", "str": "string", "json": "string"}


def stored(prefix: str = "val_") -> Value:
    """The value columns of a property row."""
    return {k: F.col(prefix + k) for k in _NONE}


def _value(kind: str, **known: Column) -> Value:
    return {k: known.get(k, F.lit(None).cast(t or "string")) for k, t in _NONE.items()} | {"kind": F.lit(kind)}


def number(c: Column) -> Value:
    return _value("number", int=c.cast("decimal(20,0)"), num=c.cast("double"))


def string(c: Column) -> Value:
    return _value("string", str=c)


def descend(v: Value, path: tuple[str, ...]) -> Value:
    """The value below an object; unresolved (kind null) where there is none."""
    if not path:
        return v
    steps = "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path)
    sub = F.try_variant_get(F.when(v["kind"] == "object", F.try_parse_json(v["json"])), steps, "variant")
    what = F.schema_of_variant(sub)
    kind = (
        F.when(what == "VOID", F.lit("null")).when(what == "BOOLEAN", F.lit("boolean")).when(what == "STRING", F.lit("string"))
        .when(what.startswith("ARRAY"), F.lit("array")).when(what.startswith("OBJECT"), F.lit("object"))
        .when(what.isin("BIGINT", "DOUBLE", "FLOAT") | what.startswith("DECIMAL"), F.lit("number"))
    )
    get = lambda t: F.try_variant_get(sub, "$", t)
    whole = (what == "BIGINT") | what.rlike(r"^DECIMAL\(\d+,0\)$")
    return {
        "kind": kind, "bool": F.when(kind == "boolean", get("boolean")), "int": F.when(whole, get("decimal(20,0)")),
        "num": F.when(kind == "number", get("double")), "str": F.when(kind == "string", get("string")), "json": F.to_json(sub),
    }


def _equals(v: Value, x: Any) -> Column:
    if x is None:
        return v["kind"] == "null"
    if isinstance(x, bool):
        return (v["kind"] == "boolean") & (v["bool"] == x)
    if isinstance(x, str):
        return (v["kind"] == "string") & (v["str"] == x)
    return (v["kind"] == "number") & _ordered(v, "==", x)


def _ordered(v: Value, op: str, x: Any) -> Column:
    def compare(a: Column, b: Any) -> Column:
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b}[op]

    if isinstance(x, str):
        return (v["kind"] == "string") & compare(v["str"], x)
    as_double = compare(v["num"], float(x))
    if isinstance(x, int) and abs(x) < 10**20:
        # Whole numbers compare with all their digits, anything else as doubles.
        as_double = F.when(v["int"].isNotNull(), compare(v["int"], F.lit(str(x)).cast("decimal(20,0)"))).otherwise(as_double)
    return (v["kind"] == "number") & as_double


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def holds(test: Test, v: Value) -> Column:
    """Whether a test passes: never null, and false for every test where the value is unresolved."""
    there = v["kind"].isNotNull()
    equal = _any([_equals(v, x) for x in dict.fromkeys((type(x), x) for x in test.args) for x in [x[1]]]) if test.op in ("in", "not_in") else None
    if test.op == "exists":
        c = there
    elif test.op == "in":
        c = equal
    elif test.op == "not_in":
        c = there & ~equal
    elif test.op in ("re", "not_re"):
        found = _any([v["str"].rlike(r) for r in test.args])
        c = (v["kind"] == "string") & (found if test.op == "re" else ~found)
    elif test.op in ("is", "is_not"):
        c = v["kind"].isin(*test.args) if test.op == "is" else there & ~v["kind"].isin(*test.args)
    else:
        c = (v["kind"] == "number" if not isinstance(test.args[0], str) else v["kind"] == "string") & _ordered(v, test.op, test.args[0])
    return F.coalesce(c, F.lit(False))


def implied(test: Test, v: Value) -> Column:
    """What follows from ``holds`` and can be decided from file statistics: a plain comparison with literals, else true.

    Whole numbers that are equal or ordered are so as doubles too, except that strict order may become equality.
    """
    numbers = [float(x) for x in test.args if isinstance(x, (int, float)) and not isinstance(x, bool)]
    strings = [x for x in test.args if isinstance(x, str)]
    if test.op == "in" and test.args and len(strings) == len(test.args):
        return v["str"].isin(*strings) if len(strings) > 1 else v["str"] == strings[0]
    if test.op == "in" and test.args and len(numbers) == len(test.args):
        return v["num"].isin(*numbers) if len(numbers) > 1 else v["num"] == numbers[0]
    if test.op in ("<", "<=", ">", ">="):
        c, x = (v["str"], strings[0]) if strings else (v["num"], numbers[0])
        return c <= x if test.op[0] == "<" else c >= x
    return F.lit(True)


SCALARS = {"ID": ("id", number), "type": ("type", string), "value": ("value", string)}
ENDS = {"src": "src", "tgt": "tgt", "srcID": "src", "tgtID": "tgt"}


@dataclass(frozen=True)
class Native:
    """How a filter on a field that is not a property is made: ``constant`` on the row's own columns, else by name."""

    constant: Value | None = None
    name: str | None = None


def native(kind: str, path: tuple[str, ...]) -> Native | None:
    """The native field of a path; None if the path names a property."""
    first, rest = path[0], path[1:]
    missing = Native({k: F.lit(None).cast(t or "string") for k, t in _NONE.items()})
    if kind == "e" and first in ENDS and not (rest and first in ("src", "tgt")):
        return missing if rest else Native(number(F.col(ENDS[first])))
    if first in SCALARS:
        column, of = SCALARS[first]
        return missing if rest else Native(of(F.col(column)))
    if kind == "n":
        if first in (*natives.COUNTS, *natives.NEIGHBOURS):
            return missing if rest else Native(name=first)
        if first in natives.LISTS:
            return missing if rest else Native(_value("array"))
        if first == "neighbor_types":
            if len(rest) > 1:
                return missing
            return Native(name="neighbor_types") if rest else Native(_value("object"))
    return None


def properties(props: DataFrame, f: Filter) -> DataFrame:
    """The property rows that make a filter hold."""
    own = F.col("key") == f.path[0]
    if len(f.path) == 1:
        own = own & implied(f.test, stored())
    return props.filter(own & holds(f.test, descend(stored(), f.path[1:])))


def constant(f: Filter, v: Value) -> Column:
    """A filter on a row's own column."""
    if f.path == ("ID",) and f.test.op == "in":
        ids = [int(x) for x in f.test.args if isinstance(x, (int, float)) and not isinstance(x, bool) and x == int(x) and abs(x) < 2**63]
        return F.col("id").isin(*ids) if ids else F.lit(False)
    return implied(f.test, v) & holds(f.test, v)


def narrow(view: View, kind: str, rows: DataFrame, f: Filter) -> DataFrame:
    """The rows of nodes (``n``) or edges (``e``) that pass a filter. Each row stays once: property filters are semi-joins."""
    first = f.path[0]
    if kind == "e" and first in ("src", "tgt") and len(f.path) > 1:
        ends = narrow(view, "n", view.nodes, Filter(f.path[1:], f.test)).select(F.col("id").alias("_end"))
        return rows.join(ends, F.col(first) == F.col("_end"), "left_semi")
    n = native(kind, f.path)
    if n is None:
        has = properties(view.props, f).select(F.col("parent").alias("_of"))
        return rows.join(has, F.col("id") == F.col("_of"), "left_semi")
    if n.constant is not None:
        return rows.filter(constant(f, n.constant))
    if n.name == "neighbor_types":
        table, column = natives.neighbour_types(view).filter(F.col("type") == f.path[1]), "n"
    elif n.name in natives.NEIGHBOURS:
        table, column = natives.neighbour_counts(view), n.name
    else:
        table, column = natives.degrees(view), n.name
    ok = table.filter(holds(f.test, number(F.col(column)))).select(F.col("id").alias("_of"))
    return rows.join(ok, F.col("id") == F.col("_of"), "left_semi")
