"""Relational tables as a property graph: one log that finds or creates every node and edge once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.schema import LOG, VALUES, typed
from lodegraph.session import materialize, settled

#: Places in a partition, as monotonically_increasing_id counts them.
_PLACE = (1 << 33) - 1


@dataclass(frozen=True)
class Nodes:
    """Nodes of a type; ``value`` names each, ``props`` maps keys to a column and its kind (string, integer, number, boolean)."""

    type: str
    rows: DataFrame
    value: Column
    props: Mapping[str, tuple[Column, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Edges:
    """Edges of a type; ends are (node type, value). ``value`` tells parallel edges apart."""

    type: str
    rows: DataFrame
    src: tuple[str, Column]
    tgt: tuple[str, Column]
    value: Column | None = None
    props: Mapping[str, tuple[Column, str]] = field(default_factory=dict)


def load(nodes: Sequence[Nodes], edges: Sequence[Edges]) -> DataFrame:
    """The log of a graph: nodes, edges, then properties, as a written table.

    Equal nodes and equal edges are created once, with the least of each property's values if rows
    disagree; edges whose ends are not among the nodes are left out, null properties too.
    Nothing in it ends: there are no deletions, and each key of a parent occurs once.
    Ids are ranks in distributed partitions, so that no task numbers all rows: nodes by type
    and value, edges by type, ends and value, properties by parent and key. Properties travel with their
    node or edge, so that each table is sorted once. Files are by kind, sorted by type, key and value.
    """
    if not nodes:
        raise ValueError("a graph needs nodes")
    return settled(nodes[0].rows.sparkSession, lambda: _log(nodes, edges), "log", by="kind")


def _log(nodes: Sequence[Nodes], edges: Sequence[Edges]) -> DataFrame:
    n, node_counts = _placed([(n.type, n.rows.select(F.lit(n.type).alias("type"), n.value.cast("string").alias("value"), *_own(n)).filter("value is not null")) for n in nodes], nodes, "node")
    count, above = sum(c for _, c, _ in node_counts), sum(p for _, _, p in node_counts)
    ids = _numbered(n.filter("kind = 'node'"), node_counts, 0, 0).select(F.col("type").alias("_t"), F.col("value").alias("_v"), F.col("id").alias("_id"))

    def end(df: DataFrame, type_: str, column: str, out: str) -> DataFrame:
        side = ids.filter(F.col("_t") == type_).select(F.col("_v").alias(column), F.col("_id").alias(out))
        return df.join(side, column).drop(column)

    rows = []
    for e in edges:
        part = e.rows.select(e.src[1].cast("string").alias("_s"), e.tgt[1].cast("string").alias("_g"), (e.value.cast("string") if e.value is not None else F.lit("")).alias("value"), *_own(e))
        part = part if e.props else part.distinct()
        # A written table after each join: shuffle files of one are gone when the next begins.
        part = settled(part.sparkSession, lambda e=e, part=part: end(materialize(end(part, e.src[0], "_s", "src"), "ends"), e.tgt[0], "_g", "tgt"), "ends")
        rows.append((e.type, part.withColumn("type", F.lit(e.type))))
    if not rows:
        return _laid_out(_numbered(n, node_counts, 0, count))
    linked, edge_counts = _placed(rows, edges, "edge")
    total = count + sum(c for _, c, _ in edge_counts)
    return _laid_out(_numbered(n, node_counts, 0, total).union(_numbered(linked, edge_counts, count, total + above)))


def _own(spec: Nodes | Edges) -> list[Column]:
    return [c.alias(f"_p{k}") for k, (c, _) in enumerate(spec.props.values())]


def _placed(found: Sequence[tuple[str, DataFrame]], specs: Sequence[Nodes | Edges], kind: str) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Nodes or edges, each once and followed by its properties in the order of their keys, and how many of both each partition has.

    ``_row`` is the place of the node or edge among those of its partition, ``_at`` the place among all rows there.
    """
    keys = ["type", "value"] if kind == "node" else ["type", "src", "tgt", "value"]
    # A column for each property of each table, null in the others.
    cells = [(i, k, t, key, how, df.schema[f"_p{k}"].dataType) for i, ((t, df), s) in enumerate(zip(found, specs, strict=True)) for k, (key, (_, how)) in enumerate(s.props.items())]
    every = None
    for i, (_, df) in enumerate(found):
        part = df.select(*keys, *[(F.col(f"_p{k}") if j == i else F.lit(None)).cast(of).alias(f"_p{j}_{k}") for j, k, _, _, _, of in cells])
        every = part if every is None else every.union(part)
    # Partitions by ranges of all keys have equal rows together: they are made one there, without another shuffle.
    parts = every.repartitionByRange(*[F.col(k) for k in keys])
    json = lambda c, how: typed(c, how)[VALUES.index("val_json")]
    least = [F.min(F.when(F.col(p).isNotNull(), F.struct(json(F.col(p), how), F.col(p).alias("of")))).alias(p) for j, k, _, _, how, _ in cells for p in [f"_p{j}_{k}"]]
    once = (parts.groupBy(*keys).agg(*least) if least else parts.distinct()).sortWithinPartitions(*keys)
    order = ["val_json", *[v for v in VALUES if v != "val_json"]]
    by: dict[tuple[str, str], list[Column]] = {}
    for j, k, t, key, how, _ in cells:
        value = F.struct(*typed(F.col(f"_p{j}_{k}.of"), how)).alias("v")
        by.setdefault((key, t), []).append(F.when(F.col(f"_p{j}_{k}").isNotNull(), F.struct(*[value[v].alias(v) for v in order])))
    none = {f.name: F.lit(None).cast(f.dataType) for f in LOG.fields}
    items = [F.array(F.struct(none["key"].alias("key"), *[none[v].alias(v) for v in order]))]
    if by:
        values = [(key, t, c[0] if len(c) == 1 else F.least(*c)) for (key, t), c in sorted(by.items())]
        items.append(F.filter(F.array(*[F.struct(F.lit(key).alias("key"), *[v[x].alias(x) for x in order]) for key, t, v in values]), lambda x: x["val_json"].isNotNull()))
    rows = once.withColumn("_row", F.monotonically_increasing_id()).select(*keys, "_row", F.inline(F.concat(*items))).withColumn("_at", F.monotonically_increasing_id())
    own = F.col("key").isNull()
    rows = rows.select(F.when(own, kind).otherwise("prop").alias("kind"), *[(F.when(own, F.col(k)) if k in keys else none[k]).alias(k) for k in ("type", "value", "src", "tgt")], "key", *VALUES, "_row", "_at")
    placed = materialize(rows, "placed", by="kind")
    # One row a partition.
    counts = placed.groupBy(F.shiftright("_row", 33).cast("int").alias("part")).agg(F.count_if(F.col("kind") != "prop").alias("own"), F.count_if(F.col("kind") == "prop").alias("props"))
    return placed, sorted(tuple(r) for r in counts.collect())


def _numbered(placed: DataFrame, counts: list[tuple[int, int, int]], first: int, first_prop: int) -> DataFrame:
    """Log rows of ``_placed``: ids of nodes or edges after ``first``, of properties after ``first_prop``."""
    shifts = []
    for part, own, props in counts:
        shifts.append((part, first, first_prop))
        first, first_prop = first + own, first_prop + props
    shift = F.broadcast(placed.sparkSession.createDataFrame(shifts, "_part int, _own long, _props long"))  # one row a partition
    of = placed.withColumn("_part", F.shiftright("_row", 33).cast("int")).join(shift, "_part")
    place = F.col("_row").bitwiseAND(F.lit(_PLACE))
    own, prop = F.col("_own") + place + 1, F.col("_props") + F.col("_at").bitwiseAND(F.lit(_PLACE)) - place
    is_prop = F.col("kind") == "prop"
    known = {"id": F.when(is_prop, prop).otherwise(own), "parent": F.when(is_prop, own)}
    have = {f: F.col(f) for f in placed.columns}
    return of.select(*[(known.get(f.name, have.get(f.name, F.lit(None)))).cast(f.dataType).alias(f.name) for f in LOG.fields])


def _laid_out(log: DataFrame) -> DataFrame:
    return log.sortWithinPartitions("kind", "type", "key", "val_str", "val_num", "id")
