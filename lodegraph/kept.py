"""A history kept in a folder of any Hadoop file system: a base and what was appended since, never derived again."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.log import delta, derive_next, with_ends
from lodegraph.schema import ENDS, HISTORY, LOG

# A base is written anew once more rows were appended than both this many and this part of it.
LEAST_DELTA, PART_OF_BASE = 8192, 32


class Folder:
    """Small files of a Hadoop path, written whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/{name}"))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Readers see the old text or the new one: the file takes its name when it is complete."""
        fresh = self._at(f"{self.path}/.{name}-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        files = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark._sc._gateway.new_array(files.Options.Rename, 1)
        options[0] = files.Options.Rename.OVERWRITE
        files.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration()).rename(
            self._fs.makeQualified(fresh), self._fs.makeQualified(self._at(f"{self.path}/{name}")), options)

    def claim(self, name: str) -> bool:
        """Creates a file unless it exists: of several that try, one succeeds."""
        return self._fs.createNewFile(self._at(f"{self.path}/{name}"))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)

    def size(self) -> int:
        return self._fs.getContentSummary(self._at(self.path)).getLength() if self._fs.exists(self._at(self.path)) else 0


class Kept:
    """A history that grows by tables of log rows.

    An append computes what its rows end and writes those rows and ends; a view joins them to
    the base. Once the appended rows outgrow the base's part, they become a new base.
    Readers take a manifest and need no lock; one writer at a time holds one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Folder(spark, path)

    def manifest(self) -> dict[str, Any]:
        if not self.files.exists("manifest.json"):
            return {"base": None, "base_rows": 0, "parts": [], "next_id": 1, "nodes": 0, "edges": 0}
        return json.loads(self.files.read("manifest.json"))

    def _read(self, m: dict[str, Any]) -> DataFrame:
        at = self.files.path
        rows = [f"{at}/{x}" for x in (m["base"], *(p["rows"] for p in m["parts"])) if x]
        if not rows:
            return self.spark.createDataFrame([], HISTORY)
        h = self.spark.read.schema(HISTORY).parquet(*rows)
        ends = [f"{at}/{p['ends']}" for p in m["parts"]]
        return with_ends(h, self.spark.read.schema(ENDS).parquet(*ends)) if ends else h

    def history(self) -> DataFrame:
        return self._read(self.manifest())

    def append(self, new: DataFrame, batch: int | None = None) -> dict[str, Any]:
        """Appends log rows; the manifest after it. A ``batch`` that is appended again replaces what it wrote.

        Rows that do not all come behind those that are kept are put in their places by deriving the whole
        history once.
        """
        if not self.files.claim("lock"):
            raise RuntimeError(f"another writer has {self.files.path}")
        try:
            m = self.manifest()
            if batch is not None and any(p["batch"] == batch for p in m["parts"]):
                m = self._without(m, batch)
            span = new.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).first()
            if span.n and span.a < m["next_id"]:
                whole = self._read(m).drop("next").unionByName(new.select(*LOG.names))
                m = self._rebased({**m, "next_id": max(m["next_id"], span.b + 1)}, derive_next(whole))
            elif span.n:
                rows, ends = delta(self._read(m), new.select(*LOG.names))
                part = {"rows": f"rows-{uuid.uuid4().hex}", "ends": f"ends-{uuid.uuid4().hex}", "batch": batch, "before": [m["next_id"], m["nodes"], m["edges"]]}
                rows.write.parquet(f"{self.files.path}/{part['rows']}")
                ends.write.parquet(f"{self.files.path}/{part['ends']}")
                kind = self._read(m).select("id", "kind").join(ends, "id").groupBy("kind").count().collect()
                gone = {r["kind"]: r["count"] for r in kind}
                born = {r["kind"]: r["count"] for r in rows.filter("next is null").groupBy("kind").count().collect()}
                part["size"] = span.n + sum(gone.values())
                m = {**m, "parts": [*m["parts"], part], "next_id": span.b + 1, "nodes": m["nodes"] + born.get("node", 0) - gone.get("node", 0), "edges": m["edges"] + born.get("edge", 0) - gone.get("edge", 0)}
                if sum(p["size"] for p in m["parts"]) > max(LEAST_DELTA, m["base_rows"] // PART_OF_BASE) and batch is None:
                    m = self._rebased(m, self._read(m))
            self.files.write("manifest.json", json.dumps(m))
            return m
        finally:
            self.files.remove("lock")

    def compact(self) -> None:
        """Makes one base of all that is kept."""
        m = self.manifest()
        if m["parts"]:
            self.files.write("manifest.json", json.dumps(self._rebased(m, self._read(m))))

    def _without(self, m: dict[str, Any], batch: int) -> dict[str, Any]:
        """The manifest without a batch and those after it, which is all that a failed stream has to repeat."""
        at = next(i for i, p in enumerate(m["parts"]) if p["batch"] == batch)
        next_id, nodes, edges = m["parts"][at]["before"]
        return {**m, "parts": m["parts"][:at], "next_id": next_id, "nodes": nodes, "edges": edges}

    def _rebased(self, m: dict[str, Any], history: DataFrame) -> dict[str, Any]:
        name = f"base-{uuid.uuid4().hex}"
        # Files by kind, so that a view of nodes or edges reads no properties; sorted for row groups to be skipped.
        history.select(*HISTORY.names).sortWithinPartitions("kind", "type", "key", "val_str", "val_num").write.parquet(f"{self.files.path}/{name}")
        done = self.spark.read.schema(HISTORY).parquet(f"{self.files.path}/{name}")
        n = done.agg(F.count("*").alias("n"), F.count_if(F.expr("next is null and kind = 'node'")).alias("nodes"), F.count_if(F.expr("next is null and kind = 'edge'")).alias("edges")).first()
        return {**m, "base": name, "base_rows": n.n, "parts": [], "nodes": n.nodes, "edges": n.edges}
