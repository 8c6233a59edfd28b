"""Session helpers: scratch tables that survive lost executors, and sizing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Shuffle files are deleted at the end of the write that made them; nothing else reads them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests,
    a single machine) a temporary folder is made; on any other master that would be a
    folder the executors cannot share, so it is refused.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="lodegraph-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


_scope: ContextVar[str] = ContextVar("scope", default="kept")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables of the operators called inside are deleted at the end, those made outside are not.

    Results may still read them: write or collect these inside.
    """
    token = _scope.set(uuid.uuid4().hex)
    try:
        yield
    finally:
        _drop(spark, f"lodegraph-tables/{_scope.get()}")
        _scope.reset(token)


def materialize(df: DataFrame, label: str = "t", by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the scratch folder and read it back; ``by`` names a column to partition the files by.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    anything that depends on task order (generated ids) is fixed by the write.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lodegraph-tables/{_scope.get()}/{label}-{uuid.uuid4().hex}"
    _write(df, path, by)
    return spark.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str, by: str | None) -> None:
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        # Version 2 writes sorted numbers as differences.
        df.write.option("compression", "zstd").option("parquet.writer.version", "v2").parquet(path, partitionBy=by)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def settled(spark: SparkSession, build: Callable[[], DataFrame], label: str, by: str | None = None) -> DataFrame:
    """What ``build`` gives, as a written table; the tables written on the way there are deleted."""
    path = f"{scratch_dir(spark)}/lodegraph-tables/{_scope.get()}/{label}-{uuid.uuid4().hex}"
    with scratch(spark):
        df = build()
        _write(df, path, by)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table; results that still read them become unusable."""
    _drop(spark, "lodegraph-tables")


def _drop(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cores(spark: SparkSession) -> int:
    """Tasks that can run at once; at least 1."""
    return max(1, spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
