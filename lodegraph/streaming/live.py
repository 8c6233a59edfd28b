"""Standing queries on a log that grows, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodegraph.lgql import standing
from lodegraph.kept import LEAST_DELTA, PART_OF_BASE, Kept
from lodegraph.schema import LOG
from lodegraph.session import materialize


def watch(spark: SparkSession, arriving: str, kept: str, texts: Sequence[str], checkpoint: str, report: Callable[[DataFrame, int], None], files: int = 100, once: bool = False) -> StreamingQuery:
    """Reports what the patterns match anew as log rows arrive in a folder of Parquet files.

    Each micro-batch is appended to the history in ``kept`` under its number: what its rows end is computed and
    written, the rest of the log is not derived again. The patterns are evaluated for
    the positions of the batch; ``report`` gets the matches (``pattern``, ``at``, ``chain``) and the batch's number.
    A batch that is repeated after a failure replaces its own rows and reports the same
    matches again, so a sink that writes by batch number has each exactly once. With ``once`` the query ends
    when all that is there has been seen.
    """
    store = Kept(spark, kept)

    def batch(df: DataFrame, number: int) -> None:
        new = materialize(df, "arrived")
        ends = new.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
        if ends.a is None:
            return
        m = store.append(new, number)
        report(standing(store.history(), texts, ends.a, ends.b), number)
        # Earlier batches are done with: a stream repeats its last one only.
        if sum(p["size"] for p in m["parts"][:-1]) > max(LEAST_DELTA, m["base_rows"] // PART_OF_BASE):
            store.compact()

    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).parquet(arriving)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
