"""A classifier of candidates, and policies that ask it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.rank.features import NAMES, priority
from lodegraph.rank.metrics import capped, weights


def fit(rows: DataFrame, names: Sequence[str] = NAMES, cap: int = 64, seed: int = 0, rounds: int = 40, depth: int = 5, reweight: bool = False, group: str = "grp", y: str = "y") -> PipelineModel:
    """Boosted trees on ``rows`` (features, ``group``, ``y``, and ``credit`` if there is one), each group cut to ``cap`` rows."""
    kept = capped(rows.filter(F.col(y).isNotNull()), group, y, cap, seed)
    kept = weights(kept, rows, group, y) if reweight else kept.withColumn("weight", F.lit(1.0))
    if "credit" in rows.columns:
        kept = kept.withColumn("weight", F.when(F.col(y) == 1, F.col("weight") * F.col("credit")).otherwise(F.col("weight")))
    vector = VectorAssembler(inputCols=list(names), outputCol="_x", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="_x", labelCol="_label", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[vector, trees]).fit(kept.na.fill(0.0, list(names)).withColumn("_label", F.col(y).cast("double")))


def score(model: PipelineModel, rows: DataFrame, alpha: float = 1.0, names: Sequence[str] = NAMES) -> DataFrame:
    """``rows`` with ``p`` and ``priority``."""
    out = model.transform(rows.na.fill(0.0, list(names))).withColumn("p", vector_to_array("probability")[1])
    return out.withColumn("priority", priority(F.col("p"), F.col("log_relevant"), alpha)).drop("_x", "rawPrediction", "probability", "prediction")
