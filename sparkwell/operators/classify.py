"""Plate models: gradient-boosted trees over shape features, out-of-fold predictions by group."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .hits import band
from .storage import checkpointed

FOLDS = 5


def _ready(features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Missing measures are -1, as undefined ones."""
    return features.withColumns({n: F.coalesce(F.nanvl(F.col(n), F.lit(-1.0)), F.lit(-1.0)) for n in names})


def train(features: DataFrame, names: tuple[str, ...], seed: int = 0) -> PipelineModel:
    """``features`` has the named columns and label 0 or 1."""
    stages = [VectorAssembler(inputCols=list(names), outputCol="_x"), GBTClassifier(labelCol="label", featuresCol="_x", maxIter=20, maxDepth=3, seed=seed, predictionCol="prediction")]
    return Pipeline(stages=stages).fit(_ready(features, names))


def predict(model: PipelineModel, features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Adds ``p_target`` and the prediction."""
    return model.transform(_ready(features, names)).withColumn("p_target", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability")


def out_of_fold(features: DataFrame, names: tuple[str, ...], group: str, folds: int = FOLDS) -> DataFrame:
    """Each plate predicted by a model that saw no plate of its group; a fold without both labels to learn from is left out."""
    rows = checkpointed(features.withColumn("_fold", F.pmod(F.xxhash64(group), F.lit(folds))))
    out = []
    for k in range(folds):
        own = rows.where(F.col("_fold") == k)
        rest = rows.where(F.col("_fold") != k)
        if own.isEmpty() or rest.select("label").distinct().count() < 2:
            continue
        out.append(predict(train(rest, names), own, names))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.drop("_fold")


#: Right-closed bands of the number of binders of a plate.
BINDER_BANDS = (-1.0, 0.0, 2.0, 10.0, 30.0, 96.0)


def baseline(predicted: DataFrame) -> DataFrame:
    """(measure, name, accuracy, plates): how often out-of-fold predictions are right, over all, by scenario and by number of binders.

    ``predicted`` has label, prediction, scenario, n_binders. Plates without a
    binder look alike on both sides, so that chance is what they should score.
    """
    right = predicted.withColumn("_right", (F.col("prediction") == F.col("label")).cast("double"))
    banded = right.withColumn("_band", band(F.col("n_binders"), BINDER_BANDS).cast("string"))
    per = lambda rows, measure, name: rows.groupBy(name.alias("name")).agg(F.avg("_right").alias("accuracy"), F.count("*").alias("plates")).select(F.lit(measure).alias("measure"), "name", "accuracy", "plates")
    return per(right, "all", F.lit("all")).unionByName(per(right, "scenario", F.col("scenario"))).unionByName(per(banded, "binders", F.col("_band")))


def latest_model(models: DataFrame) -> Row | None:
    """The (model_id, path) of the model that was saved last; null if there is none."""
    return models.orderBy(F.desc("created_at"), F.desc("model_id")).first()


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
