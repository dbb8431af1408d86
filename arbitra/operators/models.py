"""Typed heads on hashed features with ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def _tokens(df: DataFrame, state: str) -> DataFrame:
    return df.withColumn("_tokens", words(F.coalesce(state, F.lit(""))))


def train_choice(df: DataFrame, state: str = "state", target: str = "target", weight: str | None = None, features: int = 4096, iterations: int = 20) -> PipelineModel:
    """A multinomial head; ``weight`` makes hard negatives count more."""
    head = LogisticRegression(family="multinomial", featuresCol="_x", labelCol="_y", maxIter=iterations, regParam=1e-3, **({"weightCol": weight} if weight else {}))
    steps = [StringIndexer(inputCol=target, outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc"), HashingTF(numFeatures=features, inputCol="_tokens", outputCol="_x"), head]
    return Pipeline(stages=steps).fit(_tokens(df, state))


def predict_choice(model: PipelineModel, df: DataFrame, state: str = "state") -> DataFrame:
    """``df`` with selected, its probability and all logits."""
    labels = F.array(*map(F.lit, model.stages[0].labels))
    steps = PipelineModel(stages=model.stages[1:])
    out = steps.transform(_tokens(df, state))
    p = vector_to_array("probability")
    return out.select(
        *df.columns, F.element_at(labels, F.col("prediction").cast("int") + 1).alias("selected"), F.round(F.array_max(p), 6).alias("confidence"), vector_to_array("rawPrediction").alias("logits")
    )


def train_score(df: DataFrame, state: str = "state", target: str = "target", features: int = 4096, iterations: int = 20) -> PipelineModel:
    head = LinearRegression(featuresCol="_x", labelCol=target, maxIter=iterations, regParam=1e-2)
    return Pipeline(stages=[HashingTF(numFeatures=features, inputCol="_tokens", outputCol="_x"), head]).fit(_tokens(df, state))


def predict_score(model: PipelineModel, df: DataFrame, state: str = "state") -> DataFrame:
    """``df`` with a score within 0 and 1."""
    out = model.transform(_tokens(df, state))
    return out.select(*df.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("score"))
