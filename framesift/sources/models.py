"""A model as a file of one row."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from framesift import schema as S
from framesift.operators.learn import Model


def save(spark: SparkSession, model: Model, path: str) -> None:
    model.frame(spark).coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> Model | None:
    """The model kept there; none if it isn't there or saw frames another
    way."""
    try:
        return Model.of(spark.read.schema(S.MODEL).json(path))
    except AnalysisException:
        return None
