"""Fitted models as Parquet tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sensorweave.operators.codebook import SCHEMA, Codebook
from sensorweave.operators.fuzzy import FuzzyModel

FUZZY_SCHEMA = (
    "inputs array<string>, kind string, sets array<array<array<double>>>, rules array<array<int>>, "
    "output string, coef array<double>, coef_shape array<int>, bias array<double>"
)


def write_codebook(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Save a map, one row per neuron."""
    table.coalesce(1).write.mode(mode).parquet(path)


def read_codebook(spark: SparkSession, path: str) -> Codebook:
    return Codebook.from_table(spark.read.schema(SCHEMA).parquet(path))


def fuzzy_table(spark: SparkSession, model: FuzzyModel) -> DataFrame:
    row = (list(model.inputs), model.kind, [s.tolist() for s in model.sets], model.rules.tolist(), model.output,
           np.ravel(model.coef).tolist(), list(np.shape(model.coef)), None if model.bias is None else model.bias.tolist())
    return spark.createDataFrame([row], FUZZY_SCHEMA)


def write_fuzzy(spark: SparkSession, model: FuzzyModel, path: str, mode: str = "overwrite") -> None:
    """Save a neuro-fuzzy model as one row."""
    fuzzy_table(spark, model).coalesce(1).write.mode(mode).parquet(path)


def read_fuzzy(spark: SparkSession, path: str) -> FuzzyModel:
    r = spark.read.schema(FUZZY_SCHEMA).parquet(path).first()
    return FuzzyModel(tuple(r.inputs), r.kind, tuple(np.array(s, dtype=float) for s in r.sets), np.array(r.rules),
                      r.output, np.array(r.coef, dtype=float).reshape(r.coef_shape),
                      None if r.bias is None else np.array(r.bias, dtype=float))
