"""Regression models: training, evaluation, importances, and stored versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayframe.operators.prepare import assembler
from stayframe.operators.profile import column_info
from stayframe.operators.trees import BinnedRows, HistogramTrees, binned, settings_json

# The parameter sets that are trained and compared.
FOREST_V1 = {"n_estimators": 200, "max_depth": 10, "max_features": 1, "min_samples_leaf": 5, "random_state": 42}
FOREST_V2 = {"n_estimators": 100, "max_depth": 15, "max_features": 0.8, "min_samples_leaf": 4, "random_state": 42}
FOREST_TRACKED = {"n_estimators": 100, "max_depth": 5, "random_state": 42}
BOOSTING_V1 = {"n_estimators": 100, "max_depth": 4, "max_features": 0.8, "min_samples_leaf": 4, "random_state": 42}
BOOSTING_V2 = {"n_estimators": 150, "max_depth": 5, "max_features": 0.9, "min_samples_leaf": 4, "random_state": 42}

METRICS = ["r2", "mse", "rmse", "mae"]


def linear(features: Sequence[str], label: str) -> Pipeline:
    regression = LinearRegression(featuresCol="features", labelCol=label, predictionCol="prediction")
    return Pipeline(stages=[assembler(features), regression])


def _trees(kind: str, features: Sequence[str], label: str, params: Mapping) -> Pipeline:
    settings = settings_json(params)
    return Pipeline(stages=[HistogramTrees(kind=kind, inputCols=list(features), labelCol=label, settings=settings)])


def forest(features: Sequence[str], label: str, params: Mapping = {}) -> Pipeline:
    """Bagged trees; ``params`` are those of :class:`~stayframe.operators.trees.TreeSettings`."""
    return _trees("forest", features, label, params)


def boosting(features: Sequence[str], label: str, params: Mapping = {}) -> Pipeline:
    """Trees that each fit what the ones before leave; ``params`` as for :func:`forest`."""
    return _trees("boosting", features, label, params)


def fit_trees(candidates: Mapping[str, Pipeline], train: DataFrame, keys: Sequence[str]) -> dict[str, PipelineModel]:
    """Fit tree models on the same rows, which are cut into bins once for all candidates of equal inputs.

    ``keys`` identify a row and choose, by hash, which trees draw it: equal rows and settings give equal trees, whatever
    the partitioning.
    """
    kept: dict[tuple, BinnedRows] = {}
    try:
        fitted = {}
        for name, candidate in candidates.items():
            (stage,) = candidate.getStages()
            wanted = (tuple(stage.getInputCols()), stage.getLabelCol(), stage.tree_settings().max_bins)
            if wanted not in kept:
                kept[wanted] = binned(train, *wanted[:2], keys, wanted[2]).kept()
            fitted[name] = PipelineModel(stages=[stage.grown(kept[wanted])])
        return fitted
    finally:
        for data in kept.values():
            data.release()


def metric_columns(label: str | Column = "price", prediction: str | Column = "prediction") -> dict[str, Column]:
    """Aggregates for r2, mse, rmse and mae; use them in one ``agg``, grouped or not. r2 of a constant label is null."""
    y = F.col(label) if isinstance(label, str) else label
    error = y - (F.col(prediction) if isinstance(prediction, str) else prediction)
    mse = F.avg(error * error)
    return {"r2": 1 - F.try_divide(mse, F.var_pop(y)), "mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(error))}


def evaluate(predictions: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row with the row count and all metrics."""
    metrics = metric_columns(label, prediction)
    return predictions.agg(F.count("*").alias("n_rows"), *[column.alias(name) for name, column in metrics.items()])


def evaluate_splits(model: PipelineModel, train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Metrics on training and test rows, one row each."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    metrics = metric_columns(label)
    return (
        model.transform(both)
        .groupBy("split")
        .agg(F.count("*").alias("n_rows"), *[column.alias(name) for name, column in metrics.items()])
    )


def importances(model: PipelineModel) -> DataFrame:
    """(Feature, Importance), most important first. One row per model input: metadata, not data."""
    inputs = model.stages[-1].getInputCols()
    weights = model.stages[-1].featureImportances
    rows = [(name, float(weight)) for name, weight in zip(inputs, weights, strict=True)]
    spark = SparkSession.active()
    return spark.createDataFrame(rows, "Feature string, Importance double").orderBy(F.desc("Importance"), "Feature")


def vector_columns(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """Spread a vector column over named double columns."""
    values = vector_to_array(F.col(vector))
    return df.withColumns({name: values[i] for i, name in enumerate(names)})


def signature(df: DataFrame) -> DataFrame:
    """Position, name and type of a frame's columns, and whether each is required: it holds no null in the data."""
    return column_info(df).select(
        "position", F.col("column_name").alias("name"), "type", (F.col("non_null") == F.col("n_rows")).alias("required")
    )


def compare(models: Mapping[str, PipelineModel], train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Train and test metrics of several models side by side, one row per model; all in one pass over the rows."""
    scored = train.withColumn("_split", F.lit("train")).unionByName(test.withColumn("_split", F.lit("test")))
    for i, model in enumerate(models.values()):
        # Only the prediction is kept, so that stages of several models may use the same names in between.
        kept = [*train.columns, "_split", *[f"_p{k}" for k in range(i)]]
        scored = model.transform(scored).select(*kept, F.col("prediction").alias(f"_p{i}"))
    measured = scored.groupBy("_split").agg(
        *[F.struct(*[column.alias(name) for name, column in metric_columns(label, f"_p{i}").items()]).alias(f"_m{i}") for i in range(len(models))]
    )
    runs = [F.struct(F.lit(name).alias("run"), f"_m{i}.*") for i, name in enumerate(models)]
    rows = measured.select("_split", F.inline(F.array(*runs)))
    return rows.groupBy("run").pivot("_split", ["train", "test"]).agg(*[F.max(metric).alias(metric) for metric in METRICS])
