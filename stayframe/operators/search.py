"""Search over model kinds and parameters, distributed throughout."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayframe.functions.rows import key_percentile
from stayframe.operators.compiled import ExpressionColumns, bucket_sql, numbers, quoted
from stayframe.operators.models import METRICS, evaluate
from stayframe.operators.prepare import HASHED_FEATURES, assembler, hashed_categories, key_split
from stayframe.operators.trees import HistogramTrees, TreeSettings, binned, settings_json

# Kinds of tree models: how they are grown, and what they set beside a candidate's parameters.
_TREES = {
    "decision_tree": ("forest", {"n_estimators": 1, "bootstrap": False}),
    "random_forest": ("forest", {"max_features": 1 / 3}),
    "boosting": ("boosting", {}),
}
_TREE_PARAMETERS = {"maxDepth": "max_depth", "numTrees": "n_estimators", "maxIter": "n_estimators", "minInstancesPerNode": "min_samples_leaf"}

DEFAULT_GRID: dict[str, list[dict]] = {
    "linear": [{"regParam": 0.0}, {"regParam": 0.1}],
    "decision_tree": [{"maxDepth": 5}, {"maxDepth": 8}],
    "random_forest": [{"numTrees": 20, "maxDepth": 5}],
    "boosting": [{"maxIter": 10, "maxDepth": 4}],
}


@dataclass(frozen=True)
class SearchSummary:
    trials: DataFrame
    best_trial: dict
    model: PipelineModel


def larger_is_better(metric: str) -> bool:
    return metric == "r2"


def regress(
    df: DataFrame,
    target_col: str,
    key: str,
    primary_metric: str = "r2",
    timeout_minutes: float | None = None,
    grid: Mapping[str, Sequence[Mapping]] = DEFAULT_GRID,
    parallelism: int = 2,
    seed: int | None = 42,
) -> SearchSummary:
    """Train every candidate on 80% of the keys, measure it on the rest, and keep the best by ``primary_metric``.

    Rows without a label are left out. Numbers, booleans, dates and times become numbers and are filled with their mean;
    a column of another type than these and strings is refused. Strings are hashed to a fixed number of buckets: linear
    models have a weight for each, trees take the buckets in the order of their mean labels. All of that is part of each
    model, so it scores raw rows. After ``timeout_minutes`` no further trial starts; running ones finish, and at least
    one is run. Trees do not depend on the partitioning. Without a seed the rows held out are those of :func:`key_split`
    without one.
    """
    if primary_metric not in METRICS:
        raise ValueError(f"unknown metric {primary_metric!r}")
    inputs = [field for field in df.schema if field.name not in (key, target_col)]
    labelled = df.where(F.col(target_col).isNotNull()).select(
        key, F.col(target_col).cast("double").alias(target_col), *[field.name for field in inputs]
    )
    labelled = labelled.persist(StorageLevel.MEMORY_AND_DISK)
    train, held_out = key_split(labelled, key, 0.2, seed)
    # Preparation is fitted once; its output is what all trials read.
    stages, columns = _preparation(inputs, train, target_col)
    prepared = Pipeline(stages=stages).fit(train)
    train, held_out = (
        prepared.transform(part).select(key, target_col, "features", *columns).persist(StorageLevel.MEMORY_AND_DISK) for part in (train, held_out)
    )
    data = None
    if any(kind in _TREES for kind in grid):
        data = binned(train, columns, target_col, [key], TreeSettings().max_bins).kept()
    unknown = sorted(set(grid) - {"linear", *_TREES})
    if unknown:
        raise ValueError(f"unknown kinds {unknown}")
    candidates = [(kind, dict(params)) for kind, sets in grid.items() for params in sets]
    started = time.monotonic()

    def trial(number: int):
        kind, params = candidates[number]
        if number and timeout_minutes is not None and time.monotonic() - started > timeout_minutes * 60:
            return None
        if kind in _TREES:
            grown, settings = _TREES[kind]
            settings = {"n_estimators": 20, **settings, **{_TREE_PARAMETERS[name]: value for name, value in params.items()}, "random_state": 42 if seed is None else seed}
            fitted = HistogramTrees(kind=grown, inputCols=columns, labelCol=target_col, settings=settings_json(settings)).grown(data)
        else:
            fitted = LinearRegression(featuresCol="features", labelCol=target_col, **params).fit(train)
        measured = evaluate(fitted.transform(held_out), target_col).first()
        return {"trial": number, "kind": kind, "params": params, "metrics": {m: measured[m] for m in METRICS}, "fitted": fitted}

    try:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            target = inheritable_thread_target(df.sparkSession)(trial)
            done = [result for result in pool.map(target, range(len(candidates))) if result is not None]
    finally:
        for frame in (train, held_out, labelled):
            frame.unpersist()
        if data:
            data.release()
    if any(result["metrics"]["mse"] is None for result in done):
        raise ValueError("no rows were held out to measure the trials on")
    sign = -1 if larger_is_better(primary_metric) else 1

    def order(result: dict) -> tuple:
        value = result["metrics"][primary_metric]
        return value is None, sign * (value or 0.0), result["trial"]

    best = min(done, key=order)
    rows = [
        (result["trial"], result["kind"], json.dumps(result["params"], sort_keys=True), metric, value)
        for result in done
        for metric, value in result["metrics"].items()
    ]
    trials = df.sparkSession.createDataFrame(rows, "trial int, kind string, params string, metric string, value double")
    model = PipelineModel(stages=[*prepared.stages, best["fitted"]])
    return SearchSummary(trials, {name: best[name] for name in ("trial", "kind", "params", "metrics")}, model)


def best_trial(trials: DataFrame, metric: str) -> DataFrame:
    """The best row of a trial table, by one metric."""
    order = F.desc_nulls_last("value") if larger_is_better(metric) else F.asc_nulls_last("value")
    return trials.where(F.col("metric") == metric).orderBy(order, "trial").limit(1)


def _as_number(field: T.StructField) -> str | None:
    """SQL that turns a column into a number; None if its type has none."""
    column = "`" + field.name.replace("`", "``") + "`"
    if isinstance(field.dataType, (T.NumericType, T.BooleanType)):
        return f"CAST({column} AS DOUBLE)"
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return f"CAST(unix_micros(CAST({column} AS TIMESTAMP)) AS DOUBLE)"
    return None


def _preparation(inputs: Sequence[T.StructField], train: DataFrame, label: str) -> tuple[list, list[str]]:
    """Stages from raw columns to the vector ``features`` and to the columns that trees take; and these columns."""
    stages: list = []
    vector: list[str] = []
    numbers_of = {f"{field.name}_number": expression for field in inputs if (expression := _as_number(field)) is not None}
    strings = [field.name for field in inputs if isinstance(field.dataType, T.StringType)]
    odd = [field.name for field in inputs if f"{field.name}_number" not in numbers_of and field.name not in strings]
    if odd:
        raise TypeError(f"no way to make model inputs of {odd}")
    if numbers_of:
        vector += [f"{field.name}_filled" for field in inputs if f"{field.name}_number" in numbers_of]
        read = [field.name for field in inputs if f"{field.name}_number" in numbers_of]
        stages += [
            ExpressionColumns(read, numbers_of),
            Imputer(strategy="mean", inputCols=list(numbers_of), outputCols=vector.copy()),
        ]
    columns = vector.copy()
    if strings:
        stages += hashed_categories(strings, "hashed_categories")
        vector.append("hashed_categories")
        stages.append(ExpressionColumns(strings, _ordered_categories(train, strings, label)))
        columns += [f"{name}_rank" for name in strings]
    return [*stages, assembler(vector)], columns


def _ordered_categories(train: DataFrame, strings: Sequence[str], label: str) -> dict[str, str]:
    """For every string column SQL of the rank of its bucket by mean label; buckets without rows come last, null is null.

    As many means per column as there are buckets reach the driver. Sums of decimals do not depend on their order.
    """
    out = {}
    for name in strings:
        bucket = F.expr(bucket_sql(quoted(name), HASHED_FEATURES)).alias("bucket")
        mean = F.avg(F.col(label).cast("decimal(28,8)")).alias("mean")
        rows = train.groupBy(bucket).agg(mean).where("bucket IS NOT NULL").collect()
        ranked = sorted(rows, key=lambda row: (row["mean"], row["bucket"]))
        ranks = [len(ranked)] * HASHED_FEATURES
        for rank, row in enumerate(ranked):
            ranks[row["bucket"]] = rank
        out[f"{name}_rank"] = f"element_at({numbers(ranks)}, CAST({bucket_sql(quoted(name), HASHED_FEATURES)} AS INT) + 1)"
    return out


def cross_validate_linear(
    df: DataFrame,
    target_col: str,
    key: str,
    inputs: Sequence[str],
    folds: int = 5,
    reg_params: Sequence[float] = (0.0, 0.1),
    seed: int | None = None,
) -> DataFrame:
    """``fold``, ``reg_param``, ``n_train``, ``n_test``, ``r2``, ``mse`` and ``rmse`` of a linear model on every fold.

    One pass over the rows gives counts, means and covariances per fold; every model, and its error on the fold left out,
    is worked out from those. So folds and regularisations cost no passes. Rows that lack an input or the label are left
    out. A fold is a share of the keys' hash (without a seed that of :func:`key_split`, for integer keys). The penalty is
    that of Spark's linear regression. A fold without rows to train or test on has null metrics.
    """
    names = [*inputs, target_col]
    values = {f"v{i}": F.col(name).cast("double") for i, name in enumerate(names)}
    fold = key_percentile(key) if seed is None else F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    rows = df.select((fold % folds).cast("int").alias("fold"), *[F.nanvl(column, F.lit(None)).alias(name) for name, column in values.items()])
    rows = rows.where(F.col("fold").isNotNull()).dropna("any")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    moments = rows.groupBy("fold").agg(
        F.count("*").alias("n"),
        *[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(names))],
        *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs],
    )
    parts = {}
    for row in moments.collect():
        cov = np.empty((len(names), len(names)))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
        parts[row["fold"]] = _Moments(row["n"], np.array([row[f"m{i}"] for i in range(len(names))]), cov)
    out = []
    for number in range(folds):
        others = [part for at, part in parts.items() if at != number]
        train, test = _together(others), parts.get(number)
        for reg_param in reg_params:
            measured = (None, None, None)
            if train is not None and test is not None:
                weights, intercept = _ridge(train, reg_param)
                both = np.append(-weights, 1.0)
                # The error's mean and variance on the fold, from the fold's own means and covariances.
                offset = float(both @ test.mean) - intercept
                mse = max(float(both @ test.cov @ both), 0.0) + offset * offset
                r2 = 1 - mse / test.cov[-1, -1] if test.cov[-1, -1] > 0 else None
                measured = (r2, mse, math.sqrt(mse))
            measured = tuple(value if value is None else float(value) for value in measured)
            out.append((number, float(reg_param), train.n if train else 0, test.n if test else 0, *measured))
    schema = "fold int, reg_param double, n_train long, n_test long, r2 double, mse double, rmse double"
    return df.sparkSession.createDataFrame(out, schema)


@dataclass(frozen=True)
class _Moments:
    """Rows, means, and covariances (divided by the rows) of the inputs and, last, the label."""

    n: int
    mean: np.ndarray
    cov: np.ndarray


def _together(parts: Sequence[_Moments]) -> _Moments | None:
    n = sum(part.n for part in parts)
    if not n:
        return None
    mean = sum(part.n * part.mean for part in parts) / n
    cov = sum(part.n * (part.cov + np.outer(part.mean - mean, part.mean - mean)) for part in parts) / n
    return _Moments(n, mean, cov)


def _ridge(moments: _Moments, reg_param: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of least squares; the penalty falls on weights of inputs scaled to unit variance."""
    deviation = np.sqrt(np.diag(moments.cov))
    scale = np.where(deviation > 0, deviation, 1.0)
    correlation = moments.cov / np.outer(scale, scale)
    system = correlation[:-1, :-1] + np.eye(len(scale) - 1) * (reg_param / scale[-1])
    weights = np.linalg.lstsq(system, correlation[:-1, -1], rcond=None)[0] * scale[-1] / scale[:-1]
    weights = np.where(deviation[:-1] > 0, weights, 0.0)
    return weights, float(moments.mean[-1] - weights @ moments.mean[:-1])
