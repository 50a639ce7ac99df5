"""A fitted pipeline as one native expression, for ``select``, ``where`` and SQL: no transform, no Python worker.

Every stage turns the expressions of its inputs into those of its outputs. Linear models become a sum of products. Trees
become one walk over arrays, whose text grows with the trees but whose number of expressions does not.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import FeatureHasher, ImputerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegressionModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayframe.operators.trees import HistogramTreesModel


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    if math.isnan(value) or math.isinf(value):
        return f"CAST('{value}' AS DOUBLE)"
    return f"({value!r}D)"


def numbers(values: Sequence[float]) -> str:
    """An array of doubles; as text that is read once, since long lists of literals are slow to analyse."""
    return f"from_json({text(json.dumps(list(map(float, values))))}, 'array<double>')"


class ExpressionColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds columns given as SQL over the columns of the frame."""

    inputCols = Param(Params._dummy(), "inputCols", "columns that the expressions read", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "names of the added columns", TypeConverters.toListString)
    expressions = Param(Params._dummy(), "expressions", "their SQL", TypeConverters.toListString)

    def __init__(self, inputs: Sequence[str] = (), added: Mapping[str, str] | None = None):
        super().__init__()
        self._set(inputCols=list(inputs), outputCols=list(added or {}), expressions=list((added or {}).values()))

    def getInputCols(self) -> list[str]:
        return self.getOrDefault(self.inputCols)

    def added(self) -> dict[str, str]:
        return dict(zip(self.getOrDefault(self.outputCols), self.getOrDefault(self.expressions), strict=True))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({name: F.expr(expression) for name, expression in self.added().items()})


def bucket_sql(column: str, width: int) -> str:
    """The bucket of a string, from 0; null for null."""
    return f"CASE WHEN {column} IS NOT NULL THEN pmod(xxhash64({column}), {width}) END"


def trees_sql(model: HistogramTreesModel, inputs: Sequence[str] | None = None) -> str:
    """The prediction of a tree model. ``inputs`` are the expressions of its features, in their order."""
    ensemble = model.ensemble
    inputs = inputs or [quoted(name) for name in model.getInputCols()]
    depth = max(int(tree.number[-1]).bit_length() - 1 for tree in ensemble.trees)
    trees = [
        {
            "f": tree.feature.tolist(),
            "l": tree.left.tolist(),
            "x": np.where(tree.feature >= 0, ensemble.thresholds(tree), tree.value).tolist(),
            "w": weight,
        }
        for tree, weight in zip(ensemble.trees, ensemble.weights, strict=True)
    ]
    stored = text(json.dumps(trees, separators=(",", ":")))
    row = ", ".join(f"CAST({expression} AS DOUBLE)" for expression in inputs)
    # A null feature is not at most the threshold, so it goes right, as NaN does.
    step = "IF(_tree.f[_at] < 0, _at, IF(_row[_tree.f[_at]] <= _tree.x[_at], _tree.l[_at], _tree.l[_at] + 1))"
    leaf = f"aggregate(sequence(1, {depth}), 0, (_at, _step) -> {step})" if depth else "0"
    return f"""element_at(transform(array(array({row})), _row -> aggregate(
        from_json({stored}, 'array<struct<f:array<int>,l:array<int>,x:array<double>,w:double>>'), 0D,
        (_total, _tree) -> _total + _tree.w * _tree.x[{leaf}])), 1)"""


class _Compiler:
    """Expressions of the columns that stages have added so far; all others are the frame's own."""

    def __init__(self, bind: Mapping[str, str]):
        self.columns = {name: expression for name, expression in bind.items()}
        self.vectors: dict[str, list[tuple[str, str | None]]] = {}

    def column(self, name: str) -> str:
        return self.columns.get(name, quoted(name))

    def add(self, stage) -> None:
        if isinstance(stage, ExpressionColumns):
            if set(stage.getInputCols()) & set(self.columns):
                # The expressions are text over plain names: hand them these names.
                bound = ", ".join(f"{text(name)}, {self.column(name)}" for name in stage.getInputCols())
                raise TypeError(f"expressions over computed columns cannot be compiled: {bound}")
            self.columns |= {name: f"({expression})" for name, expression in stage.added().items()}
        elif isinstance(stage, ImputerModel):
            means = stage.surrogateDF.first()
            filled = {}
            for name, out in zip(stage.getInputCols(), stage.getOutputCols(), strict=True):
                filled[out] = f"coalesce(nanvl(CAST({self.column(name)} AS DOUBLE), NULL), {number(means[name])})"
            self.columns |= filled
        elif isinstance(stage, VectorAssembler):
            parts = []
            for name in stage.getInputCols():
                parts += self.vectors.get(name, [(self.column(name), None)])
            self.vectors[stage.getOutputCol()] = parts
        elif isinstance(stage, FeatureHasher):
            self.vectors[stage.getOutputCol()] = self._hashed(stage)
        elif isinstance(stage, LinearRegressionModel):
            self.columns[stage.getPredictionCol()] = self._linear(stage)
        elif isinstance(stage, HistogramTreesModel):
            self.columns[stage.getPredictionCol()] = trees_sql(stage, [self.column(name) for name in stage.getInputCols()])
        else:
            raise TypeError(f"no expression for {type(stage).__name__}")

    def _hashed(self, stage: FeatureHasher) -> list[tuple[str, str | None]]:
        """One part for the whole vector: the buckets' columns, and per column which place each bucket has."""
        width = stage.getNumFeatures()
        spark = SparkSession.active()
        places = {}
        for name in stage.getInputCols():
            # The hasher's own answer for each of the bucket values, of which there are as many as the vector is wide.
            others = [F.lit(None).cast("string").alias(other) for other in stage.getInputCols() if other != name]
            values = spark.range(width).select(F.col("id").alias("bucket"), F.col("id").cast("string").alias(name), *others)
            rows = stage.transform(values).select("bucket", stage.getOutputCol()).collect()
            place = [0] * width
            for row in rows:
                place[row["bucket"]] = int(row[stage.getOutputCol()].indices[0])
            places[name] = place
        return [(json.dumps([[self.column(name), place] for name, place in places.items()]), str(width))]

    def _linear(self, stage: LinearRegressionModel) -> str:
        weights = stage.coefficients.toArray().tolist()
        terms, at = [], 0
        for expression, width in self.vectors[stage.getFeaturesCol()]:
            if width is None:
                terms.append(f"{number(weights[at])} * CAST({expression} AS DOUBLE)")
                at += 1
                continue
            own = weights[at : at + int(width)]
            for column, place in json.loads(expression):
                by_bucket = numbers([own[p] for p in place])
                terms.append(f"coalesce(element_at({by_bucket}, CAST({column} AS INT) + 1), 0D)")
            at += int(width)
        return " + ".join([*terms, number(stage.intercept)])


def prediction_sql(model: PipelineModel, bind: Mapping[str, str] | None = None) -> str:
    """SQL of the model's prediction. ``bind`` gives expressions for inputs that are not columns of the same name."""
    compiler = _Compiler(bind or {})
    for stage in model.stages:
        compiler.add(stage)
    return f"({compiler.column(model.stages[-1].getPredictionCol())})"


def prediction(model: PipelineModel, bind: Mapping[str, str] | None = None) -> Column:
    """The model as a column function: a double, wherever a column may stand.

    Nulls: a linear model gives null for a null input that no stage fills; trees send it right. Pipelines of number and
    category columns are covered (fill, hashing, assembling, linear models, histogram trees); other stages are refused.
    """
    return F.expr(prediction_sql(model, bind))


def create_function(spark: SparkSession, name: str, model: PipelineModel, inputs: Mapping[str, str]) -> None:
    """Make the model a temporary SQL function ``name`` of the ``inputs``, given as column names and types."""
    arguments = ", ".join(f"{quoted(column)} {kind}" for column, kind in inputs.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {quoted(name)}({arguments}) RETURNS DOUBLE RETURN {prediction_sql(model)}")
