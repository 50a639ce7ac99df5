"""A stored model as a column of any table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.operators.features import model_inputs, require_signature


def with_prediction(
    df: DataFrame,
    model: PipelineModel,
    bind: Mapping[str, str] | None = None,
    into: str = "prediction",
    signature: Sequence[Sequence[str]] = (),
) -> DataFrame:
    """Add the model's prediction as a double column. Inputs are bound by name, never by position; ``bind`` maps a
    model input to the frame's column of another name. ``signature`` has (name, type) of inputs whose types are checked."""
    bind = dict(bind or {})
    bound = df.withColumns({name: F.col(source) for name, source in bind.items()}) if bind else df
    unknown = sorted(set(bind) - model_inputs(model))
    if unknown:
        raise ValueError(f"the model has no inputs {unknown}")
    require_signature(bound, signature)
    scored = model.transform(bound)
    return scored.select(*df.columns, F.col("prediction").cast("double").alias(into))
