"""Joins to a side with unique keys, safe when a few keys hold much of the other side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _comparable(left: T.DataType, right: T.DataType) -> bool:
    """Whether Spark compares the two types by value, without reading one out of the other's text."""
    moments = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return (
        left == right
        or (isinstance(left, T.NumericType) and isinstance(right, T.NumericType))
        or (isinstance(left, moments) and isinstance(right, moments))
        or (isinstance(left, T.StringType) and isinstance(right, T.StringType))
    )


def _equal(spine: Column, left: T.DataType, features: Column, right: T.DataType) -> Column:
    """Equality by value. A whole number and a floating one are compared as decimals, since a double skips whole numbers
    beyond 2^53; a floating key with a fraction, or out of a bigint's range, equals none."""
    whole, floating = T.IntegralType, T.FractionalType
    if isinstance(left, whole) and isinstance(right, floating) and not isinstance(right, T.DecimalType):
        return spine.cast("bigint") == _as_whole(features)
    if isinstance(right, whole) and isinstance(left, floating) and not isinstance(left, T.DecimalType):
        return _as_whole(spine) == features.cast("bigint")
    return spine == features


def _as_whole(column: Column) -> Column:
    number = column.cast("double")
    in_range = (number >= F.lit(-(2.0**63))) & (number < F.lit(2.0**63)) & (number == F.floor(number).cast("double"))
    return F.when(in_range, number).try_cast("bigint")


def lookup(spine: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join: every spine row once, with the features of its key or nulls. Keys are unique in ``features``.

    Keys are compared by value whatever their number types; types that have no common values are refused. The spine's
    columns keep their types. Nothing runs here. A key that holds much of the spine is left to Spark: its rows are on
    the side that the adaptive skew join splits, and the one feature row it meets is copied to each part.
    """
    types = {field.name: field.dataType for field in spine.schema}
    other = {field.name: field.dataType for field in features.schema}
    condition = F.lit(True)
    renamed = {}
    for i, key in enumerate(keys):
        if not _comparable(types[key], other[key]):
            raise TypeError(f"key {key} is {types[key].simpleString()} in the rows and {other[key].simpleString()} in the features")
        renamed[key] = f"_feature_key_{i}"
        equal = _equal(F.col(key), types[key], F.col(renamed[key]), other[key])
        condition = equal if i == 0 else condition & equal
    return spine.join(features.withColumnsRenamed(renamed), condition, "left").drop(*renamed.values())


def lookup_in_place(spine: DataFrame, features: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """:func:`lookup` in a table stored by ``keys`` in ``buckets``: the rows move to the buckets, the features stay put.

    For rows whose keys are spread: all rows of a key meet in its bucket's task. The keys are of the features' types, or
    whole numbers of another width.
    """
    types = {field.name: field.dataType for field in spine.schema}
    other = {field.name: field.dataType for field in features.schema}
    for key in keys:
        both_whole = isinstance(types[key], T.IntegralType) and isinstance(other[key], T.IntegralType)
        if types[key] != other[key] and not both_whole:
            raise TypeError(f"key {key} is {types[key].simpleString()} in the rows and {other[key].simpleString()} in the buckets")
    # A key too large for the features' type is in no bucket; it becomes null, which equals none.
    moved = spine.withColumns({f"_spine_key_{i}": F.col(key).try_cast(other[key]) for i, key in enumerate(keys)})
    moved = moved.repartition(buckets, *[f"_spine_key_{i}" for i in range(len(keys))])
    renamed = {key: f"_feature_key_{i}" for i, key in enumerate(keys)}
    condition = F.lit(True)
    for i in range(len(keys)):
        equal = F.col(f"_spine_key_{i}") == F.col(f"_feature_key_{i}")
        condition = equal if i == 0 else condition & equal
    joined = moved.join(features.withColumnsRenamed(renamed).hint("merge"), condition, "left")
    return joined.drop(*renamed.values(), *[f"_spine_key_{i}" for i in range(len(keys))])
