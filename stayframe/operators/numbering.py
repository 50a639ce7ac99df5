"""Row numbers that do not gather a group in one task, and stable generated keys."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayframe.session import new_workspace


def number_within(df: DataFrame, group: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """``row_number`` per group, from 1, for groups of any size. ``group`` plus ``order`` identify a row; null is a
    group like any other.

    The rows are cut into sorted slices by range, so a large group spans many of them. A row's number is the count of
    its group's rows in earlier slices plus its rank within the slice; only the counts, one per group and slice, are
    added up per group. The slices are written out: cutting them again after a lost executor could cut elsewhere.
    """
    spark = df.sparkSession
    path = new_workspace(spark, "slices")
    sliced = df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id())
    sliced.write.parquet(path)
    sliced = spark.read.schema(sliced.schema).parquet(path)
    keys = [*group, "_slice"]
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    renamed = {key: f"_offset_{i}" for i, key in enumerate(keys)}
    offsets = offsets.drop("_n").withColumnsRenamed(renamed)
    same = reduce(operator.and_, [F.col(key).eqNullSafe(F.col(name)) for key, name in renamed.items()])
    return (
        sliced.join(offsets, same)
        .withColumn(into, F.col("_before") + rank)
        .drop("_slice", "_before", *renamed.values())
    )


def store_with_row_key(df: DataFrame, path: str, into: str = "id") -> DataFrame:
    """Give rows a unique bigint key and store them: the key is fixed by the write, not recomputed by later reads.

    Needs no shuffle and is unique whatever the rows hold, exact copies included.
    """
    keyed = df.withColumn(into, F.monotonically_increasing_id())
    keyed.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(keyed.schema).parquet(path)


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; null keys count as equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
