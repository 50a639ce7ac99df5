"""Profiles merged from stored states against the rows."""

import pytest
from pyspark.sql import functions as F

from stayframe.operators.sketches import RANK_ERROR, ProfiledTable
from stayframe.sources.snapshots import SnapshotTable


def test_states_merge_within_bounds_and_read_no_rows(spark, tmp_path, plan):
    table = ProfiledTable(SnapshotTable(spark, str(tmp_path / "t")))
    assert table.profile().count() == 0
    rows = spark.range(30_000).select(
        "id", (F.col("id") * 7919 % 10_007).cast("double").alias("x"), F.concat(F.lit("v"), F.col("id") % 5000).alias("s"),
        F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).otherwise(1.0).alias("odd"),
    )
    parts = [rows.where(f"id < {low + 10_000} AND id >= {low}") for low in (0, 10_000, 20_000)]
    assert [table.write(part) for part in parts] == [0, 1, 2]
    found = table.profile()
    text = plan(found)
    # One scan, and that of the states.
    assert text.count("FileScan parquet") == 1 and "rank_state" in text
    by_name = {row.column_name: row for row in found.collect()}
    assert [row.column_name for row in found.orderBy("position").collect()] == ["id", "x", "s", "odd"]
    for name, exact in (("id", 30_000), ("x", 10_007), ("s", 5000), ("odd", 1)):
        row = by_name[name]
        assert row.n_rows == 30_000 and abs(row.distinct_estimate - exact) <= max(1, 4 * row.distinct_error * exact)
    assert by_name["odd"].n_null == 3000 and by_name["odd"].mean == 1.0 and by_name["s"].median is None and by_name["s"].mean is None
    assert by_name["x"].min == 0.0 and by_name["x"].max == 10_006.0
    values = sorted(row.x for row in rows.select("x").collect())
    for name, share in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        rank = sum(value <= by_name["x"][name] for value in values) / len(values)
        assert abs(rank - share) <= 2 * RANK_ERROR
    one = {row.column_name: row for row in table.profile([1]).collect()}
    assert one["id"].n_rows == 10_000 and (one["id"].min, one["id"].max) == (10_000.0, 19_999.0)


def test_columns_of_some_versions_and_empty_ones(spark, tmp_path):
    table = ProfiledTable(SnapshotTable(spark, str(tmp_path / "t")))
    table.write(spark.createDataFrame([(1, None), (2, None)], "a int, b double"))
    table.write(spark.createDataFrame([], "a int, b double"))
    table.write(spark.createDataFrame([(3.5, "x")], "b double, c string"))
    found = {row.column_name: row for row in table.profile().collect()}
    assert (found["a"].n_rows, found["a"].n_null, found["a"].median) == (2, 0, 1.0) or found["a"].median == 2.0
    assert (found["b"].n_rows, found["b"].n_null, found["b"].mean, found["b"].median) == (3, 2, 3.5, 3.5)
    assert (found["c"].n_rows, found["c"].distinct_estimate, found["c"].min) == (1, 1, None)
    empty = {row.column_name: row for row in table.profile([1]).collect()}
    assert (empty["b"].n_rows, empty["b"].mean, empty["b"].median, empty["b"].distinct_estimate) == (0, None, None, 0)
