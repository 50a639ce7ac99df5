"""CSV ranges, exact splits, correlations, distributions, folds from sums, and runs of unknown names."""

import math
import random

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from stayframe.functions.rows import key_percentile
from stayframe.operators import prepare, profile, runlog, search
from stayframe.sources.csvfiles import read_csv, write_csv
from stayframe.sources.splitcsv import _lines, quote_parities, read_split_csv, rows_of_text


@pytest.fixture()
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key in keys:
        spark.conf.unset(key)


def test_split_csv_equals_the_reading_by_one_task(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    texts = [None, "", "plain", 'say "hi"', "a,b", "two\nlines", "\n", '"', '""\n"', "line\n" * 900, "é\n中", "x" * 5000, "\r", "a\r\nb", " "]
    rows = [(k, rng.choice(texts), rng.random()) for k in range(400)]
    path = str(tmp_path / "csv")
    write_csv(spark.createDataFrame(rows, "id long, note string, x double").coalesce(1), path)
    schema = "id long, note string, x double"
    found = read_split_csv(spark, path, schema)
    expected = read_csv(spark, path, schema)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) and found.count() == 400
    ranges = quote_parities(_lines(spark, path)).collect()
    assert len(ranges) > 100 and any(row.quoted for row in ranges) and not all(row.quoted for row in ranges)
    assert rows_of_text(spark, path).select("file", "number").distinct().count() > 20


def test_split_csv_of_odd_files(spark, tmp_path, small_ranges):
    folder = tmp_path / "odd"
    folder.mkdir()
    (folder / "a.csv").write_text('k,v\r\n1,"x\r\ny"\r\n2,z\r\n')
    (folder / "b.csv").write_text("k,v\n")
    (folder / "c.csv").write_text('"k","v"\n\n3,"open\nto the end')
    (folder / "d.csv").write_text("k,v\nnot a number,w\n4,last")
    found = read_split_csv(spark, str(folder), "k long, v string").collect()
    assert sorted(((row.k, row.v) for row in found), key=str) == sorted(
        [(1, "x\r\ny"), (2, "z"), (3, "open\nto the end"), (None, "w"), (4, "last")], key=str
    )
    bad = read_split_csv(spark, str(folder), "k long, v string", corrupt_column="bad").where("bad IS NOT NULL").collect()
    assert [row.bad for row in bad] == ["not a number,w"]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_split_csv(spark, str(folder), "k long, v string", mode="FAILFAST").collect()
    with pytest.raises(ValueError):
        read_split_csv(spark, str(folder), "k long", mode="DROPMALFORMED")


@pytest.mark.parametrize("seed", [None, 7])
@pytest.mark.parametrize("n", [1, 7, 1000, 30_000])
def test_exact_split(spark, n, seed):
    frame = spark.range(n)
    for share in (0.1, 0.25, 0.999):
        train, test = prepare.exact_split(frame, "id", share, seed)
        assert test.count() == math.ceil(round(share * n, 9)) and train.count() + test.count() == n
        _, again = prepare.exact_split(frame.repartition(5), "id", share, seed)
        assert test.exceptAll(again).count() == 0
    hashed = F.xxhash64("id", F.lit(seed)) if seed is not None else None
    if hashed is not None:
        rows = sorted((row.h, row.id) for row in frame.select("id", hashed.alias("h")).collect())
        _, test = prepare.exact_split(frame, "id", 0.3, seed)
        assert {row.id for row in test.collect()} == {key for _, key in rows[: math.ceil(round(0.3 * n, 9))]}


def test_exact_split_of_odd_keys(spark, monkeypatch):
    frame = spark.createDataFrame([(None,), ("a",), ("b",), ("b",)], "k string")
    train, test = prepare.exact_split(frame, "k", 0.5, seed=1)
    assert train.count() + test.count() == 4 and train.join(test, "k", "left_semi").count() == 0
    assert prepare.exact_split(frame.limit(0), "k", 0.5, seed=1)[0].count() == 0
    with pytest.raises(ValueError):
        prepare.exact_split(frame, "k", 1.0)


def test_correlations_and_distributions(spark):
    nan = float("nan")
    rows = [(1, 1.0, 5.0, None), (2, 2.0, nan, 1.0), (3, 3.0, 1.0, 1.0), (4, None, 2.0, 1.0), (5, -9.0, 3.0, 1.0), (5, float("-inf"), 3.0, 1.0)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d double")
    found = {(row.left_column, row.right_column): row for row in profile.correlations(df.where("b IS NULL OR b > -100")).collect()}
    pairs = [(r[0], r[2]) for r in rows[:5] if r[2] is not None and r[2] == r[2]]
    mean = [sum(v) / len(pairs) for v in zip(*pairs)]
    cov = sum((x - mean[0]) * (y - mean[1]) for x, y in pairs)
    spread = [sum((p[i] - mean[i]) ** 2 for p in pairs) for i in (0, 1)]
    assert found["a", "c"].n_rows == 4 and found["a", "c"].correlation == pytest.approx(cov / math.sqrt(spread[0] * spread[1]))
    assert found["c", "d"].correlation is None and len(found) == 6
    bins = {(row.column_name, row.bin): (row.upper, row.n_rows) for row in profile.distributions(df, bins=2).collect()}
    assert bins["a", 1] == (3.0, 3) and bins["a", 2] == (5.0, 3) and bins["d", 1] == (1.0, 5) and ("d", 2) not in bins
    assert bins["b", 1] == (1.0, 3) and bins["b", 2] == (3.0, 2)
    assert profile.distributions(df.limit(0)).count() == 0 and profile.correlations(df.select("a")).count() == 0


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_folds_from_sums_equal_fitting_each(spark):
    rng = random.Random(2)
    rows = [(k, rng.random() * 100 + 1000, rng.gauss(0, 1), 5.0, rng.choice([1.0, 2.0, None]), rng.gauss(0, 3)) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, constant double, c double, noise double").withColumn(
        "y", F.expr("3 * a - 7 * b + noise + coalesce(c, 0)")
    )
    inputs = ["a", "b", "constant", "c"]
    frame, jobs = jobs_of(spark, "folds", lambda: search.cross_validate_linear(df, "y", "id", inputs, folds=4, reg_params=(0.0, 0.5)))
    found = {(row.fold, row.reg_param): row for row in frame.collect()}
    assert jobs <= 2 and len(found) == 8
    usable = VectorAssembler(inputCols=inputs, outputCol="features").transform(df.dropna("any")).withColumn("fold", key_percentile("id") % 4).persist()
    for (fold, reg_param), row in found.items():
        train, test = usable.where(f"fold <> {fold}"), usable.where(f"fold = {fold}")
        scored = LinearRegression(labelCol="y", regParam=reg_param, solver="normal").fit(train).transform(test)
        assert (row.n_train, row.n_test) == (train.count(), test.count())
        for metric in ("r2", "mse", "rmse"):
            assert row[metric] == pytest.approx(RegressionEvaluator(labelCol="y", metricName=metric).evaluate(scored), rel=1e-6)
    nothing = search.cross_validate_linear(df.limit(0), "y", "id", inputs, folds=2).collect()
    assert all(row.mse is None and row.n_test == 0 for row in nothing) and len(nothing) == 4


def test_runs_show_names_that_nobody_listed(spark, plan):
    rows = [
        (1, "r1", "rmse", 2.0, None, "2024-01-02", 2), (1, "r1", "rmse", 5.0, None, "2024-01-01", 1), (1, "r1", "odd name", 7.0, None, "2024-01-01", 3),
        (1, "r1", "depth", None, "5", "2024-01-01", 4), (2, "r2", "rmse", None, None, "2024-01-03", 5),
    ]
    log = spark.createDataFrame(rows, "experiment_id int, run_id string, metric string, value double, text string, ts string, event_id long")
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    found = {row.run_id: row for row in runlog.open_runs(log).collect()}
    assert found["r1"].metrics == {"rmse": 2.0, "odd name": 7.0} and found["r1"].params == {"depth": "5"}
    assert found["r2"].metrics == {} and found["r2"].params == {}
    assert str(found["r1"].start_time).startswith("2024-01-01")
