from pyspark.sql import functions as F

from stayframe.functions.money import money, percent
from stayframe.functions.rows import key_noise, key_percentile, key_position, row_mean, row_sum, seeded_noise


def _column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in frame.orderBy("i").select(expression).collect()]


PRICES = ["$85.00", "$1,200.00", None, "abc", ""]


def test_strict_money_loses_the_comma(spark):
    assert _column(spark, PRICES, money("v")) == [85.0, None, None, None, None]


def test_money_with_thousands(spark):
    assert _column(spark, PRICES, money("v", "thousands")) == [85.0, 1200.0, None, None, None]


def test_percent(spark):
    assert _column(spark, ["97%", "100%", "N/A", None], percent("v")) == [0.97, 1.0, None, None]


def test_row_sum_and_mean_are_null_with_one_null(spark):
    frame = spark.createDataFrame([(1.0, 2.0, 4.5), (1.0, None, 2.0)], "a double, b double, c double")
    rows = frame.select(row_sum(["a", "b", "c"]).alias("s"), row_mean(["a", "b", "c"]).alias("m")).collect()
    assert [tuple(row) for row in rows] == [(7.5, 2.5), (None, None)]


def test_filter_drops_null_and_dropna_drops_nan(spark):
    nights = spark.createDataFrame([(13,), (14,), (None,)], "minimum_nights int")
    assert [row[0] for row in nights.where("minimum_nights < 14").collect()] == [13]
    assert spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double").dropna("any").count() == 1


def test_key_percentile_of_large_and_negative_keys(spark):
    keys = [0, 1, 2**31, 2**31 + 1, 2**62, -1, -(2**62), None]
    values = _column(spark, keys, key_percentile("v"), "long")
    assert values[0] == values[2] and values[1] == values[3]
    assert all(0 <= value < 100 for value in values[:-1]) and values[-1] is None


def test_noise_stays_in_range_and_follows_the_key(spark):
    keys = spark.range(0, 5000)
    limits = keys.select(key_noise("id").alias("x"), seeded_noise(7).alias("y"))
    low_x, high_x, low_y, high_y = limits.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert -0.25 <= low_x < high_x < 0.25 and -0.25 <= low_y < high_y < 0.25
    twice = keys.repartition(3).select("id", key_noise("id").alias("x")).exceptAll(keys.select("id", key_noise("id")))
    assert twice.count() == 0


def test_key_noise_of_large_and_negative_keys(spark):
    keys = spark.createDataFrame([(-7,), (2**51,), (2**63 - 1,), (-(2**63),), (5,)], "id long")
    values = [row.x for row in keys.select(key_noise("id").alias("x")).collect()]
    assert all(-0.25 <= value < 0.25 for value in values) and values[-1] == 5 * 7919 % 1000 / 2000 - 0.25


def test_positions_refine_percentiles(spark):
    rows = spark.range(5000).select(key_percentile("id").alias("p"), key_position("id").alias("q")).collect()
    assert all(row.q // 10_000 == row.p for row in rows) and len({row.q for row in rows}) > 4500
