import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stayframe.operators import prepare, profile
from stayframe.operators.joins import lookup
from stayframe.operators.numbering import duplicated_keys, number_within, store_with_row_key
from stayframe.plans import cleaning
from stayframe.sources.listings import load_listings, table


def test_lookup_keeps_spine_rows_without_features(spark):
    spine = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "id long, x string")
    features = spark.createDataFrame([(1, 0.5), (3, 0.7)], "id int, f double")
    rows = {tuple(row) for row in lookup(spine, features, ["id"]).collect()}
    assert rows == {(1, "a", 0.5), (1, "d", 0.5), (2, "b", None), (None, "c", None)}


def _skewed(spark, n):
    """A third of the rows under one key, a sixth without key, exact copies among them."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 6 == 1, F.lit(None)).otherwise(F.col("id") % 1000 + 100)
    return spark.range(n).select(key.alias("k"), (F.col("id") % 11).alias("x"))


def test_a_hot_key_is_read_by_several_tasks(spark, plan, tmp_path):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    _skewed(spark, 60_000).write.parquet(str(tmp_path / "spine"))
    spine = spark.read.parquet(str(tmp_path / "spine")).repartition(8)
    features = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("f"))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = lookup(spine, features, ["k"])
        expected = spine.join(features, "k", "left").select("k", "x", "f")
        assert joined.exceptAll(expected).count() == 0 and joined.count() == 60_000
        joined.collect()
        text = plan(joined)
        assert "SortMergeJoin(skew=true)" in text or "isSkew" in text or "skewed" in text
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_lookup_compares_keys_by_value(spark):
    def found(spine_type, spine_keys, feature_type, feature_keys):
        spine = spark.createDataFrame([(key,) for key in spine_keys], f"k {spine_type}")
        features = spark.createDataFrame([(key, i) for i, key in enumerate(feature_keys)], f"k {feature_type}, f int")
        joined = lookup(spine, features, ["k"])
        assert joined.schema["k"].dataType == spine.schema["k"].dataType and joined.columns == ["k", "f"]
        return sorted(joined.collect(), key=str)

    assert [tuple(r) for r in found("int", [1, 2], "double", [1.0, 1.5])] == [(1, 0), (2, None)]
    assert [tuple(r) for r in found("int", [7], "bigint", [2**40, 7])] == [(7, 1)]
    assert [tuple(r) for r in found("bigint", [2**53 + 1], "double", [float(2**53), 1e300, float("nan")])] == [(2**53 + 1, None)]
    assert [tuple(r) for r in found("double", [2.0, 2.5, float("inf")], "bigint", [2, 3])] == [(2.0, 0), (2.5, None), (float("inf"), None)]
    assert [tuple(r) for r in found("string", ["1"], "string", ["1"])] == [("1", 0)]
    for types in (("int", "string"), ("string", "double"), ("date", "int")):
        spine, features = (spark.createDataFrame([], f"k {kind}") for kind in types)
        with pytest.raises(TypeError):
            lookup(spine, features, ["k"])


def test_lookup_runs_no_job(spark, sf_dir):
    spine = load_listings(spark, sf_dir)
    spark.sparkContext.setJobGroup("lookup", "lookup")
    lookup(spine, spine.select("id", F.col("price").alias("p")), ["id"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lookup")
    spark.sparkContext.setJobGroup("tests", "tests")


def test_lookup_on_two_keys(spark):
    spine = spark.createDataFrame([(1, "a"), (1, "b")], "m long, s string")
    features = spark.createDataFrame([(1, "a", 9)], "m long, s string, f int")
    assert sorted(map(tuple, lookup(spine, features, ["m", "s"]).collect()), key=str) == [(1, "a", 9), (1, "b", None)]


def test_numbers_equal_a_window_also_for_a_group_in_many_slices(spark):
    rows = spark.range(0, 20_000, 1, 7).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50 + 2).alias("g"), (F.hash("id") % 97).alias("t"), "id"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        numbered = number_within(rows, ["g"], ["t", "id"], "n")
        rows.createOrReplaceTempView("rows_to_number")
        expected = spark.sql("SELECT g, t, id, row_number() OVER (PARTITION BY g ORDER BY t, id) AS n FROM rows_to_number")
        numbered = numbered.select("g", "t", "id", F.col("n").cast("int").alias("n"))
        assert numbered.count() == 20_000
        assert numbered.exceptAll(expected).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_null_is_a_group_of_numbered_rows(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (5, 1)], "g int, t int")
    assert sorted(map(tuple, number_within(rows, ["g"], ["t"], "n").collect()), key=str) == [(5, 1, 1), (None, 1, 1), (None, 2, 2)]


def test_row_keys_are_unique_and_stored(spark, tmp_path):
    copies = spark.createDataFrame([("same",)] * 500 + [("other",)], "x string").repartition(5)
    stored = store_with_row_key(copies, str(tmp_path / "keyed"))
    assert duplicated_keys(stored, ["id"]).count() == 0 and stored.count() == 501
    assert stored.exceptAll(stored.repartition(2)).count() == 0


@pytest.mark.parametrize(
    ("values", "p"),
    [
        ([3.0], 0.5), ([1.0, 2.0], 0.5), ([5.0, 1.0, 1.0, 9.0], 0.25), (list(range(101)), 0.75), ([0.0, -1.5e308, 1.5e308], 0.5),
        ([1e-300, 1e300, 1e-5, 2e-5, 5.0], 0.4), ([2.5] * 7, 0.9), ([1.0, 2.0, 3.0], 1.0),
    ],
)
def test_quantiles_are_exact(spark, values, p):
    frame = spark.createDataFrame([(float(v),) for v in [*values]] + [(None,), (float("nan"),)], "x double")
    ordered = sorted(map(float, values))
    rank = max(1, -(-len(ordered) * round(p * 100) // 100))
    assert profile.quantiles(frame, ["x"], {"q": p}).first().x == ordered[rank - 1]


def test_quantiles_of_skewed_and_empty_columns(spark):
    frame = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pow(F.lit(1.001), F.col("id") % 10_000)).alias("a"),
        F.lit(None).cast("int").alias("b"),
        F.col("id").alias("c"),
    )
    found = {row.label: row for row in profile.quantiles(frame, ["a", "b", "c"]).collect()}
    assert found["median"].b is None and found["median"].c == 14_999
    values = sorted(row.a for row in frame.select("a").collect())
    assert found["median"].a == statistics.median_low(values) and found["q25"].a == values[7_499]


def test_quantiles_keep_types_and_infinities(spark):
    big = 2**53
    rows = [(big + 1, Decimal("12345678901234567890.1"), float("inf"), 1.5), (big + 2, Decimal("0.1"), float("-inf"), float("nan")),
            (big, Decimal("-3.0"), 1.0, 2.5), (-(2**63), None, float("inf"), None), (2**63 - 1, Decimal("0.2"), 2.0, 7.5)]
    frame = spark.createDataFrame(rows, "b long, d decimal(30,1), x double, y double")
    found = {row.label: row for row in profile.quantiles(frame, ["b", "d", "x", "y"], {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()}
    assert [found[k].b for k in ("lo", "mid", "hi")] == [-(2**63), big + 1, 2**63 - 1]
    assert [found[k].d for k in ("lo", "mid", "hi")] == [Decimal("-3.0"), Decimal("0.1"), Decimal("12345678901234567890.1")]
    assert [found[k].x for k in ("lo", "mid", "hi")] == [float("-inf"), 2.0, float("inf")]
    assert [found[k].y for k in ("lo", "mid", "hi")] == [1.5, 2.5, 7.5]
    described = {row.column_name: row for row in profile.summary(frame).collect()}
    assert described["y"]["count"] == 3 and described["y"]["mean"] == pytest.approx(23 / 6) and described["y"]["median"] == 2.5


def test_summary_reads_its_rows_twice(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id % 77 AS a", "double(id % 1001) / 7 AS b").write.parquet(str(tmp_path / "rows"))
    frame = spark.read.parquet(str(tmp_path / "rows"))
    scans = spark.sparkContext.accumulator(0)

    def counting(batches):
        scans.add(1)
        yield from batches

    counted = frame.coalesce(1).mapInArrow(counting, frame.schema)
    rows = {row.column_name: row for row in profile.summary(counted).collect()}
    assert scans.value == 2 and rows["id"]["median"] == 2499.0 and rows["a"]["max"] == 76.0


def test_profile_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a int, `b c` string")
    rows = {row.column_name: row for row in profile.profile(empty).collect()}
    assert rows["a"].n_rows == 0 and rows["b c"].n_null == 0 and rows["a"].median is None


def test_top_values_keep_few_rows_per_task(spark, listings, plan):
    text = plan(profile.top_values(listings, ["price", "bedrooms"], 3))
    assert text.count("WindowGroupLimit") == 2


def test_etl_runs_without_a_shuffle_and_reads_three_columns(spark, listings, plan):
    text = plan(cleaning.etl_rows(listings))
    assert "Exchange" not in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text


def test_means_take_one_pass(spark, listings, plan):
    text = plan(profile.mean_by_value(cleaning.etl_rows(listings), "bedrooms", "price", [2, 3]))
    assert text.count("Scan parquet") == 1 and text.count("Exchange") == 1


def test_first_rows_is_a_top_n(spark, sf_dir, plan):
    assert "TakeOrderedAndProject" in plan(load_listings(spark, sf_dir).orderBy("id").limit(5))


def test_derived_listings_count(spark, sf_dir, listings):
    assert listings.count() == table(spark, sf_dir, "orders").count() == 1500


def test_codes_of_many_categories(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",), ("b",), (None,), ("a",), ("",)], "x string")
    codes = prepare.category_codes(rows.repartition(3), "x")
    assert {row.x: (row.code, row.n_rows) for row in codes.collect()} == {"a": (0, 2), "b": (1, 2), "": (2, 1), "c": (3, 1)}
    coded = prepare.with_codes(spark.createDataFrame([("a",), (None,), ("new",)], "x string"), codes, "x", "code")
    assert {row.x: row.code for row in coded.collect()} == {"a": 0, None: None, "new": None}
    assert prepare.category_codes(rows.limit(0), "x").count() == 0
    many = spark.range(50_000).select(F.concat(F.lit("v"), F.col("id") % 20_000).alias("x"))
    found = prepare.category_codes(many, "x")
    assert found.agg(F.min("code"), F.max("code"), F.countDistinct("code")).first()[:] == (0, 19_999, 20_000)
