import pytest
from pyspark.sql import functions as F

from stayframe.operators import models
from stayframe.operators.features import (
    FeatureLookup, FeatureStore, KeyViolation, RetiredFeature, SignatureMismatch,
)
from stayframe.sources import storage
from stayframe.sources.snapshots import NoSuchVersion, SnapshotTable

SCHEMA = "id long, a double, b double"


@pytest.fixture()
def store(spark, tmp_path):
    return FeatureStore(spark, str(tmp_path / "store"))


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(i, float(i % 4), float(i % 3)) for i in range(40)], SCHEMA)


def test_duplicate_and_null_keys_are_refused(spark, store):
    for bad in ([(1, 1.0, 1.0), (1, 2.0, 2.0)], [(None, 1.0, 1.0), (2, 1.0, 1.0)]):
        with pytest.raises(KeyViolation):
            store.create_table("t", ["id"], spark.createDataFrame(bad, SCHEMA))
    assert not store.has_table("t")


def test_update_checks_keys_and_leaves_the_old_version(spark, store, rows):
    store.create_table("t", ["id"], rows)
    with pytest.raises(KeyViolation):
        store.write_table("t", rows.unionByName(rows.limit(1)))
    assert store.read_table("t").count() == 40 and store.history("t").count() == 1


def test_description_and_features(store, rows):
    store.create_table("t", ["id"], rows, description="two numbers")
    table = store.get_table("t")
    assert table.features == ["a", "b"] and table.description == "two numbers" and table.primary_keys == ["id"]
    with pytest.raises(ValueError, match="exists"):
        store.create_table("t", ["id"], rows)
    with pytest.raises(LookupError):
        store.get_table("nothing")


def test_retired_columns_are_null_and_old_versions_full(store, rows):
    store.create_table("t", ["id"], rows, at="2024-01-01")
    store.write_table("t", rows.select("id", (F.col("a") + F.col("b")).alias("c")), at="2024-01-02")
    newest = store.read_table("t")
    assert newest.columns == ["id", "a", "b", "c"]
    assert newest.where("a IS NULL AND b IS NULL AND c IS NOT NULL").count() == 40
    assert newest.dropna("any").count() == 0
    assert store.read_table("t", as_of="2024-01-01T12:00:00").columns == ["id", "a", "b"]


def test_register_an_existing_table(spark, store, rows, tmp_path):
    location = str(tmp_path / "elsewhere")
    SnapshotTable(spark, location).write(rows.unionByName(rows))
    with pytest.raises(KeyViolation):
        store.register_table("t", location, ["id"])
    SnapshotTable(spark, location).write(rows)
    assert store.register_table("t", location, ["id"]).features == ["a", "b"]
    store.drop_table("t")
    assert not storage.exists(spark, location)


def test_drop_removes_the_data(spark, store, rows):
    location = store.create_table("t", ["id"], rows).location
    store.drop_table("t")
    assert not storage.exists(spark, location) and store.list_tables() == []


def test_partition_columns_prune_folders(store, rows, plan):
    store.create_table("t", ["id"], rows, partition_columns=["a"])
    read = store.read_table("t").where("a = 2.0")
    assert read.count() == 10 and read.dtypes == [("id", "bigint"), ("a", "double"), ("b", "double")]
    assert "PartitionFilters: [isnotnull(a" in plan(read)


def test_training_set(spark, store, rows):
    store.create_table("t", ["id"], rows)
    store.create_table("u", ["key"], rows.select(F.col("id").alias("key"), (F.col("a") * 10).alias("ten")))
    spine = spark.createDataFrame([(1, 1, 9.0), (99, 2, 8.0)], "id long, other long, y double")
    training = store.create_training_set(
        spine, [FeatureLookup("t", "id", ["a"]), FeatureLookup("u", "other")], "y", exclude_columns=["id", "other"]
    )
    assert training.features == ["a", "ten"]
    assert sorted(map(tuple, training.load_df().collect()), key=str) == [(8.0, None, 20.0), (9.0, 1.0, 10.0)]
    with pytest.raises(ValueError, match="has no"):
        store.create_training_set(spine, [FeatureLookup("t", "id", ["zzz"])], "y")
    with pytest.raises(ValueError, match="twice"):
        store.create_training_set(spine.withColumn("a", F.lit(1)), [FeatureLookup("t", "id")], "y")


@pytest.fixture()
def scored(spark, store, rows):
    store.create_table("t", ["id"], rows, at="2024-01-01")
    spine = rows.select("id", (F.col("id") * 0.1).alias("fresh"), (F.col("a") * 3 + F.col("id")).alias("y"))
    training = store.create_training_set(spine, [FeatureLookup("t", "id")], "y")
    model = models.linear(["a", "fresh"], "y").fit(training.load_df())
    assert store.log_model("m", model, training) == 1
    return store, spine


def test_scoring_looks_up_what_the_model_needs(scored):
    store, spine = scored
    result = store.score_batch("m", 1, spine.drop("y"))
    assert result.columns == ["id", "fresh", "a", "prediction"]
    worst = result.join(spine.select("id", "y"), "id").agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert worst < 1e-6
    assert dict(store.score_batch("m", 1, spine.drop("y"), result_type="float").dtypes)["prediction"] == "float"


def test_scoring_refuses_missing_columns_and_unknown_versions(scored):
    store, spine = scored
    with pytest.raises(SignatureMismatch, match="fresh"):
        store.score_batch("m", 1, spine.select("id"))
    with pytest.raises(NoSuchVersion):
        store.score_batch("m", 2, spine)


def test_scoring_after_a_feature_retired(scored, rows):
    store, spine = scored
    store.write_table("t", rows.select("id", "b"), at="2024-02-01")
    with pytest.raises(RetiredFeature, match="as_of"):
        store.score_batch("m", 1, spine.drop("y"))
    assert store.score_batch("m", 1, spine.drop("y"), as_of="2024-01-15").where("prediction IS NULL").count() == 0


def test_second_version_after_retirement(scored, rows):
    """A model trained without the retired columns scores on the newest table."""
    store, spine = scored
    store.write_table("t", rows.select("id", (F.col("a") + F.col("b")).alias("c")), at="2024-02-01")
    training = store.create_training_set(spine, [FeatureLookup("t", "id")], "y")
    model = models.linear(["c", "fresh"], "y").fit(training.load_df().drop("a", "b"))
    assert store.log_model("m", model, training) == 2
    assert store.score_batch("m", 2, spine.drop("y")).columns == ["id", "fresh", "c", "prediction"]
    lookups = sorted(map(tuple, store.model_lookups("m").collect()))
    assert lookups == [(1, "t", "a", 0), (2, "t", "c", 1)]


def test_model_contract(scored):
    """Types of the input are checked, and signature, example and run go with the model."""
    store, spine = scored
    training = store.create_training_set(spine, [FeatureLookup("t", "id")], "y")
    model = store.load_model("m", 1)
    assert store.log_model("by_run", model, training, run_id="r1") == 1
    assert store.load_run_model("r1").stages[-1].coefficients == model.stages[-1].coefficients
    with pytest.raises(NoSuchVersion):
        store.load_run_model("r2")
    signature = {row.name: (row.type, row.role) for row in store.model_signature("by_run", 1).collect()}
    assert signature["id"] == ("bigint", "input") and signature["y"][1] == "label"
    example = store.model_example("by_run", 1).collect()
    assert [row.id for row in example] == [0, 1, 2] and "y" not in store.model_example("by_run", 1).columns
    fresh = training.spine.drop("y")
    assert store.score_batch("by_run", 1, fresh.withColumn("id", F.col("id").cast("int"))).count() == 40
    with pytest.raises(SignatureMismatch, match="fresh"):
        store.score_batch("by_run", 1, fresh.withColumn("fresh", F.col("fresh").cast("string")))


def test_training_set_is_lazy(spark, store, rows):
    store.create_table("t", ["id"], rows)
    training = store.create_training_set(rows.select("id", F.col("a").alias("y")), [FeatureLookup("t", "id", ["b"])], "y")
    spark.sparkContext.setJobGroup("load_df", "load_df")
    training.load_df()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("load_df")
    spark.sparkContext.setJobGroup("tests", "tests")


def exchanges(text):
    return text.count("Exchange hashpartitioning")


def test_table_by_key_is_joined_and_checked_without_shuffling_it(spark, tmp_path, plan):
    store = FeatureStore(spark, str(tmp_path / "by-key"))
    features = spark.range(500).select("id", (F.col("id") * 2).alias("twice"), F.concat(F.lit("n"), "id").alias("name"))
    tables = {row.name for row in spark.catalog.listTables()}
    store.create_table("t", ["id"], features, buckets=16)
    source = store._snapshots("t").scan_by_key(store._snapshots("t").entry())
    counted = source.groupBy("id").agg(F.count("*").alias("n"))
    assert "Exchange" not in plan(counted) and counted.where("n = 1").count() == 500
    spine = spark.range(600).select(F.col("id").cast("int").alias("id"), F.rand(1).alias("y"))
    training = store.create_training_set(spine, [FeatureLookup("t", "id", in_place=True)], "y").load_df()
    text = plan(training)
    # One exchange, that of the spine; none between the features' scan and the join.
    assert exchanges(text) == 1 and "Bucketed: true" in text
    assert "Exchange" not in text[text.index("Scan parquet") - 400 : text.index("Scan parquet")] or text.index("Exchange") < text.index("Scan parquet")
    plain = store.create_training_set(spine, [FeatureLookup("t", "id")], "y").load_df()
    assert training.columns == plain.columns and training.exceptAll(plain).count() == 0 and training.count() == 600
    with pytest.raises(KeyViolation):
        store.write_table("t", features.union(features.limit(1)))
    with pytest.raises(KeyViolation):
        store.write_table("t", features.withColumn("id", F.when(F.col("id") > 3, F.col("id"))))
    store.write_table("t", features.drop("name").withColumn("half", F.col("id") / 2))
    assert store.get_table("t").buckets == 16 and store.read_table("t").where("name IS NULL AND half IS NOT NULL").count() == 500
    assert {row.name for row in spark.catalog.listTables()} == tables


def test_lookup_in_place_of_odd_keys(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "odd"))
    features = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (2, "x", 3.0)], "k int, l string, f double")
    store.create_table("t", ["k", "l"], features, buckets=8)
    spine = spark.createDataFrame([(1, "x", 0.0), (2**40 + 1, "x", 0.0), (None, "x", 0.0), (2, "z", 0.0), (2, "x", 0.0), (2, "x", 9.0)], "a long, b string, y double")
    found = store.create_training_set(spine, [FeatureLookup("t", ["a", "b"], in_place=True)], "y").load_df().collect()
    assert sorted(((row.a, row.b, row.y, row.f) for row in found), key=str) == sorted(
        [(1, "x", 0.0, 1.0), (2**40 + 1, "x", 0.0, None), (None, "x", 0.0, None), (2, "z", 0.0, None), (2, "x", 0.0, 3.0), (2, "x", 9.0, 3.0)], key=str
    )
    with pytest.raises(TypeError):
        store.create_training_set(spine.withColumn("a", F.col("b")), [FeatureLookup("t", ["a", "b"], in_place=True)], "y").load_df()
    with pytest.raises(ValueError):
        store.create_table("both", ["k"], features, partition_columns=["l"], buckets=4)
    store.create_table("plain", ["k", "l"], features)
    with pytest.raises(ValueError, match="not stored by key"):
        store.create_training_set(spine, [FeatureLookup("plain", ["a", "b"], in_place=True)], "y")


def test_scoring_in_place_and_the_example_of_a_model(spark, tmp_path, plan):
    store = FeatureStore(spark, str(tmp_path / "score"))
    features = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"))
    store.create_table("t", ["id"], features, buckets=16)
    spine = spark.range(200).repartition(5).select("id", (F.col("id") % 7 * 3 + 1).cast("double").alias("y"))
    training = store.create_training_set(spine, [FeatureLookup("t", "id", in_place=True)], "y")
    version = store.log_model("m", models.linear(["x"], "y").fit(training.load_df()), training, run_id="r")
    assert [(row.id, row.x) for row in store.model_example("m", version).orderBy("id").collect()] == [(0, 0.0), (1, 1.0), (2, 2.0)]
    scored = store.score_batch("m", version, spine.drop("y"))
    assert exchanges(plan(scored)) == 1
    assert all(row.prediction == pytest.approx(row.id % 7 * 3 + 1) for row in scored.collect())
    store.log_model("other", models.linear(["x"], "y").fit(training.load_df()), training, run_id="r2")
    assert store.model_meta("other", 1)["label"] == "y" and store.load_run_model("r2").stages[-1].intercept == pytest.approx(1.0)
