import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from stayframe.operators import models, prepare, search
from stayframe.operators.scoring import with_prediction
from stayframe.operators.trees import TreeSettings
from stayframe.plans.cleaning import search_rows, tracking_rows

SMALL_FOREST = {"n_estimators": 10, "max_depth": 5, "max_features": 0.8, "min_samples_leaf": 4, "random_state": 42}


@pytest.fixture(scope="module")
def split(listings):
    return prepare.key_split(tracking_rows(listings), "id", 0.2)


def _inputs(rows):
    return prepare.feature_columns(rows, "price", without=["id"])


def test_mean_fill(spark):
    frame = spark.createDataFrame([(85.0,), (90.5,), (40.0,), (None,)], "x double")
    filled, _ = prepare.mean_fill(frame, ["x"])
    assert sorted(row.x for row in filled.collect())[1] == pytest.approx(71.833333, abs=1e-6)


def test_key_split_does_not_follow_the_partitioning(spark):
    frame = spark.range(2000)
    train, test = prepare.key_split(frame, "id", 0.2)
    again, _ = prepare.key_split(frame.repartition(7), "id", 0.2)
    assert train.exceptAll(again).count() == 0 and train.count() + test.count() == 2000
    assert 300 < test.count() < 500


def test_shares_finer_than_a_percent(spark):
    frame = spark.range(200_000)
    for share in (0.125, 0.004):
        _, test = prepare.key_split(frame, "id", share)
        assert abs(test.count() - 200_000 * share) < 0.05 * 200_000 * share


def test_one_side_can_be_split_again_under_a_seed(spark):
    train, _ = prepare.key_split(spark.range(2000), "id", 0.2)
    inner, held_out = prepare.key_split(train, "id", 0.2, seed=1)
    assert 200 < held_out.count() < 450 and inner.count() + held_out.count() == train.count()
    with pytest.raises(ValueError):
        prepare.key_split(train, "id", 1.0)


def test_vector_of_nulls_fails(spark):
    frame = spark.createDataFrame([(1.0,), (None,)], "x double")
    with pytest.raises(Exception, match="null"):
        prepare.assembler(["x"]).transform(frame).collect()


def test_tree_parameters():
    settings = TreeSettings.of(models.FOREST_V1)
    assert (settings.n_estimators, settings.max_depth, settings.min_samples_leaf, settings.random_state) == (200, 10, 5, 42)
    assert settings.features_per_node(7) == 1
    assert [TreeSettings.of({"max_features": of}).features_per_node(7) for of in (None, 0.8, 1.0, 3, 99)] == [7, 5, 7, 3, 7]
    both = TreeSettings.of({"min_samples_split": 0.25, "max_leaf_nodes": 8}).for_rows(50)
    assert both.min_samples_split == 13 and both.max_leaf_nodes == 8
    for params in ({"depth": 3}, {"max_leaf_nodes": 1}, {"max_depth": 99}, {"max_bins": 1}):
        with pytest.raises(ValueError):
            TreeSettings.of(params)


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_trees_repeat_under_a_seed_and_beat_the_mean(split, kind):
    train, test = split
    build = getattr(models, kind)
    fits = []
    for rows in (train, train.repartition(5)):
        candidate = build(_inputs(train), "price", {**SMALL_FOREST, "n_estimators": 5})
        fits.append(models.fit_trees({"m": candidate}, rows, ["id"])["m"])
    first, second = (
        {row.id: row.prediction for row in fitted.transform(test).select("id", "prediction").collect()} for fitted in fits
    )
    assert first == second
    metrics = {row.split: row.r2 for row in models.evaluate_splits(fits[0], train, test, "price").collect()}
    assert metrics["train"] > 0 and set(metrics) == {"train", "test"}


def test_importances_sum_to_one_and_fall(split):
    train, _ = split
    model = models.forest(_inputs(train), "price", SMALL_FOREST).fit(train)
    rows = models.importances(model).collect()
    assert sum(row.Importance for row in rows) == pytest.approx(1.0)
    assert [row.Importance for row in rows] == sorted((row.Importance for row in rows), reverse=True)
    assert {row.Feature for row in rows} == set(_inputs(train))


def test_stored_model_predicts_the_same(split, tmp_path):
    train, test = split
    model = models.forest(_inputs(train), "price", SMALL_FOREST).fit(train)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    both = with_prediction(with_prediction(test, model, into="p"), loaded, into="q")
    assert both.where("p <> q OR p IS NULL").count() == 0


def test_metrics_equal_the_evaluator(split):
    from pyspark.ml.evaluation import RegressionEvaluator

    train, test = split
    scored = models.linear(["bedrooms"], "price").fit(train).transform(test)
    measured = models.evaluate(scored, "price").first()
    for metric in models.METRICS:
        evaluator = RegressionEvaluator(labelCol="price", metricName=metric)
        assert measured[metric] == pytest.approx(evaluator.evaluate(scored), rel=1e-9)


def test_prediction_is_bound_by_name(spark):
    train = spark.createDataFrame([(1.0, 0.0, 2.0), (2.0, 1.0, 4.0), (3.0, 5.0, 6.0)], "a double, b double, y double")
    model = models.linear(["a", "b"], "y").fit(train)
    turned = train.select("b", F.col("a").alias("other"))
    scored = with_prediction(turned, model, {"a": "other"}, "p")
    assert scored.columns == ["b", "other", "p"]
    assert [row.p for row in scored.orderBy("other").collect()] == pytest.approx([2.0, 4.0, 6.0])
    with pytest.raises(ValueError):
        with_prediction(turned, model, {"c": "other"})


def test_comparison_has_a_row_per_model(split):
    train, test = split
    candidates = {
        name: models.forest(_inputs(train), "price", {**SMALL_FOREST, "max_depth": depth}) for name, depth in (("a", 2), ("b", 6))
    }
    rows = models.compare(models.fit_trees(candidates, train, ["id"]), train, test, "price").orderBy("run").collect()
    assert [row.run for row in rows] == ["a", "b"] and rows[1].train_r2 > rows[0].train_r2


GRID = {"linear": [{"regParam": 0.0}], "decision_tree": [{"maxDepth": 2}, {"maxDepth": 5}]}


def test_search_picks_the_best_and_scores_raw_rows(listings):
    rows = search_rows(listings)
    summary = search.regress(rows, "price", "id", primary_metric="rmse", grid=GRID)
    trials = summary.trials.collect()
    assert len(trials) == 3 * len(models.METRICS)
    best = min((row for row in trials if row.metric == "rmse"), key=lambda row: row.value)
    assert summary.best_trial["trial"] == best.trial == search.best_trial(summary.trials, "rmse").first().trial
    scored = with_prediction(rows, summary.model)
    assert scored.where("prediction IS NULL").count() == 0 and scored.count() == 1500


def test_search_prefers_the_larger_r2(listings):
    summary = search.regress(search_rows(listings), "price", "id", grid=GRID)
    values = {row.trial: row.value for row in summary.trials.where("metric = 'r2'").collect()}
    assert values[summary.best_trial["trial"]] == max(values.values())


def test_search_out_of_time_runs_one_trial(listings):
    summary = search.regress(search_rows(listings), "price", "id", grid=GRID, timeout_minutes=0)
    assert {row.trial for row in summary.trials.collect()} == {0}
    with pytest.raises(ValueError):
        search.regress(search_rows(listings), "price", "id", primary_metric="accuracy")


def test_constant_label_has_no_r2(spark):
    measured = models.evaluate(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, prediction double"), "y").first()
    assert measured.r2 is None and measured.mse == 0.5


def test_search_takes_any_number_of_categories_and_all_usable_types(spark):
    rows = spark.range(2000).select(
        "id", (F.col("id") % 7).cast("double").alias("y"), F.concat(F.lit("c"), "id").alias("category"), (F.col("id") % 7 > 3).alias("flag"),
        F.timestamp_seconds("id").alias("at"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("day"),
    )
    summary = search.regress(rows, "y", "id", grid={"decision_tree": [{"maxDepth": 3}]})
    assert with_prediction(rows, summary.model).where("prediction IS NULL").count() == 0
    assert {row.metric: row.value for row in summary.trials.collect()}["r2"] > 0.5
    with pytest.raises(TypeError):
        search.regress(rows.withColumn("odd", F.array("id")), "y", "id", grid={"linear": [{}]})


def test_a_trial_without_a_value_is_not_the_best(spark):
    trials = spark.createDataFrame([(0, "r2", None), (1, "r2", -3.0)], "trial int, metric string, value double")
    assert search.best_trial(trials, "r2").first().trial == 1
