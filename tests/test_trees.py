"""Histogram trees against trees grown by the definition; models as native columns against their transform."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from stayframe.operators import compiled, models, prepare, search, trees
from stayframe.operators.features import model_inputs
from stayframe.operators.scoring import with_prediction
from stayframe.operators.trees import HistogramTrees, TreeSettings, bin_bounds, binned, considered, drawn

INPUTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [
        (k, rng.choice([None, float("nan"), 1.0, 2.0, 5.0]), float(rng.randrange(100)), rng.randrange(4), rng.choice([0.1, 7.25, -3.5, rng.random() * 1e6]))
        for k in range(400)
    ]
    rows += [(1000, 1.0, 1.0, 1, None), (1001, 1.0, 1.0, 1, float("nan"))]
    return spark.createDataFrame(rows, "id long, a double, b double, c int, y double").repartition(3).persist()


def fit(df, kind="forest", **params):
    estimator = HistogramTrees(kind=kind, inputCols=INPUTS, labelCol="y", keyCols=["id"], settings=trees.settings_json(params))
    return estimator.fit(df)


def grown(ensemble):
    return [[getattr(tree, name).tolist() for name, _ in trees._COLUMNS] for tree in ensemble.trees]


def brute_tree(rows, settings, tree, n_features):
    """Nodes by number: (feature, bin) or a leaf, the drawn rows, and the label's sum; greedy, in exact fractions.

    ``rows`` has (bins, how often drawn, label); gains are compared as fractions, ties go to the first feature and bin.
    """
    nodes, open_nodes = {}, [(1, rows)]
    k = settings.features_per_node(n_features)

    def totals(part):
        return sum(w for _, w, _ in part), sum(w * y for _, w, y in part)

    def split(number, part):
        weight, total = totals(part)
        best = (Fraction(0), None)
        if number.bit_length() - 1 < settings.max_depth and weight >= max(settings.min_samples_split, 2 * settings.min_samples_leaf):
            for feature in considered(tree, np.array([number]), n_features, k, settings.random_state)[0].tolist():
                for cut in sorted({bins[feature] for bins, _, _ in part}):
                    left = [row for row in part if row[0][feature] <= cut]
                    (lw, lt), (rw, rt) = totals(left), totals([row for row in part if row[0][feature] > cut])
                    if min(lw, rw) >= max(1, settings.min_samples_leaf):
                        gain = lt * lt / lw + rt * rt / rw - total * total / weight
                        if gain > best[0]:
                            best = (gain, (feature, cut))
        return best, weight, total

    while open_nodes:
        found = [(*split(number, part), number, part) for number, part in open_nodes]
        if settings.max_leaf_nodes is None:
            (gain, where), weight, total, number, part = found[0]
            open_nodes = open_nodes[1:]
        else:
            # The largest gain of all open nodes comes first.
            at = max(range(len(found)), key=lambda i: (found[i][0][0], -found[i][3]))
            (gain, where), weight, total, number, part = found[at]
            if where is not None and len(open_nodes) + sum(leaf is None for leaf, _, _ in nodes.values()) >= settings.max_leaf_nodes:
                where = None
            open_nodes = open_nodes[:at] + open_nodes[at + 1 :]
        nodes[number] = (where, weight, total)
        if where is not None:
            feature, cut = where
            open_nodes.append((2 * number, [row for row in part if row[0][feature] <= cut]))
            open_nodes.append((2 * number + 1, [row for row in part if row[0][feature] > cut]))
    return nodes


@pytest.mark.parametrize("local_rows", [1, 150, 1 << 16])
@pytest.mark.parametrize(
    "params",
    [
        {"max_depth": 4, "max_features": 0.7, "min_samples_leaf": 3},
        {"max_depth": 9, "min_samples_split": 40, "bootstrap": False, "n_estimators": 1},
        {"max_depth": 8, "max_leaf_nodes": 5, "max_bins": 8},
        {"max_depth": 8, "max_leaf_nodes": 2, "bootstrap": False, "n_estimators": 1},
    ],
)
def test_trees_equal_brute_force(spark, monkeypatch, table, params, local_rows):
    monkeypatch.setattr(trees, "LOCAL_ROWS", local_rows)
    settings = TreeSettings.of({"n_estimators": 2, **params})
    data = binned(table, INPUTS, "y", ["id"], settings.max_bins)
    rows = data.rows.collect()
    assert len(rows) == 400
    keys = np.array([row["key"] for row in rows], dtype=np.int64)
    for i, tree in enumerate(trees.grow_forest(data, settings).trees):
        weights = drawn(keys, i, settings.random_state) if settings.bootstrap else np.ones(len(rows), dtype=int)
        part = [(list(row["bins"]), int(w), Fraction(row["y"])) for row, w in zip(rows, weights, strict=True) if w]
        expected = brute_tree(part, settings.for_rows(len(rows)), i, len(INPUTS))
        got = zip(tree.number.tolist(), tree.feature.tolist(), tree.bin.tolist(), tree.weight.tolist(), tree.total.tolist(), strict=True)
        found = {number: (None if feature < 0 else (feature, cut), weight, total) for number, feature, cut, weight, total in got}
        assert set(found) == set(expected)
        for number, (where, weight, total) in expected.items():
            assert found[number][:2] == (where, weight) and found[number][2] == pytest.approx(float(total), rel=1e-12, abs=1e-6)


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_equal_trees_for_any_partitioning_and_path(monkeypatch, table, kind):
    settings = {"n_estimators": 3, "max_depth": 5, "max_features": 0.7, "min_samples_leaf": 2}
    monkeypatch.setattr(trees, "STORED_EVERY", 2)
    expected = grown(fit(table, kind, **settings).ensemble)
    for local_rows, rows in ((1 << 16, table.repartition(7)), (60, table.repartition(2, "c")), (1, table.coalesce(1))):
        monkeypatch.setattr(trees, "LOCAL_ROWS", local_rows)
        monkeypatch.setattr(trees, "CELLS", 1000)
        assert grown(fit(rows, kind, **settings).ensemble) == expected


def test_boosting_fits_what_is_left(table):
    model = fit(table, "boosting", n_estimators=6, max_depth=3)
    errors = []
    rows = table.where("y = y AND y IS NOT NULL AND y < 1e300")
    data = binned(table, INPUTS, "y", ["id"], 32)
    bins = {row["key"]: np.array(list(row["bins"]))[None, :] for row in data.rows.collect()}
    keyed = rows.select(F.xxhash64("id").alias("key"), "y").collect()
    for n in range(1, 7):
        some = list(zip(model.ensemble.trees, model.ensemble.weights, strict=True))[:n]
        errors.append(sum((row.y - sum(w * tree.value[trees.Router(tree).places(bins[row.key])[0]] for tree, w in some)) ** 2 for row in keyed))
    assert errors == sorted(errors, reverse=True) and model.ensemble.weights == [1.0, *[0.1] * 5]


def test_bins():
    assert bin_bounds(np.array([3.0, 1.0, 2.0, 2.0, np.nan]), 4).tolist() == [1.0, 2.0]
    assert bin_bounds(np.array([np.nan]), 4).tolist() == [] and bin_bounds(np.zeros(0), 4).tolist() == []
    many = bin_bounds(np.arange(1000.0), 10)
    assert len(many) == 9 and np.diff([-1, *many, 999]).tolist() == [100] * 10
    assert bin_bounds(np.array([0.0] * 1000 + list(range(1, 50))), 4).tolist() == [0.0]


def test_a_tree_draws_rows_by_their_key():
    keys = np.arange(200_000, dtype=np.int64) * 7919
    counts = drawn(keys, 3, 42)
    assert abs(counts.mean() - 1) < 0.02 and abs((counts == 0).mean() - np.exp(-1)) < 0.01
    order = np.random.default_rng(1).permutation(len(keys))
    assert (drawn(keys[order], 3, 42) == counts[order]).all() and (drawn(keys, 4, 42) != counts).mean() > 0.5


def test_rows_without_labels_and_empty_tables(spark, table):
    with pytest.raises(ValueError, match="label"):
        fit(table.limit(0))
    with pytest.raises(ValueError, match="label"):
        fit(table.where("id >= 1000"))
    one = fit(table.where("id = 1"), n_estimators=2, bootstrap=False)
    assert one.transform(table).where("prediction IS NULL").count() == 0
    constant = fit(table.withColumn("y", F.lit(0.1)), n_estimators=3)
    assert all(row.prediction == pytest.approx(0.1) for row in constant.transform(table).collect())
    drawn_none = [fit(table.where(f"id = {k}"), n_estimators=1, max_depth=2) for k in range(6)]
    assert all(len(model.ensemble.trees) == 1 and model.ensemble.trees[0].weight[0] > 0 for model in drawn_none)
    assert [len(tree.number) for tree in constant.ensemble.trees] == [1] * 3


def predicted(rows, column):
    return {row.id: row.p for row in rows.select("id", column.alias("p")).collect()}


@pytest.fixture(scope="module")
def compiled_models(table):
    known = table.where("y IS NOT NULL AND NOT isnan(y)").withColumn("kind", F.concat(F.lit("k"), F.col("id") % 9))
    filled = Imputer(inputCols=["a", "b"], outputCols=["a_filled", "b"])
    hashed = prepare.hashed_categories(["kind"], "kinds", 64)
    linear = [filled, *hashed, prepare.assembler(["a_filled", "kinds", "b", "c"]), LinearRegression(featuresCol="features", labelCol="y", regParam=0.1)]
    return known, {
        "linear": Pipeline(stages=linear).fit(known),
        "forest": models.forest(INPUTS, "y", {"n_estimators": 4, "max_depth": 6}).fit(known),
        "boosting": models.boosting(INPUTS, "y", {"n_estimators": 4, "max_depth": 3}).fit(known),
    }


@pytest.mark.parametrize("name", ["linear", "forest", "boosting"])
def test_column_equals_transform(compiled_models, plan, name):
    rows, fitted = compiled_models[0], compiled_models[1][name]
    rows = rows.withColumn("kind", F.when(F.col("id") > 5, F.col("kind")))
    column = compiled.prediction(fitted)
    got = predicted(rows, column)
    assert got == pytest.approx(predicted(fitted.transform(rows), F.col("prediction")), rel=1e-9)
    above = rows.where(column > 1000.0).select("id", column.alias("p"))
    assert {row.id for row in above.collect()} == {key for key, value in got.items() if value > 1000.0}
    text = plan(above)
    assert "UDF" not in text and "Python" not in text and "Arrow" not in text
    with pytest.raises(TypeError, match="no expression"):
        compiled.prediction(PipelineModel(stages=[prepare.category_stages(["kind"])[0][0].fit(rows)]))


def test_trees_walk_as_the_router_does(table, compiled_models):
    ensemble = compiled_models[1]["forest"].stages[-1].ensemble
    rows = table.select("id", *INPUTS).collect()
    got = predicted(compiled_models[1]["forest"].transform(table), F.col("prediction"))
    for row in rows:
        x = [np.nan if row[name] is None else float(row[name]) for name in INPUTS]
        bins = np.array([[np.searchsorted(own, value) for own, value in zip(ensemble.bounds, x, strict=True)]])
        value = sum(w * t.value[trees.Router(t).places(bins)[0]] for t, w in zip(ensemble.trees, ensemble.weights, strict=True))
        assert got[row.id] == pytest.approx(value)


def test_model_as_a_function_in_sql(spark, table, compiled_models):
    compiled.create_function(spark, "forest_price", compiled_models[1]["forest"], {"a": "DOUBLE", "b": "DOUBLE", "c": "INT"})
    table.createOrReplaceTempView("rows_to_price")
    rows = spark.sql("SELECT id, forest_price(a, b, c) AS p, forest_price(b => b, a => 2D, c => 1) AS q FROM rows_to_price")
    expected = predicted(compiled_models[1]["forest"].transform(table), F.col("prediction"))
    other = predicted(compiled_models[1]["forest"].transform(table.withColumns({"a": F.lit(2.0), "c": F.lit(1)})), F.col("prediction"))
    got = {row.id: (row.p, row.q) for row in rows.collect()}
    assert got == {key: (pytest.approx(expected[key]), pytest.approx(other[key])) for key in expected}


def test_stored_trees_are_the_same(table, compiled_models, tmp_path):
    model = compiled_models[1]["boosting"]
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert grown(loaded.stages[-1].ensemble) == grown(model.stages[-1].ensemble) and model_inputs(loaded) == set(INPUTS)
    both = with_prediction(with_prediction(table, model, into="p"), loaded, into="q")
    assert both.where("p <> q OR p IS NULL").count() == 0


def test_search_does_not_follow_the_partitioning(spark):
    rows = spark.range(600).select(
        "id", ((F.col("id") * 37) % 11 + F.col("id") % 3).cast("double").alias("y"), F.concat(F.lit("c"), F.col("id") % 11).alias("category"),
        (F.col("id") % 3).alias("n"),
    )
    grid = {"random_forest": [{"numTrees": 4, "maxDepth": 4}], "boosting": [{"maxIter": 3, "maxDepth": 3}]}
    found = [search.regress(frame, "y", "id", grid=grid) for frame in (rows, rows.repartition(5))]
    values = [{(row.trial, row.metric): row.value for row in summary.trials.collect()} for summary in found]
    assert values[0] == pytest.approx(values[1], rel=1e-12) and found[0].best_trial["metrics"]["r2"] > 0.5
    column = compiled.prediction(found[0].model)
    assert predicted(rows, column) == pytest.approx(predicted(with_prediction(rows, found[0].model), F.col("prediction")))


def test_binning_and_growing_read_the_rows_once(spark, table):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = table.mapInArrow(counted, table.schema)
    model = models.fit_trees({"boosting": models.boosting(INPUTS, "y", {"n_estimators": 3, "max_depth": 2})}, rows, ["id"])["boosting"]
    assert read.value == 402 and len(model.stages[-1].ensemble.trees) == 3


def test_boosting_takes_few_jobs(spark, monkeypatch, table):
    monkeypatch.setattr(trees, "KEPT_EVERY", 2)
    expected = grown(fit(table, "boosting", n_estimators=6, max_depth=3).ensemble)
    data = binned(table, INPUTS, "y", ["id"], 32).kept()
    monkeypatch.setattr(trees, "LOCAL_ROWS", 1)
    spark.sparkContext.setJobGroup("boosting", "")
    found = trees.grow_boosting(data, TreeSettings(n_estimators=6, max_depth=3))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    data.release()
    # A pass for each level, without a shuffle; beside these, what is kept (the rows, and every second tree's rest) is filled.
    assert grown(found) == expected and jobs <= 6 * 3 + 4


def test_rows_are_brought_together_only_where_that_moves_less(table):
    data = binned(table, INPUTS, "y", ["id"], 32)
    opened = {tree: (np.arange(256, 512), np.full(256, 100_000)) for tree in range(100)}
    for depth, moved in ((10, False), (25, True)):
        small = []
        settings = TreeSettings(max_depth=depth, max_features=1)
        waiting = trees._Growth(data, data.blocks(), settings, range(100), "y", True)._apart(opened, small)
        assert (bool(small), bool(waiting)) == (moved, not moved)


def test_draws_follow_the_law_at_every_bound():
    keys = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 300_000)
    salt = trees._mixed(np.array([42], dtype=np.int64).view(np.uint64) ^ trees._mixed(np.array([3], dtype=np.uint64)))
    share = (trees._mixed(keys.view(np.uint64) ^ salt) >> np.uint64(11)).astype(np.float64) / 2.0**53
    assert (drawn(keys, 3, 42) == np.searchsorted(trees._DRAWN, share, side="right")).all()


def test_tracking_rows_are_cleaned_once_for_all_readings(spark, sf_dir, plan):
    from stayframe.queries.models import split_tracking

    for side in split_tracking(spark, sf_dir, 0.25):
        assert "o_orderkey" not in plan(side) and "o_totalprice" not in plan(side)


def test_trees_of_a_search_take_a_job_a_level(spark, monkeypatch):
    monkeypatch.setattr(trees, "LOCAL_ROWS", 1)
    rows = spark.range(500).select("id", ((F.col("id") * 37) % 101).cast("double").alias("y"), (F.col("id") % 97).alias("n"), (F.col("id") % 13).alias("m"))
    jobs = []
    for number in (4, 7):
        spark.sparkContext.setJobGroup(f"search-{number}", "")
        search.regress(rows, "y", "id", grid={"boosting": [{"maxIter": number, "maxDepth": 3}]})
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"search-{number}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Three more trees of three levels, and what is left over kept once.
    assert 9 <= jobs[1] - jobs[0] <= 9 + 2


def test_equal_trees_whoever_adds_up_the_histograms(monkeypatch, table):
    settings = {"n_estimators": 3, "max_depth": 5, "max_features": 0.7}
    expected = grown(fit(table, **settings).ensemble)
    for name, value in {"LOCAL_ROWS": 1, "DRIVER_BYTES": 0, "EXACT_ROWS": 30, "BLOCK_ROWS": 1, "CHUNK_CELLS": 500}.items():
        monkeypatch.setattr(trees, name, value)
    assert grown(fit(table.repartition(20), **settings).ensemble) == expected


def test_many_trees_take_few_passes(monkeypatch, table):
    """Trees that are many enough for all cores are finished at larger nodes; passes over the rows are counted."""
    settings = {"n_estimators": 24, "max_depth": 6, "min_samples_leaf": 2}
    passes, one_pass = [], trees._Growth._pass
    monkeypatch.setattr(trees._Growth, "_pass", lambda self, nodes: passes.append(len(nodes)) or one_pass(self, nodes))
    monkeypatch.setattr(trees, "LOCAL_ROWS", 150)
    few = grown(fit(table, **settings).ensemble)
    assert len(passes) <= 1
    monkeypatch.setattr(trees, "LOCAL_ROWS", 1)
    assert grown(fit(table, **settings).ensemble) == few and len(passes) >= 6


def test_local_growth_in_small_pieces(monkeypatch):
    """Splits are searched for in few cells at a time, and subtrees grown one after the other; the nodes are the same."""
    rng = np.random.default_rng(4)
    n, bins = 3000, 16
    rows = rng.integers(0, bins, (n, 5)).astype(np.uint8)
    labels = trees.Labels(10)
    drawn_rows = (rows, rng.integers(1, 4, n), *labels.split(rng.gamma(2, 300, n) + 40.0 * rows[:, 1]))
    settings = TreeSettings.of({"max_depth": 12, "max_features": 0.6, "min_samples_leaf": 2})
    largest, search_cells = [], trees._best_splits
    monkeypatch.setattr(trees, "_best_splits", lambda sums, *rest: largest.append(sums.size) or search_cells(sums, *rest))

    def nodes():
        tree = trees._tree(trees.grown_from_rows(0, 1, *drawn_rows, bins, labels, settings))
        return [getattr(tree, name).tolist() for name, _ in trees._COLUMNS]

    expected = nodes()
    assert len(expected[0]) > 500 and max(largest) * 3 <= trees.SPLIT_CELLS
    largest.clear()
    monkeypatch.setattr(trees, "SPLIT_CELLS", 3 * 3 * bins * 4)
    monkeypatch.setattr(trees, "CACHED_ROWS", 100)
    assert nodes() == expected and max(largest) <= 4 * 3 * bins


@pytest.mark.parametrize("width", [1, 2, 5])
def test_looked_up_levels_lead_to_the_same_places(width):
    rng = np.random.default_rng(6)
    n, bins = 6000, 32
    rows = rng.integers(0, bins, (n, width)).astype(np.uint8)
    labels = trees.Labels(10)
    ones = np.ones(n, dtype=np.int64)
    parts = trees.grown_from_rows(0, 1, rows, ones, *labels.split(rng.gamma(2, 300, n)), bins, labels, TreeSettings(max_depth=11))
    tree, some = trees._tree(parts), np.flatnonzero(rows[:, 0] % 3)
    for depth in (1, 3, 4, 5, 6, 7, 9, 11):
        router, pairs = trees.Router(tree.without(tree.number[tree.number >= 2**depth])), trees.Pairs(rows, bins)
        assert (router.places_of(pairs) == router.places(rows)).all() and (router.places_of(pairs, some) == router.places(rows, some)).all()
        assert (router.looked_up is not None) == (router.steps >= 4)
