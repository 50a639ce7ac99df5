"""Training, evaluation, scoring and model search."""

import json

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayframe.operators import compiled, models, prepare, profile, search
from stayframe.operators.features import FeatureLookup
from stayframe.operators.scoring import with_prediction
from stayframe.plans.cleaning import SEARCH_COLUMNS, feature_rows, linear_rows, search_rows, tracking_rows
from stayframe.queries import features as tables
from stayframe.queries.aggregates import profile_sql
from stayframe.queries.oracle import BUCKET, over
from stayframe.queries.registry import query, rounded
from stayframe.session import written
from stayframe.sources.listings import LISTINGS_SCHEMA, load_listings


def split_linear(spark, sf_dir):
    filled, _ = prepare.mean_fill(linear_rows(load_listings(spark, sf_dir)), ["bedrooms", "price"])
    return prepare.key_split(filled, "id", 0.2)


def fitted_linear(spark, sf_dir):
    train, test = split_linear(spark, sf_dir)
    return models.linear(["bedrooms"], "price").fit(train), train, test


@query(
    "h1_linear_regression",
    over("coefficients", "SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM coefficients"),
)
def h1_linear_regression(spark, sf_dir):
    model, _, _ = fitted_linear(spark, sf_dir)
    line = model.stages[-1]
    values = [(float(line.coefficients[0]), float(line.intercept), float(line.summary.r2))]
    return rounded(spark.createDataFrame(values, "slope double, intercept double, r2 double"), ["slope", "intercept", "r2"])


def split_tracking(spark, sf_dir, share):
    # Written once: training, scoring and judging are several readings.
    return prepare.key_split(written(tracking_rows(load_listings(spark, sf_dir)), "tracking"), "id", share)


def _inputs(rows):
    return prepare.feature_columns(rows, "price", without=["id"])


def _held_out(view: str, below: int) -> str:
    """Every held-out row, its prediction within the training labels, and the model better than their mean."""
    return f"""SELECT id, price, true AS within_labels, true AS better_than_mean FROM {view} WHERE {BUCKET} >= {below}"""


def _judged(scored, train):
    """Tree predictions have no closed form; what must hold of them does. They are averages of training labels, and have
    less squared error on the training rows' like than the mean label has."""
    # Written once: the errors and the rows are two readings.
    scored = written(scored, "scored")
    labels = train.agg(F.min("price").alias("lowest"), F.max("price").alias("highest"), F.avg("price").alias("mean"))
    errors = scored.crossJoin(F.broadcast(labels)).agg(
        (F.avg((F.col("price") - F.col("prediction")) ** 2) < F.avg((F.col("price") - F.col("mean")) ** 2)).alias("better_than_mean")
    )
    within = (F.col("prediction") >= F.col("lowest") - 1e-6) & (F.col("prediction") <= F.col("highest") + 1e-6)
    rows = scored.crossJoin(F.broadcast(labels)).crossJoin(F.broadcast(errors))
    return rows.select("id", "price", within.alias("within_labels"), "better_than_mean")


@query("h2_random_forest", over("tracking", _held_out("tracking", 75)))
def h2_random_forest(spark, sf_dir):
    """The larger forest on the held-out rows."""
    train, test = split_tracking(spark, sf_dir, prepare.DEFAULT_TEST_SHARE)
    candidate = models.forest(_inputs(train), "price", models.FOREST_V1)
    model = models.fit_trees({"forest": candidate}, train, ["id"])["forest"]
    return _judged(model.transform(test).select("id", "price", "prediction"), train)


def _group_means(view, label):
    return f"""SELECT t.id, t.{label}, round(m.mean, 6) AS prediction FROM {view} t
        JOIN (SELECT bedrooms, avg({label}) AS mean FROM {view} WHERE {BUCKET} < 80 GROUP BY bedrooms) m USING (bedrooms)
        WHERE {BUCKET} >= 80"""


@query("h2_forest_one_feature", over("tracking", _group_means("tracking", "price")))
def h2_forest_one_feature(spark, sf_dir):
    """One unbagged tree on a feature of few values predicts the mean of each value."""
    train, test = prepare.key_split(tracking_rows(load_listings(spark, sf_dir)), "id", 0.2)
    estimator = models.forest(["bedrooms"], "price", {"n_estimators": 1, "bootstrap": False})
    scored = estimator.fit(train).transform(test)
    return rounded(scored.select("id", "price", "prediction"), ["prediction"])


def _side(rows: str, unless: str = "") -> str:
    """SQL of the split of ``rows`` (side, b, n, s) that lowers the squared error most, per side; ties go to the lowest value."""
    return f"""(SELECT side, b AS cut, gain FROM (
        SELECT side, b, ls * ls / ln + (s_all - ls) * (s_all - ls) / (n_all - ln) - s_all * s_all / n_all AS gain FROM (
            SELECT side, b, sum(n) OVER own AS ln, sum(s) OVER own AS ls, sum(n) OVER (PARTITION BY side) AS n_all,
                sum(s) OVER (PARTITION BY side) AS s_all
            FROM {rows} WINDOW own AS (PARTITION BY side ORDER BY b)) WHERE n_all > ln)
        ORDER BY gain DESC, side, b LIMIT 1)"""


_BEST_FIRST = f"""SELECT t.id, t.price, round(m.mean, 6) AS prediction FROM
    (SELECT id, price, {{group}} AS leaf FROM tracking t, first_cut, second_cut WHERE {BUCKET} >= 80) t
    JOIN (SELECT {{group}} AS leaf, avg(price) AS mean FROM tracking t, first_cut, second_cut WHERE {BUCKET} < 80 GROUP BY 1) m USING (leaf)"""
_LEAF = """CASE WHEN (bedrooms > first_cut.cut) <> second_cut.side THEN -1 WHEN bedrooms <= second_cut.cut THEN 0 ELSE 1 END"""


@query(
    "h2_best_first_tree",
    over("tracking", "SELECT * FROM tracking").replace("\nSELECT * FROM tracking", "")
    + f""", per_value AS (SELECT bedrooms AS b, count(*) AS n, sum(price) AS s FROM tracking WHERE {BUCKET} < 80 GROUP BY bedrooms),
    first_cut AS {_side("(SELECT false AS side, * FROM per_value)")},
    second_cut AS {_side("(SELECT p.b > f.cut AS side, p.* FROM per_value p, first_cut f)")}
    """
    + _BEST_FIRST.replace("{group}", _LEAF),
)
def h2_best_first_tree(spark, sf_dir):
    """A tree of three leaves: of all splits that lower the error the one that lowers it most comes first."""
    train, test = prepare.key_split(tracking_rows(load_listings(spark, sf_dir)), "id", 0.2)
    settings = {"n_estimators": 1, "bootstrap": False, "max_depth": 6, "max_leaf_nodes": 3}
    model = models.forest(["bedrooms"], "price", settings).fit(train)
    return rounded(model.transform(test).select("id", "price", "prediction"), ["prediction"])


def _training(store, spark, sf_dir):
    """The training set of the newest feature version, and its features without retired columns."""
    training = store.create_training_set(tables.spine(spark, sf_dir), [FeatureLookup(tables.NAME, "id")], "price")
    # Written once: a fit and a score are several readings of the same joins.
    return training, written(training.load_df(), "training")


@query("h3_boosted_trees", over("training", f"SELECT id, price, true AS better_than_mean FROM training WHERE {BUCKET} >= 80"))
def h3_boosted_trees(spark, sf_dir):
    store = tables.store_with_features(spark, sf_dir)
    training, rows = _training(store, spark, sf_dir)
    train, test = prepare.key_split(rows, "id", 0.2)
    inputs = [name for name in training.features if name != "id"]
    candidate = models.boosting(inputs, "price", models.BOOSTING_V1)
    model = models.fit_trees({"boosting": candidate}, train, ["id"])["boosting"]
    # Sums of trees may leave the range of the labels.
    return _judged(model.transform(test).select("id", "price", "prediction"), train).drop("within_labels")


@query("h3_boosting_one_feature", over("cleaned", _group_means("cleaned", "price")))
def h3_boosting_one_feature(spark, sf_dir):
    """The first tree fits the mean of each value; the residuals leave nothing to later trees."""
    train, test = prepare.key_split(feature_rows(load_listings(spark, sf_dir)), "id", 0.2)
    model = models.boosting(["bedrooms"], "price", {"n_estimators": 3, "max_depth": 3, "random_state": 42}).fit(train)
    return rounded(model.transform(test).select("id", "price", "prediction"), ["prediction"])


@query("h4_predict", over("predicted", "SELECT id, split, round(price, 6) AS price, round(prediction, 6) AS prediction FROM predicted"))
def h4_predict(spark, sf_dir):
    model, train, test = fitted_linear(spark, sf_dir)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    scored = model.transform(both).select("id", "split", "price", "prediction")
    return rounded(scored, ["price", "prediction"])


_ERROR = "(price - prediction)"


@query(
    "h5_r2",
    over(
        "predicted",
        f"""SELECT split, count(*) AS n_rows, round(1 - avg({_ERROR} * {_ERROR}) / var_pop(price), 6) AS r2
            FROM predicted GROUP BY split""",
    ),
)
def h5_r2(spark, sf_dir):
    model, train, test = fitted_linear(spark, sf_dir)
    return rounded(models.evaluate_splits(model, train, test, "price").select("split", "n_rows", "r2"), ["r2"])


@query(
    "h6_errors",
    over(
        "predicted",
        f"""SELECT split, round(avg({_ERROR} * {_ERROR}), 4) AS mse, round(sqrt(avg({_ERROR} * {_ERROR})), 6) AS rmse,
            round(avg(abs{_ERROR}), 6) AS mae FROM predicted GROUP BY split""",
    ),
)
def h6_errors(spark, sf_dir):
    model, train, test = fitted_linear(spark, sf_dir)
    errors = models.evaluate_splits(model, train, test, "price").select("split", "mse", "rmse", "mae")
    return rounded(rounded(errors, ["mse"], 4), ["rmse", "mae"])


_TRACKED_INPUTS = [
    "host_response_rate", "host_acceptance_rate", "bedrooms", "review_scores_rating", "latitude", "longitude", "review_scores_sum",
]
SHARES_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS Feature, true AS a_share, CAST(1 AS DOUBLE) AS total, count(*) > 0 AS trained FROM tracking" for name in _TRACKED_INPUTS
)


def shares(importances, rows):
    """Importances have no closed form; they are shares of one."""
    total = importances.agg(F.round(F.sum("Importance"), 6).alias("total"))
    trained = rows.agg((F.count("*") > 0).alias("trained"))
    share = F.col("Importance").between(0, 1).alias("a_share")
    return importances.select("Feature", share).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(trained))


@query("h7_importances", over("tracking", SHARES_SQL))
def h7_importances(spark, sf_dir):
    train, _ = split_tracking(spark, sf_dir, 0.1)
    candidate = models.forest(_inputs(train), "price", models.FOREST_TRACKED)
    return shares(models.importances(models.fit_trees({"forest": candidate}, train, ["id"])["forest"]), train)


@query(
    "h8_load_versions",
    over(
        "plane",
        f"""SELECT t.id, round(s.a + s.b * t.bedrooms, 6) AS prediction_1,
            round(my + bx * (t.bedrooms - mx) + bz * (t.score_diff_to_last_month - mz), 6) AS prediction_2
            FROM training t, plane, (SELECT regr_intercept(price, bedrooms) AS a, regr_slope(price, bedrooms) AS b
                                     FROM training WHERE {BUCKET} < 80) s""",
    ),
)
def h8_load_versions(spark, sf_dir):
    """Two stored versions of a model, both loaded and applied to the same rows."""
    store = tables.store_with_features(spark, sf_dir)
    training, rows = _training(store, spark, sf_dir)
    train, _ = prepare.key_split(rows, "id", 0.2)
    for inputs in (["bedrooms"], ["bedrooms", "score_diff_to_last_month"]):
        store.log_model("price_model", models.linear(inputs, "price").fit(train), training)
    for version in (1, 2):
        rows = with_prediction(rows, store.load_model("price_model", version), into=f"prediction_{version}")
    return rounded(rows.select("id", "prediction_1", "prediction_2"), ["prediction_1", "prediction_2"])


@query(
    "h8_load_by_run",
    over(
        "training",
        f"""SELECT t.id, round(s.a + s.b * t.bedrooms, 6) AS prediction FROM training t, (
            SELECT regr_intercept(price, bedrooms) AS a, regr_slope(price, bedrooms) AS b FROM training WHERE {BUCKET} < 80) s""",
    ),
)
def h8_load_by_run(spark, sf_dir):
    """Two runs log a model each; the first run's is applied."""
    store = tables.store_with_features(spark, sf_dir)
    training, rows = _training(store, spark, sf_dir)
    train, _ = prepare.key_split(rows, "id", 0.2)
    for run, inputs in (("run-1", ["bedrooms"]), ("run-2", ["bedrooms", "score_diff_to_last_month"])):
        store.log_model("price_model", models.linear(inputs, "price").fit(train), training, run_id=run)
    return rounded(with_prediction(rows, store.load_run_model("run-1")).select("id", "prediction"), ["prediction"])


def _stored_model(spark, sf_dir):
    store = tables.store_with_features(spark, sf_dir)
    training, rows = _training(store, spark, sf_dir)
    train, _ = prepare.key_split(rows, "id", 0.2)
    model = models.linear(["score_diff_to_last_month", "bedrooms", "latitude"], "price").fit(train)
    store.log_model("price_model", model, training, run_id="run-1")
    return store


@query(
    "h9_stored_signature",
    over(
        "training",
        " UNION ALL ".join(
            f"SELECT {i} AS position, '{name}' AS name, lower(typeof(first({name}))) AS type, '{role}' AS role FROM training"
            for i, (name, role) in enumerate(
                [("id", "input"), ("score_diff_to_last_month", "input"), ("bedrooms", "looked up"), ("latitude", "looked up"), ("price", "label")]
            )
        ),
    ),
)
def h9_stored_signature(spark, sf_dir):
    """The columns a stored model was trained on: its key and fresh feature, what it looks up, its label."""
    return _stored_model(spark, sf_dir).model_signature("price_model", 1)


@query(
    "h10_stored_example",
    over("training", "SELECT id, score_diff_to_last_month, bedrooms, latitude FROM training ORDER BY id LIMIT 3"),
)
def h10_stored_example(spark, sf_dir):
    """The input rows that were stored with a model."""
    return _stored_model(spark, sf_dir).model_example("price_model", 1)


_SIGNATURE = " UNION ALL ".join(
    f"SELECT {i} AS position, '{name}' AS name, '{kind}' AS type, count({name}) = count(*) AS required FROM cleaned_inputs"
    for i, (name, kind) in enumerate(
        [
            ("host_response_rate", "double"), ("host_acceptance_rate", "double"), ("bedrooms", "bigint"),
            ("beds", "bigint"), ("review_scores_rating", "double"), ("price", "double"),
        ]
    )
).replace("cleaned_inputs", "(SELECT t.*, l.beds FROM tracking t JOIN (SELECT id, beds FROM listings) l USING (id))")


@query("h9_signature", over("tracking", _SIGNATURE))
def h9_signature(spark, sf_dir):
    """Inputs and label with their types; beds, alone among them, is missing in places."""
    listings = load_listings(spark, sf_dir)
    rows = tracking_rows(listings).join(listings.select("id", "beds"), "id")
    inputs = ["host_response_rate", "host_acceptance_rate", "bedrooms", "beds", "review_scores_rating", "price"]
    return models.signature(rows.select(inputs))


@query("h10_input_example", over("tracking", f"SELECT * REPLACE (round(review_scores_sum, 6) AS review_scores_sum) FROM tracking WHERE {BUCKET} < 75 ORDER BY id LIMIT 3"))
def h10_input_example(spark, sf_dir):
    train, _ = prepare.key_split(tracking_rows(load_listings(spark, sf_dir)), "id")
    return rounded(prepare.first_rows(train, ["id"], 3), ["review_scores_sum"])


@query(
    "h11_model_column",
    over(
        "predicted",
        """SELECT l.id, l.beds, round(c.intercept + c.slope * l.beds, 6) AS expected_price
           FROM listings l, coefficients c WHERE l.beds IS NOT NULL""",
    ),
)
def h11_model_column(spark, sf_dir):
    """The model's input bound by name to another column."""
    model, _, _ = fitted_linear(spark, sf_dir)
    listings = load_listings(spark, sf_dir).select("id", "beds").where("beds IS NOT NULL")
    return rounded(with_prediction(listings, model, {"bedrooms": "beds"}, "expected_price"), ["expected_price"])


@query("l3_model_as_function", over("predicted", "SELECT id, round(prediction, 6) AS prediction FROM predicted WHERE split = 'test'"))
def l3_model_as_function(spark, sf_dir):
    model, _, test = fitted_linear(spark, sf_dir)
    return rounded(with_prediction(test.select("id", "bedrooms"), model).select("id", "prediction"), ["prediction"])


@query(
    "l3_model_in_sql",
    over(
        "filled",
        f"""SELECT f.id, round(c.intercept + c.slope * f.bedrooms, 6) AS linear_price, round(m.mean, 6) AS tree_price FROM filled f,
            (SELECT regr_slope(price, bedrooms) AS slope, regr_intercept(price, bedrooms) AS intercept FROM filled WHERE {BUCKET} < 80) c,
            (SELECT bedrooms, avg(price) AS mean FROM filled WHERE {BUCKET} < 80 GROUP BY bedrooms) m
            WHERE f.bedrooms = m.bedrooms AND c.intercept + c.slope * f.bedrooms > (SELECT avg(price) FROM filled)""",
    ),
)
def l3_model_in_sql(spark, sf_dir):
    """Two models, the fill of missing values included, as functions in SQL: in the select list and in the condition."""
    rows = linear_rows(load_listings(spark, sf_dir))
    _, fill = prepare.mean_fill(rows, ["bedrooms", "price"])
    train, _ = prepare.key_split(fill.transform(rows), "id", 0.2)
    mean = fill.surrogateDF.first()
    one_tree = {"n_estimators": 1, "bootstrap": False}
    for name, model in (("linear_price", models.linear(["bedrooms"], "price")), ("tree_price", models.forest(["bedrooms"], "price", one_tree))):
        fitted = model.fit(train)
        filled = PipelineModel(stages=[prepare.fill_of(fill, "bedrooms"), *fitted.stages])
        compiled.create_function(spark, name, filled, {"bedrooms": "DOUBLE"})
    rows.createOrReplaceTempView("listings_to_price")
    return spark.sql(f"""SELECT id, round(linear_price(bedrooms), 6) AS linear_price, round(tree_price(bedrooms), 6) AS tree_price
        FROM listings_to_price WHERE linear_price(bedrooms) > {mean["price"]!r}D""")


def _sizes(below: int) -> str:
    return f"(SELECT count(*) FILTER (WHERE {BUCKET} < {below}) AS n_train, count(*) FILTER (WHERE {BUCKET} >= {below}) AS n_test FROM tracking)"


@query(
    "h12_compare_parameters",
    over(
        "tracking",
        f"SELECT run, n_train, n_test, true AS train_better, true AS test_better FROM (VALUES ('forest_1'), ('forest_2')) r(run), {_sizes(75)}",
    ),
)
def h12_compare_parameters(spark, sf_dir):
    """Two forests on the same rows: each is better than the mean label on train and test rows."""
    train, test = split_tracking(spark, sf_dir, prepare.DEFAULT_TEST_SHARE)
    inputs = _inputs(train)
    candidates = {
        "forest_1": models.forest(inputs, "price", models.FOREST_V1),
        "forest_2": models.forest(inputs, "price", models.FOREST_V2),
    }
    compared = models.compare(models.fit_trees(candidates, train, ["id"]), train, test, "price")
    sizes = train.agg(F.count("*").alias("n_train")).crossJoin(test.agg(F.count("*").alias("n_test")))
    better = [(F.col(f"{side}_r2") > 0).alias(f"{side}_better") for side in ("train", "test")]
    return compared.select("run", *better).crossJoin(F.broadcast(sizes))


def _search(spark, sf_dir, **options):
    rows = search_rows(load_listings(spark, sf_dir))
    train, test = prepare.key_split(rows, "id", 0.2)
    return search.regress(train, "price", "id", **options), train, test


def _trial_sql(trials) -> str:
    rows = ", ".join(
        f"({number}, '{kind}', '{json.dumps(params, sort_keys=True)}', '{metric}')"
        for number, (kind, params) in enumerate(trials)
        for metric in models.METRICS
    )
    return f"SELECT trial, kind, params, metric, n > 0 AS measured FROM (VALUES {rows}) t(trial, kind, params, metric), (SELECT count(price) AS n FROM linear)"


_TRIALS = [(kind, params) for kind, sets in search.DEFAULT_GRID.items() for params in sets]


def _measured(trials):
    return trials.select("trial", "kind", "params", "metric", F.col("value").isNotNull().alias("measured"))


@query("i1_model_search", over("linear", f"SELECT id, price, true AS better_than_mean FROM linear WHERE {BUCKET} >= 80"))
def i1_model_search(spark, sf_dir):
    """The best model by rmse on the test rows, rows without a label included."""
    summary, train, test = _search(spark, sf_dir, primary_metric="rmse", timeout_minutes=5)
    return _judged(with_prediction(test, summary.model).select("id", "price", "prediction"), train).drop("within_labels")


@query("i2_primary_metrics", over("linear", f"SELECT metric, count(price) > 0 AS best FROM linear, (VALUES {', '.join(f"('{m}')" for m in models.METRICS)}) t(metric) GROUP BY metric"))
def i2_primary_metrics(spark, sf_dir):
    """The best trial by each metric: no trial is better."""
    summary, _, _ = _search(spark, sf_dir)
    best = None
    for metric in models.METRICS:
        row = search.best_trial(summary.trials, metric).select("metric", F.col("value").alias("chosen"))
        best = row if best is None else best.unionByName(row)
    extremes = summary.trials.groupBy("metric").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    wanted = F.when(F.col("metric") == "r2", F.col("most")).otherwise(F.col("least"))
    return best.join(extremes, "metric").select("metric", (F.col("chosen") == wanted).alias("best"))


@query(
    "i2_linear_trial",
    over(
        "linear",
        f"""SELECT m.metric, round(CASE m.metric WHEN 'mse' THEN mse WHEN 'rmse' THEN sqrt(mse) WHEN 'mae' THEN mae ELSE 1 - mse / spread END, 4) AS value
            FROM (VALUES {", ".join(f"('{m}')" for m in models.METRICS)}) m(metric), (
                SELECT avg((price - a - b * x) * (price - a - b * x)) AS mse, avg(abs(price - a - b * x)) AS mae, var_pop(price) AS spread
                FROM (SELECT price, coalesce(bedrooms, fill) AS x FROM linear, {{fill}} WHERE price IS NOT NULL AND {BUCKET} >= 80) held_out,
                    (SELECT regr_intercept(price, x) AS a, regr_slope(price, x) AS b
                     FROM (SELECT price, coalesce(bedrooms, fill) AS x FROM linear, {{fill}} WHERE price IS NOT NULL AND {BUCKET} < 80)) line)""".replace(
            "{fill}", f"(SELECT avg(bedrooms) AS fill FROM linear WHERE price IS NOT NULL AND {BUCKET} < 80) f"
        ),
    ),
)
def i2_linear_trial(spark, sf_dir):
    """The metrics of one trial, a linear model on one input, which have a closed form."""
    grid = {"linear": [{"regParam": 0.0}]}
    summary = search.regress(linear_rows(load_listings(spark, sf_dir)), "price", "id", grid=grid, seed=None)
    return rounded(summary.trials.select("metric", "value"), ["value"], 4)


@query("i3_time_limit", over("linear", _trial_sql(_TRIALS[:1])))
def i3_time_limit(spark, sf_dir):
    """With no time left only the first trial is run."""
    summary, _, _ = _search(spark, sf_dir, timeout_minutes=0)
    return _measured(summary.trials)


@query("i6_trial_table", over("linear", _trial_sql(_TRIALS)))
def i6_trial_table(spark, sf_dir):
    """Every candidate with its parameters, measured by every metric."""
    summary, _, _ = _search(spark, sf_dir, primary_metric="mae")
    return _measured(summary.trials)


_SEARCHED = (
    "(SELECT id, l.bedrooms, l.beds, l.latitude, l.longitude, l.host_response_time, n.price "
    f"FROM listings l JOIN linear n USING (id) WHERE {BUCKET} < 80)"
)
_SEARCHED_FIELDS = [
    T.StructField(name, T.DoubleType() if name == "price" else LISTINGS_SCHEMA[name].dataType) for name in ["id", *SEARCH_COLUMNS]
]


@query("i5_training_profile", over("linear", profile_sql(_SEARCHED_FIELDS, _SEARCHED)))
def i5_training_profile(spark, sf_dir):
    """The data profile of the whole training part."""
    train, _ = prepare.key_split(search_rows(load_listings(spark, sf_dir)), "id", 0.2)
    return rounded(profile.profile(train).drop("distinct_estimate"), ["mean", "stddev"])


_NUMBERS = [field.name for field in LISTINGS_SCHEMA if isinstance(field.dataType, T.NumericType)]


@query(
    "i5_correlations",
    over(
        "listings",
        " UNION ALL ".join(
            f"""SELECT '{one}' AS left_column, '{other}' AS right_column, count({one} + {other}) AS n_rows,
                round(corr({one}, {other}), 6) AS correlation FROM listings"""
            for i, one in enumerate(_NUMBERS)
            for other in _NUMBERS[i + 1 :]
        ),
    ),
)
def i5_correlations(spark, sf_dir):
    """Every two number columns, over the rows that have both."""
    return rounded(profile.correlations(load_listings(spark, sf_dir)), ["correlation"])


def _distribution_sql(name: str, bins: int = 10) -> str:
    shares = ", ".join(str(k / bins) for k in range(1, bins))
    return f"""SELECT '{name}' AS column_name, CAST(row_number() OVER (ORDER BY upper) AS INTEGER) AS bin, upper, n_rows FROM (
        SELECT upper, (SELECT count(*) FROM listings WHERE {name} <= upper AND ({name} > lower OR lower IS NULL)) AS n_rows FROM (
            SELECT upper, lag(upper) OVER (ORDER BY upper) AS lower FROM (
                SELECT DISTINCT CAST(unnest(list_append(quantile_disc({name}, [{shares}]), max({name}))) AS DOUBLE) AS upper FROM listings)))"""


@query("i5_distributions", over("listings", " UNION ALL ".join(map(_distribution_sql, _NUMBERS))))
def i5_distributions(spark, sf_dir):
    """Ten bins of equal depth for every number column; equal bounds are one bin."""
    return profile.distributions(load_listings(spark, sf_dir))


@query(
    "i1_cross_validation",
    over(
        "linear",
        f"""SELECT fold, n_train, n_test, round(mse, 4) AS mse, round(sqrt(mse), 6) AS rmse, round(1 - mse / spread, 6) AS r2 FROM (
            SELECT m.fold, any_value(n_train) AS n_train, count(*) AS n_test, var_pop(price) AS spread,
                avg((price - intercept - slope * bedrooms) * (price - intercept - slope * bedrooms)) AS mse
            FROM (SELECT f.fold, count(*) AS n_train, regr_slope(l.price, l.bedrooms) AS slope, regr_intercept(l.price, l.bedrooms) AS intercept
                  FROM range(5) f(fold), linear l WHERE {BUCKET} % 5 <> f.fold AND l.price IS NOT NULL AND l.bedrooms IS NOT NULL GROUP BY f.fold) m
            JOIN linear l ON {BUCKET} % 5 = m.fold WHERE l.price IS NOT NULL AND l.bedrooms IS NOT NULL GROUP BY m.fold)""",
    ),
)
def i1_cross_validation(spark, sf_dir):
    """A linear model on five folds, each worked out from one pass of sums."""
    measured = search.cross_validate_linear(linear_rows(load_listings(spark, sf_dir)), "price", "id", ["bedrooms"], reg_params=(0.0,))
    measured = measured.select(F.col("fold").cast("long").alias("fold"), "n_train", "n_test", "mse", "rmse", "r2")
    return rounded(rounded(measured, ["mse"], 4), ["rmse", "r2"])
