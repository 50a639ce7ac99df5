"""Preparing data for a model."""

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stayframe.operators import prepare
from stayframe.operators.models import vector_columns
from stayframe.plans.cleaning import feature_rows, linear_rows, search_rows, tracking_rows
from stayframe.queries.oracle import BUCKET, over
from stayframe.queries.registry import query, rounded
from stayframe.sources.listings import load_listings


@query("g1_mean_fill", over("filled", "SELECT id, round(bedrooms, 6) AS bedrooms, round(price, 6) AS price FROM filled"))
def g1_mean_fill(spark, sf_dir):
    filled, _ = prepare.mean_fill(linear_rows(load_listings(spark, sf_dir)), ["bedrooms", "price"])
    return rounded(filled, ["bedrooms", "price"])


def _sides(train, test):
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("g2_split", over("linear", f"SELECT *, CASE WHEN {BUCKET} < 80 THEN 'train' ELSE 'test' END AS split FROM linear"))
def g2_split(spark, sf_dir):
    return _sides(*prepare.key_split(linear_rows(load_listings(spark, sf_dir)), "id", 0.2))


_EXACT = """SELECT id, bedrooms, price, CASE WHEN row_number() OVER (ORDER BY ((id % 2147483648) * 2654435761) % 4294967296, id)
    <= ceil(0.1 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM linear"""


@query("g2_exact_split", over("linear", _EXACT))
def g2_exact_split(spark, sf_dir):
    """A tenth of the rows, rounded up, to the row: those with the smallest hashes of their keys."""
    return _sides(*prepare.exact_split(linear_rows(load_listings(spark, sf_dir)), "id", 0.1))


@query("g2_random_split", over("linear", "SELECT id, bedrooms, price, 1 AS n_sides, true AS a_fifth FROM linear"))
def g2_random_split(spark, sf_dir):
    """Every row is on one side, and about a fifth of them is held out; which ones is drawn."""
    train, test = prepare.random_split(linear_rows(load_listings(spark, sf_dir)), 0.2, 42)
    sides = _sides(train, test)
    share = sides.agg(F.avg((F.col("split") == "test").cast("int")).alias("share"))
    once = sides.groupBy("id", "bedrooms", "price").agg(F.count("split").cast("int").alias("n_sides"))
    return once.crossJoin(F.broadcast(share.select(F.col("share").between(0.1, 0.3).alias("a_fifth"))))


def _shares(name, share):
    label = "default" if share is None else str(share)
    train_below = 100 - round((share or 0.25) * 100)

    @query(
        name,
        over(
            "tracking",
            f"""SELECT '{label}' AS test_share, CASE WHEN {BUCKET} < {train_below} THEN 'train' ELSE 'test' END AS split,
                count(*) AS n_rows, round(avg(price), 6) AS avg_price FROM tracking GROUP BY 1, 2""",
        ),
    )
    def shares(spark, sf_dir):
        rows = tracking_rows(load_listings(spark, sf_dir))
        sides = _sides(*(prepare.key_split(rows, "id") if share is None else prepare.key_split(rows, "id", share)))
        counted = sides.groupBy("split").agg(F.count("*").alias("n_rows"), F.avg("price").alias("avg_price"))
        return rounded(counted.withColumn("test_share", F.lit(label)), ["avg_price"])


_shares("g3_test_share_01", 0.1)
_shares("g3_test_share_02", 0.2)
_shares("g3_test_share_default", None)

_ASSEMBLED = ["bedrooms", "review_scores_rating", "latitude"]


@query(
    "g4_feature_vector",
    over("cleaned", "SELECT id, CAST(bedrooms AS DOUBLE) AS f0, review_scores_rating AS f1, latitude AS f2 FROM cleaned"),
)
def g4_feature_vector(spark, sf_dir):
    rows = feature_rows(load_listings(spark, sf_dir))
    assembled = prepare.assembler(_ASSEMBLED).transform(rows)
    return vector_columns(assembled, "features", ["f0", "f1", "f2"]).select("id", "f0", "f1", "f2")


@query("g5_label_and_features", over("tracking", "SELECT price AS label, * EXCLUDE (id, price) REPLACE (round(review_scores_sum, 6) AS review_scores_sum) FROM tracking"))
def g5_label_and_features(spark, sf_dir):
    rows = tracking_rows(load_listings(spark, sf_dir))
    features = prepare.feature_columns(rows, "price", without=["id"])
    return rounded(rows.select(F.col("price").alias("label"), *features), ["review_scores_sum"])


@query(
    "g6_joined_codes",
    over(
        "listings",
        """SELECT l.id, l.price, c.code, c.n_rows FROM listings l LEFT JOIN (
             SELECT price, count(*) AS n_rows, row_number() OVER (ORDER BY count(*) DESC, price) - 1 AS code
             FROM listings WHERE price IS NOT NULL GROUP BY price) c USING (price)""",
    ),
)
def g6_joined_codes(spark, sf_dir):
    """A column of nearly as many values as rows: codes by frequency, joined instead of one-hot encoded."""
    listings = load_listings(spark, sf_dir).select("id", "price")
    codes = prepare.category_codes(listings, "price")
    return prepare.with_codes(listings, codes, "price", "code").join(codes.select("code", "n_rows"), "code", "left")


@query(
    "g6_categories",
    over(
        "listings",
        """SELECT id, host_response_time, CAST(coalesce(position, n) AS DOUBLE) AS category, category AS place
           FROM (SELECT l.*, position, n, CASE WHEN position < n THEN position END AS category
           FROM listings l LEFT JOIN (
             SELECT host_response_time, row_number() OVER (ORDER BY count(*) DESC, host_response_time) - 1 AS position
             FROM listings WHERE host_response_time IS NOT NULL GROUP BY host_response_time) USING (host_response_time)
           CROSS JOIN (SELECT count(DISTINCT host_response_time) AS n FROM listings))""",
    ),
)
def g6_categories(spark, sf_dir):
    """Categories by frequency, null as the last; ``place`` is where the encoded vector has its one, null if nowhere."""
    rows = search_rows(load_listings(spark, sf_dir)).select("id", "host_response_time")
    stages, _ = prepare.category_stages(["host_response_time"])
    encoded = Pipeline(stages=stages).fit(rows).transform(rows)
    place = F.array_position(vector_to_array("host_response_time_vector"), 1.0)
    return encoded.select(
        "id",
        "host_response_time",
        F.col("host_response_time_index").alias("category"),
        F.when(place > 0, place - 1).alias("place"),
    )
