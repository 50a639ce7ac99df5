"""Five ways from raw listings to model rows. They differ in the order of cast and null drop, hence in rows and means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.functions.money import money, percent
from stayframe.functions.rows import row_mean, row_sum
from stayframe.sources.listings import REVIEW_PARTS

# The columns of the dataset that each sequence takes.
ETL_COLUMNS = ["id", "bedrooms", "minimum_nights", "availability_365", "price"]
RATE_COLUMNS = ["host_response_rate", "host_acceptance_rate"]
SCORE_COLUMNS = ["review_scores_rating", *REVIEW_PARTS]
MODEL_COLUMNS = [*RATE_COLUMNS, "bedrooms", *SCORE_COLUMNS, "latitude", "longitude", "price"]
SEARCH_COLUMNS = ["bedrooms", "beds", "latitude", "longitude", "host_response_time", "price"]


def etl_rows(listings: DataFrame) -> DataFrame:
    """Filter, drop nulls, then cast: prices from $1,000 stay as rows with a null price."""
    # The two predicates.
    kept = listings.select(ETL_COLUMNS).where("minimum_nights < 14").where("availability_365 > 0").dropna("any")
    return kept.withColumn("price", money("price"))


def feature_rows(listings: DataFrame) -> DataFrame:
    """Cast, then drop nulls: prices from $1,000 vanish."""
    typed = listings.select("id", *MODEL_COLUMNS).withColumns(
        {"price": money("price"), **{name: percent(name) for name in RATE_COLUMNS}}
    )
    return typed.dropna("any")


def tracking_rows(listings: DataFrame) -> DataFrame:
    """Sum the review scores, read prices with their comma, then drop nulls: no row is lost to the comma."""
    summed = listings.select("id", *MODEL_COLUMNS).withColumn("review_scores_sum", row_sum(REVIEW_PARTS))
    typed = summed.drop(*REVIEW_PARTS).withColumns(
        {"price": money("price", "thousands"), **{name: percent(name) for name in RATE_COLUMNS}}
    )
    return typed.dropna("any")


def linear_rows(listings: DataFrame) -> DataFrame:
    """Cast only; the nulls are left to the imputer, which fills dear prices with the mean of the cheaper ones."""
    return listings.select("id", F.col("bedrooms").cast("double").alias("bedrooms"), money("price").alias("price"))


def search_rows(listings: DataFrame) -> DataFrame:
    """Cast only; nulls stay, in the label too."""
    return listings.select("id", *SEARCH_COLUMNS).withColumn("price", money("price"))


def mean_reviews(features: DataFrame) -> DataFrame:
    """Replace the review part scores by their mean."""
    return features.withColumn("average_review_score", row_mean(REVIEW_PARTS)).drop(*REVIEW_PARTS)
