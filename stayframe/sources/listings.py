"""The given tables, and the listings-shaped table that is derived from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The part scores of the dataset.
REVIEW_PARTS = [
    "review_scores_accuracy",
    "review_scores_cleanliness",
    "review_scores_checkin",
    "review_scores_communication",
    "review_scores_location",
    "review_scores_value",
]

LISTINGS_SCHEMA = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("id", "bedrooms", "beds", "minimum_nights", "availability_365")]
    + [
        T.StructField(name, T.StringType())
        for name in ("price", "host_response_rate", "host_acceptance_rate", "host_response_time")
    ]
    + [T.StructField(name, T.DoubleType()) for name in ["review_scores_rating", *REVIEW_PARTS, "latitude", "longitude"]]
)

# Factor of each review score.
_SCORE_FACTORS = {
    "review_scores_rating": 31,
    "review_scores_accuracy": 37,
    "review_scores_cleanliness": 41,
    "review_scores_checkin": 43,
    "review_scores_communication": 47,
    "review_scores_location": 53,
    "review_scores_value": 59,
}


def _unless_multiple(divisor: int, value: str) -> str:
    return f"if(k % {divisor} != 0, {value}, NULL)"


# Residues that make nulls, and the ranges of the numbers. k is the order key, c the customer key.
_LISTING = {
    "id": "k",
    "bedrooms": _unless_multiple(10, "c % 4 + 1"),
    "beds": _unless_multiple(13, "c % 4 + 1 + k % 2"),
    "minimum_nights": "k % 30 + 1",
    "availability_365": "if(c % 9 = 0, 0L, c * 7 % 366)",
    "price": _unless_multiple(
        97,
        "concat('$', if(cents < 100000, '', concat(cents div 100000, ',')), "
        "if(cents < 100000, string(cents div 100), lpad(cents div 100 % 1000, 3, '0')), '.', lpad(cents % 100, 2, '0'))",
    ),
    "host_response_rate": _unless_multiple(11, "if(k % 23 = 0, 'N/A', concat(k % 51 + 50, '%'))"),
    "host_acceptance_rate": _unless_multiple(17, "concat(c % 61 + 40, '%')"),
    "host_response_time": _unless_multiple(
        19, "elt(int(k % 4) + 1, 'within an hour', 'within a few hours', 'within a day', 'a few days or more')"
    ),
    **{
        name: _unless_multiple(29 if name == "review_scores_value" else 7, f"double(k * {factor} % 201 + 300) / 100")
        for name, factor in _SCORE_FACTORS.items()
    },
    "latitude": "double(c * 13 % 1000 + 377000) / 10000",
    "longitude": "double(c * 17 % 1200 - 1225000) / 10000",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive_listings(orders: DataFrame) -> DataFrame:
    """One listing per order: nulls, money and percent strings, and scores at fixed residues of the keys."""
    keys = orders.selectExpr(
        "o_orderkey AS k",
        "o_custkey AS c",
        "bigint(round(o_totalprice * 100)) % 70000 + (o_custkey % 4 + 1) * 15000 + 5000 AS cents",
    )
    return keys.selectExpr(*[f"{value} AS {name}" for name, value in _LISTING.items()])


def load_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_listings(table(spark, sf_dir, "orders"))
