"""Projections, filters, scalar expressions."""

from pyspark.sql import functions as F

from stayframe.functions.money import money, percent
from stayframe.functions.rows import key_noise, row_mean, row_sum
from stayframe.operators.numbering import duplicated_keys, store_with_row_key
from stayframe.plans.cleaning import ETL_COLUMNS, MODEL_COLUMNS, feature_rows, mean_reviews
from stayframe.queries.oracle import (
    ALL_COLUMNS, DOLLARS, DOLLARS_AND_COMMAS, FRESH, complete, over, rate,
)
from stayframe.queries.registry import query, rounded
from stayframe.session import new_workspace
from stayframe.sources.listings import REVIEW_PARTS, load_listings

_SUM = " + ".join(REVIEW_PARTS)


@query("b1_select", over("listings", f"SELECT {', '.join(ETL_COLUMNS)} FROM listings"))
def b1_select(spark, sf_dir):
    return load_listings(spark, sf_dir).select(ETL_COLUMNS)


@query("b2_drop", over("listings", "SELECT * EXCLUDE (availability_365, minimum_nights) FROM listings"))
def b2_drop(spark, sf_dir):
    """An unknown column is ignored."""
    return load_listings(spark, sf_dir).drop("availability_365", "minimum_nights", "no_such_column")


@query(
    "b3_filter",
    over("listings", "SELECT * FROM listings WHERE minimum_nights < 14 AND availability_365 > 0 AND bedrooms = 2"),
)
def b3_filter(spark, sf_dir):
    listings = load_listings(spark, sf_dir)
    return listings.where("minimum_nights < 14").where("availability_365 > 0").where("bedrooms == 2")


@query("b4_dropna", over("listings", f"SELECT * FROM listings WHERE {complete(ALL_COLUMNS)}"))
def b4_dropna(spark, sf_dir):
    return load_listings(spark, sf_dir).dropna("any")


@query(
    "b5_with_column",
    over("listings", f"SELECT * REPLACE ({DOLLARS} AS price), minimum_nights * 2 AS double_nights FROM listings"),
)
def b5_with_column(spark, sf_dir):
    """One column replaced, one added."""
    listings = load_listings(spark, sf_dir)
    return listings.withColumn("price", money("price")).withColumn("double_nights", F.col("minimum_nights") * 2)


@query("b6_price_strict", over("listings", f"SELECT id, {DOLLARS} AS price FROM listings"))
def b6_price_strict(spark, sf_dir):
    return load_listings(spark, sf_dir).select("id", money("price").alias("price"))


@query("b7_price_thousands", over("listings", f"SELECT id, {DOLLARS_AND_COMMAS} AS price FROM listings"))
def b7_price_thousands(spark, sf_dir):
    return load_listings(spark, sf_dir).select("id", money("price", "thousands").alias("price"))


@query(
    "b8_percent",
    over(
        "listings",
        f"""SELECT id, {rate('host_response_rate')} AS host_response_rate,
            {rate('host_acceptance_rate')} AS host_acceptance_rate FROM listings""",
    ),
)
def b8_percent(spark, sf_dir):
    rates = ["host_response_rate", "host_acceptance_rate"]
    return load_listings(spark, sf_dir).select("id", *[percent(name).alias(name) for name in rates])


@query("b9_to_double", over("listings", "SELECT id, CAST(bedrooms AS DOUBLE) AS bedrooms FROM listings"))
def b9_to_double(spark, sf_dir):
    return load_listings(spark, sf_dir).select("id", F.col("bedrooms").cast("double").alias("bedrooms"))


@query("b10_row_sum", over("listings", f"SELECT id, round({_SUM}, 6) AS review_scores_sum FROM listings"))
def b10_row_sum(spark, sf_dir):
    summed = load_listings(spark, sf_dir).select("id", row_sum(REVIEW_PARTS).alias("review_scores_sum"))
    return rounded(summed, ["review_scores_sum"])


@query("b11_row_mean", over("listings", f"SELECT id, round(({_SUM}) / 6, 6) AS average_review_score FROM listings"))
def b11_row_mean(spark, sf_dir):
    mean = load_listings(spark, sf_dir).select("id", row_mean(REVIEW_PARTS).alias("average_review_score"))
    return rounded(mean, ["average_review_score"])


@query("b12_row_key", over("listings", f"SELECT {', '.join(MODEL_COLUMNS)}, true AS has_key FROM listings"))
def b12_row_key(spark, sf_dir):
    """Rows without a natural key get one that is stored with them; its values say nothing, so only their being there is shown."""
    rows = load_listings(spark, sf_dir).select(MODEL_COLUMNS)
    keyed = store_with_row_key(rows, new_workspace(spark, "keyed"), "row_id")
    return keyed.select(*MODEL_COLUMNS, F.col("row_id").isNotNull().alias("has_key"))


@query("b12_row_key_unique", over("listings", "SELECT count(*) AS n_rows, 0 AS n_repeated FROM listings"))
def b12_row_key_unique(spark, sf_dir):
    rows = load_listings(spark, sf_dir).select(MODEL_COLUMNS)
    stored = store_with_row_key(rows, new_workspace(spark, "keyed"), "row_id")
    repeated = duplicated_keys(stored, ["row_id"]).agg(F.count("*").cast("int").alias("n_repeated"))
    return stored.agg(F.count("*").alias("n_rows")).crossJoin(repeated)


@query("b13_fresh_feature", over("listings", f"SELECT id, {FRESH} AS score_diff_to_last_month FROM listings"))
def b13_fresh_feature(spark, sf_dir):
    return load_listings(spark, sf_dir).select("id", key_noise("id").alias("score_diff_to_last_month"))


@query(
    "b14_expressions",
    over(
        "listings",
        """SELECT id AS listing, bedrooms + 1 AS rooms, 'listing' AS kind, 6 AS parts,
           review_scores_rating * 20 AS percent_score FROM listings""",
    ),
)
def b14_expressions(spark, sf_dir):
    """Reference with alias, SQL expression, literals."""
    return load_listings(spark, sf_dir).select(
        F.col("id").alias("listing"),
        F.expr("bedrooms + 1").alias("rooms"),
        F.lit("listing").alias("kind"),
        F.lit(len(REVIEW_PARTS)).alias("parts"),
        (F.col("review_scores_rating") * 20).alias("percent_score"),
    )


@query(
    "b11_mean_reviews",
    over(
        "features",
        f"""SELECT * EXCLUDE ({', '.join(REVIEW_PARTS)}), round(({_SUM}) / 6, 6) AS average_review_score FROM features""",
    ),
)
def b11_mean_reviews(spark, sf_dir):

    return rounded(mean_reviews(feature_rows(load_listings(spark, sf_dir)).drop("price")), ["average_review_score"])
