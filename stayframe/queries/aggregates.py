"""Aggregation, profiling, sorting, top-k, and the five cleaning sequences."""

from pyspark.sql import functions as F

from stayframe.operators import profile
from stayframe.operators.prepare import first_rows
from stayframe.operators.sketches import ProfiledTable
from stayframe.plans import cleaning
from stayframe.queries.oracle import ALL_COLUMNS, over
from stayframe.queries.registry import query, rounded
from stayframe.session import new_workspace
from stayframe.sources.listings import LISTINGS_SCHEMA, load_listings
from stayframe.sources.snapshots import SnapshotTable


@query("c1_row_count", over("listings", "SELECT count(*) AS n_rows FROM listings"))
def c1_row_count(spark, sf_dir):
    return profile.row_count(load_listings(spark, sf_dir))


@query(
    "c2_avg_price_by_bedrooms",
    over(
        "etl",
        """SELECT round(avg(price) FILTER (WHERE bedrooms = 2), 6) AS avg_price_bedrooms_2,
           round(avg(price) FILTER (WHERE bedrooms = 3), 6) AS avg_price_bedrooms_3 FROM etl""",
    ),
)
def c2_avg_price_by_bedrooms(spark, sf_dir):
    means = profile.mean_by_value(cleaning.etl_rows(load_listings(spark, sf_dir)), "bedrooms", "price", [2, 3])
    return rounded(means, means.columns)


@query(
    "c2_avg_price_per_group",
    over("etl", "SELECT bedrooms, count(*) AS n_rows, round(avg(price), 6) AS avg_price FROM etl GROUP BY bedrooms"),
)
def c2_avg_price_per_group(spark, sf_dir):
    means = profile.mean_by_group(cleaning.etl_rows(load_listings(spark, sf_dir)), "bedrooms", "price")
    return rounded(means, ["avg_price"])


def _summary_sql(columns, source):
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS column_name, count({name}) AS count, round(avg({name}), 6) AS mean,
            round(stddev_samp({name}), 6) AS stddev, CAST(min({name}) AS DOUBLE) AS min,
            CAST(quantile_disc({name}, 0.25) AS DOUBLE) AS q25, CAST(quantile_disc({name}, 0.5) AS DOUBLE) AS median,
            CAST(quantile_disc({name}, 0.75) AS DOUBLE) AS q75, CAST(max({name}) AS DOUBLE) AS max FROM {source}"""
        for name in columns
    )


@query("c3_summary", over("linear", _summary_sql(["bedrooms", "price"], "linear")))
def c3_summary(spark, sf_dir):
    rows = cleaning.linear_rows(load_listings(spark, sf_dir))
    return rounded(profile.summary(rows, ["bedrooms", "price"]), ["mean", "stddev"])


_TEXT_COLUMNS = [field.name for field in LISTINGS_SCHEMA if field.dataType.simpleString() == "string"]


@query(
    "c3_text_summary",
    over(
        "listings",
        " UNION ALL ".join(
            f"SELECT '{name}' AS column_name, count({name}) AS count, min({name}) AS min, max({name}) AS max FROM listings"
            for name in _TEXT_COLUMNS
        ),
    ),
)
def c3_text_summary(spark, sf_dir):
    return profile.text_summary(load_listings(spark, sf_dir), _TEXT_COLUMNS)


def profile_sql(fields, source):
    parts = []
    for field in fields:
        name, number = field.name, field.dataType.simpleString() in ("bigint", "double")
        measures = (
            f"""round(avg({name}), 6) AS mean, round(stddev_samp({name}), 6) AS stddev, CAST(min({name}) AS DOUBLE) AS min,
            CAST(quantile_disc({name}, 0.5) AS DOUBLE) AS median, CAST(max({name}) AS DOUBLE) AS max"""
            if number
            else ", ".join(f"CAST(NULL AS DOUBLE) AS {measure}" for measure in ("mean", "stddev", "min", "median", "max"))
        )
        parts.append(
            f"SELECT '{name}' AS column_name, count(*) AS n_rows, count(*) - count({name}) AS n_null, {measures} FROM {source}"
        )
    return " UNION ALL ".join(parts)


@query("c4_profile", over("listings", profile_sql(LISTINGS_SCHEMA, "listings")))
def c4_profile(spark, sf_dir):
    return rounded(profile.profile(load_listings(spark, sf_dir)).drop("distinct_estimate"), ["mean", "stddev"])


def _distinct_sql(name):
    return f"SELECT '{name}' AS column_name, count(*) AS n_rows, count(DISTINCT {name}) AS n_distinct, true AS near FROM listings"


_STATED = list(enumerate(LISTINGS_SCHEMA))


@query(
    "c4_merged_profile",
    over(
        "listings",
        " UNION ALL ".join(
            f"""SELECT {i} AS position, '{field.name}' AS column_name, count(*) AS n_rows, count(*) - count({field.name}) AS n_null,
                {f"round(avg({field.name}), 6)" if field.dataType.simpleString() != "string" else "CAST(NULL AS DOUBLE)"} AS mean,
                true AS distinct_near, true AS median_near FROM listings"""
            for i, field in _STATED
        ),
    ),
)
def c4_merged_profile(spark, sf_dir):
    """A profile over three versions of a table from the states stored with each; no row is read again for it.

    Estimates are held against the exact numbers: distinct values within four standard errors (or one), the median's rank
    within two hundredths of a half.
    """
    listings = load_listings(spark, sf_dir)
    stored = ProfiledTable(SnapshotTable(spark, new_workspace(spark, "profiled")))
    for part in range(3):
        stored.write(listings.where(F.col("id") % 3 == part))
    merged = stored.profile()
    exact = profile.distinct_counts(listings, listings.columns).select("column_name", "n_distinct")
    numbers = [field.name for _, field in _STATED if field.dataType.simpleString() != "string"]
    medians = {row["column_name"]: row["median"] for row in merged.where(F.col("median").isNotNull()).collect()}
    ranks = [
        F.struct(
            F.lit(name).alias("column_name"),
            (F.count_if(F.col(name) <= medians[name]) / F.count(name) >= 0.48).alias("not_low"),
            (F.count_if(F.col(name) < medians[name]) / F.count(name) <= 0.52).alias("not_high"),
        )
        for name in numbers
    ]
    near = listings.agg(F.array(*ranks).alias("ranks")).select(F.inline("ranks"))
    joined = merged.join(exact, "column_name").join(near, "column_name", "left")
    off = F.abs(F.col("distinct_estimate") - F.col("n_distinct"))
    return rounded(
        joined.select(
            "position", "column_name", "n_rows", "n_null", "mean",
            (off <= F.greatest(F.lit(1.0), 4 * F.col("distinct_error") * F.col("n_distinct"))).alias("distinct_near"),
            F.coalesce(F.col("not_low") & F.col("not_high"), F.lit(True)).alias("median_near"),
        ),
        ["mean"],
    )


@query("c4_distinct_estimates", over("listings", " UNION ALL ".join(_distinct_sql(name) for name in LISTINGS_SCHEMA.names)))
def c4_distinct_estimates(spark, sf_dir):
    """Estimated beside exact numbers of distinct values; the estimate is within a tenth (or one) of the exact number."""
    listings = load_listings(spark, sf_dir)
    estimates = profile.profile(listings, medians=False).select("column_name", "n_rows", "distinct_estimate")
    exact = profile.distinct_counts(listings, listings.columns)
    near = F.abs(F.col("distinct_estimate") - F.col("n_distinct")) <= F.greatest(F.lit(1), F.col("n_distinct") / 10)
    return estimates.join(exact, "column_name").select("column_name", "n_rows", "n_distinct", near.alias("near"))


# Whole numbers and texts but the key; c4_top_values_of_rest has the key and the nine doubles.
_TOP_COLUMNS = [
    field.name for field in LISTINGS_SCHEMA if field.name != "id" and field.dataType.simpleString() in ("bigint", "string")
]


@query(
    "c4_top_values",
    over(
        "listings",
        "SELECT * FROM (SELECT column_name, value, n, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value)"
        " AS INTEGER) AS rank FROM ("
        + " UNION ALL ".join(
            f"SELECT '{name}' AS column_name, CAST({name} AS STRING) AS value, count(*) AS n FROM listings "
            f"WHERE {name} IS NOT NULL GROUP BY {name}"
            for name in _TOP_COLUMNS
        )
        + ")) WHERE rank <= 3",
    ),
)
def c4_top_values(spark, sf_dir):
    return profile.top_values(load_listings(spark, sf_dir), _TOP_COLUMNS, 3)


# The engines write doubles differently, but decimals alike; the values have at most four decimals.
_REST_COLUMNS = [field.name for field in LISTINGS_SCHEMA if field.name not in _TOP_COLUMNS]
_DOUBLE_COLUMNS = [field.name for field in LISTINGS_SCHEMA if field.dataType.simpleString() == "double"]


def _text_sql(name):
    return f"CAST(CAST({name} AS DECIMAL(18, 4)) AS STRING)" if name in _DOUBLE_COLUMNS else f"CAST({name} AS STRING)"


@query(
    "c4_top_values_of_rest",
    over(
        "listings",
        "SELECT * FROM (SELECT column_name, value, n, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value)"
        " AS INTEGER) AS rank FROM ("
        + " UNION ALL ".join(
            f"SELECT '{name}' AS column_name, {_text_sql(name)} AS value, count(*) AS n FROM listings "
            f"WHERE {name} IS NOT NULL GROUP BY ALL"
            for name in _REST_COLUMNS
        )
        + ")) WHERE rank <= 3",
    ),
)
def c4_top_values_of_rest(spark, sf_dir):
    decimals = {name: F.col(name).cast("decimal(18,4)") for name in _DOUBLE_COLUMNS}
    return profile.top_values(load_listings(spark, sf_dir).withColumns(decimals), _REST_COLUMNS, 3)


@query("c5_scalar", over("etl", "SELECT round(avg(price), 6) AS avg_price FROM etl WHERE bedrooms = 2"))
def c5_scalar(spark, sf_dir):
    """A scalar is a one-row frame until the caller asks for it."""
    rows = cleaning.etl_rows(load_listings(spark, sf_dir)).where("bedrooms == 2")
    return rounded(rows.agg(F.avg("price").alias("avg_price")), ["avg_price"])


def _cleaned(name, sequence, view):
    """The rows, prices and mean price that each cleaning sequence ends with."""
    sql = f"SELECT count(*) AS n_rows, count(price) AS n_priced, round(avg(price), 6) AS avg_price FROM {view}"

    @query(name, over(view, sql))
    def cleaned(spark, sf_dir):
        rows = sequence(load_listings(spark, sf_dir))
        totals = rows.agg(
            F.count("*").alias("n_rows"), F.count("price").alias("n_priced"), F.avg("price").alias("avg_price")
        )
        return rounded(totals, ["avg_price"])


_cleaned("t3_etl_totals", cleaning.etl_rows, "etl")
_cleaned("t3_feature_totals", cleaning.feature_rows, "cleaned")
_cleaned("t3_tracking_totals", cleaning.tracking_rows, "tracking")
_cleaned("t3_linear_totals", cleaning.linear_rows, "linear")
_cleaned("t3_search_totals", cleaning.search_rows, "linear")


@query("t3_etl_rows", over("etl", "SELECT * FROM etl"))
def t3_etl_rows(spark, sf_dir):
    return cleaning.etl_rows(load_listings(spark, sf_dir))


@query("t3_feature_rows", over("cleaned", "SELECT * FROM cleaned"))
def t3_feature_rows(spark, sf_dir):
    return cleaning.feature_rows(load_listings(spark, sf_dir))


@query("t3_tracking_rows", over("tracking", "SELECT * REPLACE (round(review_scores_sum, 6) AS review_scores_sum) FROM tracking"))
def t3_tracking_rows(spark, sf_dir):
    return rounded(cleaning.tracking_rows(load_listings(spark, sf_dir)), ["review_scores_sum"])


@query(
    "l1_sort",
    over("cleaned", "SELECT id, price FROM cleaned ORDER BY price DESC, id"),
)
def l1_sort(spark, sf_dir):
    rows = cleaning.feature_rows(load_listings(spark, sf_dir)).select("id", "price")
    return rows.orderBy(F.desc("price"), "id")


@query("l2_first_rows", over("cleaned", "SELECT id, price FROM cleaned ORDER BY price DESC, id LIMIT 5"))
def l2_first_rows(spark, sf_dir):
    rows = cleaning.feature_rows(load_listings(spark, sf_dir)).select("id", "price")
    return first_rows(rows, [F.desc("price"), "id"], 5)


@query("l2_first_row", over("listings", f"SELECT {', '.join(ALL_COLUMNS)} FROM listings ORDER BY availability_365 DESC, id LIMIT 1"))
def l2_first_row(spark, sf_dir):
    return first_rows(load_listings(spark, sf_dir), [F.desc("availability_365"), "id"], 1)
