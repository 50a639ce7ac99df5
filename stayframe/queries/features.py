"""Lookups and feature tables."""

from pyspark.sql import functions as F

from stayframe.functions.rows import key_noise
from stayframe.operators import models
from stayframe.operators.features import FeatureLookup, FeatureStore
from stayframe.operators.joins import lookup
from stayframe.operators.prepare import key_split
from stayframe.operators.profile import column_info
from stayframe.plans.cleaning import feature_rows, mean_reviews
from stayframe.queries.oracle import over
from stayframe.queries.registry import query, rounded
from stayframe.session import new_workspace
from stayframe.sources.listings import REVIEW_PARTS, load_listings, table
from stayframe.sources.snapshots import SnapshotTable

FIRST, SECOND = "2024-02-01T00:00:00", "2024-02-11T00:00:00"
NAME = "listing_features"
_PARTS = ", ".join(REVIEW_PARTS)
_MEAN = f"round(({' + '.join(REVIEW_PARTS)}) / 6, 6) AS average_review_score"
_UPDATED_SQL = (
    "SELECT * REPLACE ("
    + ", ".join(f"CAST(NULL AS DOUBLE) AS {name}" for name in REVIEW_PARTS)
    + f"), {_MEAN} FROM features"
)


def cleaned(spark, sf_dir):
    return feature_rows(load_listings(spark, sf_dir))


def new_store(spark):
    return FeatureStore(spark, new_workspace(spark, "features"))


def store_with_features(spark, sf_dir):
    store = new_store(spark)
    store.create_table(NAME, ["id"], cleaned(spark, sf_dir).drop("price"), description="Features of the listings", at=FIRST)
    return store


def updated_store(spark, sf_dir):
    """Second version: the review part scores retired in favour of their mean."""
    store = store_with_features(spark, sf_dir)
    store.write_table(NAME, mean_reviews(store.read_table(NAME)), at=SECOND)
    return store


def spine(spark, sf_dir):
    """Key, label, and a feature that is not in the table yet."""
    return cleaned(spark, sf_dir).select("id", "price", key_noise("id").alias("score_diff_to_last_month"))


@query("d1_feature_lookup", over("features", "SELECT l.id, l.price, f.* EXCLUDE (id) FROM listings l LEFT JOIN features f USING (id)"))
def d1_feature_lookup(spark, sf_dir):
    """Every listing, with features where the cleaned table has them."""
    listings = load_listings(spark, sf_dir)
    return lookup(listings.select("id", "price"), feature_rows(listings).drop("price"), ["id"])


@query(
    "d1_lookup_many_to_one",
    over(
        "features",
        """SELECT l.l_orderkey AS id, l.l_linenumber, l.l_suppkey, f.bedrooms, f.review_scores_rating
           FROM lineitem l LEFT JOIN features f ON l.l_orderkey = f.id""",
    ),
)
def d1_lookup_many_to_one(spark, sf_dir):
    """Many spine rows per key."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_suppkey")
    return lookup(rows, cleaned(spark, sf_dir).select("id", "bedrooms", "review_scores_rating"), ["id"])


@query(
    "d1_lookup_few_keys",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey AS s_suppkey, s.s_name, s.s_nationkey
       FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
)
def d1_lookup_few_keys(spark, sf_dir):
    """Few keys hold all spine rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    return lookup(rows, table(spark, sf_dir, "supplier").drop("s_acctbal"), ["s_suppkey"])


@query(
    "d1_lookup_mixed_types",
    """SELECT o.o_orderkey, CAST(o.o_custkey AS DOUBLE) / 2 AS c_custkey, c.c_name
       FROM orders o LEFT JOIN customer c ON CAST(o.o_custkey AS DOUBLE) / 2 = CAST(c.c_custkey AS DOUBLE)""",
)
def d1_lookup_mixed_types(spark, sf_dir):
    """Floating keys against whole ones: halves find nothing, and are not rounded to a neighbour."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey").cast("double") / 2).alias("c_custkey"))
    return lookup(rows, table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("c_custkey"), "c_name"), ["c_custkey"])


@query("f1_create_table", over("features", "SELECT * FROM features"))
def f1_create_table(spark, sf_dir):
    return store_with_features(spark, sf_dir).read_table(NAME)


#: As many as tests have shuffle partitions at least; a table of a terabyte would have thousands.
BUCKETS = 16


def store_by_key(spark, sf_dir):
    store = new_store(spark)
    store.create_table(NAME, ["id"], cleaned(spark, sf_dir).drop("price"), at=FIRST, buckets=BUCKETS)
    return store


@query(
    "f1_table_by_key",
    over("features", f"SELECT f.*, {BUCKETS} AS buckets, (SELECT count(*) FROM features) AS n_stored FROM features f"),
)
def f1_table_by_key(spark, sf_dir):
    """A feature table stored by key; its history says into how many buckets, and how many rows."""
    store = store_by_key(spark, sf_dir)
    entry = store.history(NAME).where("bucket_columns = array('id')").first()
    return store.read_table(NAME).withColumns({"buckets": F.lit(entry.buckets), "n_stored": F.lit(entry.n_rows).cast("long")})


@query("f8_training_in_place", over("training", "SELECT * FROM training"))
def f8_training_in_place(spark, sf_dir):
    """The spine moves to the buckets of a feature table that is stored by key; the features are not shuffled."""
    store = store_by_key(spark, sf_dir)
    return store.create_training_set(spine(spark, sf_dir), [FeatureLookup(NAME, "id", in_place=True)], "price").load_df()


@query("f2_create_empty", over("features", "SELECT * FROM features"))
def f2_create_empty(spark, sf_dir):
    """Created from a schema, filled later."""
    rows = cleaned(spark, sf_dir).drop("price")
    store = new_store(spark)
    store.create_table(NAME, ["id"], schema=rows.schema, at=FIRST)
    store.write_table(NAME, rows, at=SECOND)
    return store.read_table(NAME)


@query("f3_register_table", over("features", "SELECT * FROM features"))
def f3_register_table(spark, sf_dir):
    store = new_store(spark)
    location = f"{store.root}/elsewhere"
    SnapshotTable(spark, location).write(cleaned(spark, sf_dir).drop("price"), at=FIRST)
    store.register_table(NAME, location, ["id"])
    return store.read_table(NAME)


_FEATURES = ["host_response_rate", "host_acceptance_rate", "bedrooms", "review_scores_rating", *REVIEW_PARTS, "latitude", "longitude"]
_DESCRIBED = " UNION ALL ".join(
    f"SELECT {i} AS position, '{name}' AS feature, 'Features of the listings' AS description, count({name}) AS n_values FROM features"
    for i, name in enumerate(_FEATURES)
)


@query("f4_describe_table", over("features", _DESCRIBED))
def f4_describe_table(spark, sf_dir):
    """Name, place and description of every feature, and how many values it has in the newest version."""
    store = store_with_features(spark, sf_dir)
    described = store.get_table(NAME)
    info = column_info(store.read_table(NAME).select(*described.features))
    return info.select(
        "position", F.col("column_name").alias("feature"), F.lit(described.description).alias("description"), F.col("non_null").alias("n_values")
    )


@query("f5_overwrite_grows", over("features", _UPDATED_SQL))
def f5_overwrite_grows(spark, sf_dir):
    return rounded(updated_store(spark, sf_dir).read_table(NAME), ["average_review_score"])


@query("f6_read_newest", over("features", f"SELECT id, bedrooms, true AS retired, {_MEAN} FROM features"))
def f6_read_newest(spark, sf_dir):
    newest = updated_store(spark, sf_dir).read_table(NAME)
    rows = newest.select("id", "bedrooms", F.isnull("review_scores_value").alias("retired"), "average_review_score")
    return rounded(rows, ["average_review_score"])


@query("f7_read_as_of", over("features", "SELECT * FROM features"))
def f7_read_as_of(spark, sf_dir):
    return updated_store(spark, sf_dir).read_table(NAME, as_of="2024-02-05T00:00:00")


@query("f8_training_set", over("training", "SELECT * EXCLUDE (id) FROM training"))
def f8_training_set(spark, sf_dir):
    store = store_with_features(spark, sf_dir)
    return store.create_training_set(spine(spark, sf_dir), [FeatureLookup(NAME, "id")], "price", "id").load_df()


@query("f9_some_features", over("training", "SELECT id, price, score_diff_to_last_month, bedrooms, latitude FROM training"))
def f9_some_features(spark, sf_dir):
    store = store_with_features(spark, sf_dir)
    wanted = [FeatureLookup(NAME, "id", ["bedrooms", "latitude"])]
    return store.create_training_set(spine(spark, sf_dir), wanted, "price").load_df()


@query("f10_derive_features", over("features", f"SELECT * EXCLUDE ({_PARTS}), {_MEAN} FROM features"))
def f10_derive_features(spark, sf_dir):
    store = store_with_features(spark, sf_dir)
    return rounded(mean_reviews(store.read_table(NAME)), ["average_review_score"])


@query("f11_without_retired", over("training", f"SELECT * EXCLUDE (id, {_PARTS}), {_MEAN} FROM training"))
def f11_without_retired(spark, sf_dir):
    """The training set of the second version, retired columns dropped before use."""
    store = updated_store(spark, sf_dir)
    rows = store.create_training_set(spine(spark, sf_dir), [FeatureLookup(NAME, "id")], "price", "id").load_df()
    return rounded(rows.drop(*REVIEW_PARTS), ["average_review_score"])


def scored_store(spark, sf_dir):
    """A linear model on a looked-up and a fresh feature, logged with its lookups."""
    store = store_with_features(spark, sf_dir)
    training = store.create_training_set(spine(spark, sf_dir), [FeatureLookup(NAME, "id")], "price")
    train, _ = key_split(training.load_df(), "id", 0.2)
    model = models.linear(["bedrooms", "score_diff_to_last_month"], "price").fit(train)
    store.log_model("price_model", model, training, at=FIRST)
    return store


@query(
    "f12_score_batch",
    over(
        "plane",
        """SELECT t.id, t.score_diff_to_last_month, t.bedrooms,
           round(my + bx * (t.bedrooms - mx) + bz * (t.score_diff_to_last_month - mz), 6) AS prediction
           FROM training t, plane""",
    ),
)
def f12_score_batch(spark, sf_dir):
    """The input has the key and the fresh feature; the rest is looked up."""
    store = scored_store(spark, sf_dir)
    return rounded(store.score_batch("price_model", 1, spine(spark, sf_dir).drop("price")), ["prediction"])


@query(
    "f13_model_lookups",
    over(
        "features",
        f"""SELECT CAST(1 AS BIGINT) AS version, '{NAME}' AS table_name, 'bedrooms' AS feature, CAST(0 AS BIGINT) AS table_version,
            count(bedrooms) AS n_values FROM features""",
    ),
)
def f13_model_lookups(spark, sf_dir):
    """What a model's versions look up, from which version of which table, and how many values the feature has there."""
    store = scored_store(spark, sf_dir)
    found = None
    for item in store.model_lookups("price_model").collect():
        counted = store.read_table(item.table_name, version=item.table_version).agg(F.count(item.feature).alias("n_values"))
        row = counted.select(
            F.lit(item.version).cast("long").alias("version"), F.lit(item.table_name).alias("table_name"), F.lit(item.feature).alias("feature"),
            F.lit(item.table_version).cast("long").alias("table_version"), "n_values",
        )
        found = row if found is None else found.unionByName(row)
    return found


@query("f14_drop_table", over("features", "SELECT 'kept' AS table_name, count(*) AS n_rows FROM features"))
def f14_drop_table(spark, sf_dir):
    store = store_with_features(spark, sf_dir)
    store.create_table("kept", ["id"], store.read_table(NAME), at=FIRST)
    store.drop_table(NAME)
    left = spark.createDataFrame([(name,) for name in store.list_tables()], "table_name string")
    return left.crossJoin(store.read_table("kept").agg(F.count("*").alias("n_rows")))


@query("f15_partition_columns", over("features", "SELECT * FROM features WHERE bedrooms = 2"))
def f15_partition_columns(spark, sf_dir):
    """The filter on the partition column leaves the other folders unread."""
    store = new_store(spark)
    store.create_table(NAME, ["id"], cleaned(spark, sf_dir).drop("price"), partition_columns=["bedrooms"], at=FIRST)
    return store.read_table(NAME).where("bedrooms == 2")
