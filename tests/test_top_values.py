from stayframe.queries import QUERIES
from stayframe.sources.listings import LISTINGS_SCHEMA


def test_top_values_cover_every_column(spark, sf_dir):
    found = QUERIES["c4_top_values"](spark, sf_dir).unionByName(QUERIES["c4_top_values_of_rest"](spark, sf_dir))
    assert {row.column_name for row in found.select("column_name").distinct().collect()} == set(LISTINGS_SCHEMA.names)
