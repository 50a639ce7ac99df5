"""Versioned tables."""

from pyspark.sql import functions as F

from stayframe.operators.profile import mean_by_value
from stayframe.plans.cleaning import ETL_COLUMNS, etl_rows
from stayframe.queries.oracle import over
from stayframe.queries.registry import query, rounded
from stayframe.session import new_workspace
from stayframe.sources.listings import load_listings
from stayframe.sources.snapshots import SnapshotTable

FIRST, SECOND = "2024-01-10T00:00:00", "2024-01-20T00:00:00"
_NARROW = [name for name in ETL_COLUMNS if name not in ("availability_365", "minimum_nights")]


def refined(spark, sf_dir):
    """The refined table in two versions, the second without two columns."""
    target = SnapshotTable(spark, new_workspace(spark, "refined"))
    rows = etl_rows(load_listings(spark, sf_dir))
    target.write(rows, operation="CREATE", at=FIRST)
    # The second version is made from the stored first one, not from the raw listings again.
    target.write(target.read().drop("availability_365", "minimum_nights"), operation="OVERWRITE", at=SECOND)
    return target


@query("e1_write_version", over("etl", "SELECT * FROM etl"))
def e1_write_version(spark, sf_dir):
    target = SnapshotTable(spark, new_workspace(spark, "refined"))
    target.write(etl_rows(load_listings(spark, sf_dir)), operation="CREATE", at=FIRST)
    return target.read()


@query("e2_narrower_version", over("etl", f"SELECT {', '.join(_NARROW)} FROM etl"))
def e2_narrower_version(spark, sf_dir):
    return refined(spark, sf_dir).read()


@query(
    "e3_history",
    over(
        "etl",
        f"""SELECT CAST(0 AS BIGINT) AS version, TIMESTAMP '2024-01-10 00:00:00' AS ts, 'CREATE' AS operation,
            '{','.join(ETL_COLUMNS)}' AS columns, count(*) AS n_rows FROM etl UNION ALL
            SELECT CAST(1 AS BIGINT), TIMESTAMP '2024-01-20 00:00:00', 'OVERWRITE', '{','.join(_NARROW)}', count(*) FROM etl""",
    ),
)
def e3_history(spark, sf_dir):
    return refined(spark, sf_dir).history().select(
        "version",
        F.expr("convert_timezone('UTC', cast(ts AS timestamp_ntz))").alias("ts"),
        "operation",
        F.concat_ws(",", "columns").alias("columns"),
        "n_rows",
    )


@query("e4_read_by_version", over("etl", "SELECT * FROM etl"))
def e4_read_by_version(spark, sf_dir):
    return refined(spark, sf_dir).read(version=0)


@query("e5_read_by_time", over("etl", "SELECT * FROM etl"))
def e5_read_by_time(spark, sf_dir):
    """Between the two writes the first version counts."""
    return refined(spark, sf_dir).read(as_of="2024-01-15T12:00:00")


@query("e5_read_at_second_write", over("etl", f"SELECT {', '.join(_NARROW)} FROM etl"))
def e5_read_at_second_write(spark, sf_dir):
    return refined(spark, sf_dir).read(as_of=SECOND)


@query(
    "e6_query_old_version",
    over(
        "etl",
        """SELECT round(avg(price) FILTER (WHERE bedrooms = 2), 6) AS avg_price_bedrooms_2,
           round(avg(price) FILTER (WHERE bedrooms = 3), 6) AS avg_price_bedrooms_3 FROM etl""",
    ),
)
def e6_query_old_version(spark, sf_dir):
    means = mean_by_value(refined(spark, sf_dir).read(version=0), "bedrooms", "price", [2, 3])
    return rounded(means, means.columns)
