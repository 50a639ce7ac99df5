"""Sources and sinks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayframe.operators import models, profile, runlog
from stayframe.plans.cleaning import etl_rows, tracking_rows
from stayframe.plans.logs import RUN_METRICS, run_log
from stayframe.queries.logs import OPEN_RUNS_SQL, told
from stayframe.queries.models import SHARES_SQL, shares
from stayframe.queries.oracle import ALL_COLUMNS, over
from stayframe.queries.registry import query
from stayframe.session import new_workspace
from stayframe.sources import catalog, runsource
from stayframe.sources.csvfiles import read_csv, write_csv
from stayframe.sources.listings import LISTINGS_SCHEMA, load_listings, table
from stayframe.sources.splitcsv import read_split_csv

NOTED_SCHEMA = T.StructType([*LISTINGS_SCHEMA.fields, T.StructField("note", T.StringType())])


def _noted(listings):
    """Listings with a field that holds the separator, quotes and a line break."""
    note = F.concat(F.lit('a "'), F.col("id").cast("string"), F.lit('", b\nline 2'))
    return listings.withColumn("note", note)


_NOTED_SQL = over("listings", """SELECT *, 'a "' || CAST(id AS STRING) || '", b' || chr(10) || 'line 2' AS note FROM listings""")


@query("a1_csv_scan", _NOTED_SQL)
def a1_csv_scan(spark, sf_dir):
    path = new_workspace(spark, "csv")
    write_csv(_noted(load_listings(spark, sf_dir)), path, compression="gzip")
    return read_csv(spark, path, NOTED_SCHEMA)


@query("a1_csv_scan_inferred", _NOTED_SQL)
def a1_csv_scan_inferred(spark, sf_dir):
    """Inference finds int where the column holds small numbers; the result is widened to the known types."""
    path = new_workspace(spark, "csv")
    write_csv(_noted(load_listings(spark, sf_dir)), path, compression="gzip")
    inferred = read_csv(spark, path)
    return inferred.select([F.col(field.name).cast(field.dataType) for field in NOTED_SCHEMA])


@query("a1_csv_split", _NOTED_SQL)
def a1_csv_split(spark, sf_dir):
    """One plain file whose fields span lines, read by as many tasks as its size asks for."""
    path = new_workspace(spark, "csv")
    write_csv(_noted(load_listings(spark, sf_dir)).coalesce(1), path)
    return read_split_csv(spark, path, NOTED_SCHEMA)


@query("a1_csv_long_texts", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def a1_csv_long_texts(spark, sf_dir):
    """Whole documents with their line breaks and quotes through gzip CSV."""
    path = new_workspace(spark, "csv")
    documents = table(spark, sf_dir, "documents")
    write_csv(documents, path, compression="gzip")
    return read_csv(spark, path, documents.schema)


@query("a2_csv_from_shared_path", over("listings", f"SELECT {', '.join(ALL_COLUMNS)} FROM listings"))
def a2_csv_from_shared_path(spark, sf_dir):
    """Files are read where they lie, by a path all executors reach, also when there are several folders of them."""
    path = new_workspace(spark, "csv")
    listings = load_listings(spark, sf_dir)
    dear = F.coalesce(F.length("price") > 7, F.lit(False))
    write_csv(listings.where(dear), f"{path}/dear", compression="gzip")
    write_csv(listings.where(~dear), f"{path}/other", compression="gzip")
    return read_csv(spark, [f"{path}/dear", f"{path}/other"], LISTINGS_SCHEMA)


@query(
    "a3_csv_null_value",
    over(
        "listings",
        """SELECT id, price, nullif(host_response_rate, 'N/A') AS host_response_rate FROM listings""",
    ),
)
def a3_csv_null_value(spark, sf_dir):
    """``N/A`` and the empty field are null."""
    path = new_workspace(spark, "csv")
    listings = load_listings(spark, sf_dir).select("id", "price", "host_response_rate")
    write_csv(listings, path, null_value="N/A")
    return read_csv(spark, path, listings.schema, null_value="N/A")


@query(
    "a1_malformed_rows",
    over(
        "listings",
        """SELECT CASE WHEN id % 50 = 0 THEN NULL ELSE id END AS id, CASE WHEN id % 50 = 0 THEN NULL ELSE minimum_nights END AS minimum_nights,
           CASE WHEN id % 50 = 0 THEN 'n' || CAST(id AS STRING) || ',many' END AS malformed FROM listings""",
    ),
)
def a1_malformed_rows(spark, sf_dir):
    """Plain lines, read by many tasks; rows that do not parse keep their text."""
    path = new_workspace(spark, "csv")
    bad = F.col("id") % 50 == 0
    rows = load_listings(spark, sf_dir).select(
        F.when(bad, F.concat(F.lit("n"), F.col("id"))).otherwise(F.col("id").cast("string")).alias("id"),
        F.when(bad, "many").otherwise(F.col("minimum_nights").cast("string")).alias("minimum_nights"),
    )
    write_csv(rows, path)
    return read_csv(spark, path, "id long, minimum_nights long", multi_line=False, corrupt_column="malformed")


def _taken_out(spark, database, rows):
    """The rows, written out of a database that is then dropped with its tables."""
    path = new_workspace(spark, "out-of-database")
    rows.write.parquet(path)
    catalog.drop_database(spark, database)
    return spark.read.schema(rows.schema).parquet(path)


@query("a4_database", over("etl", "SELECT * FROM etl"))
def a4_database(spark, sf_dir):
    path = new_workspace(spark, "db")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    catalog.create_database(spark, name, path)
    catalog.save_table(etl_rows(load_listings(spark, sf_dir)), f"{name}.refined")
    return _taken_out(spark, name, spark.table(f"{name}.refined"))


@query("a5_overwrite_table", over("etl", "SELECT id, bedrooms, price FROM etl"))
def a5_overwrite_table(spark, sf_dir):
    path = new_workspace(spark, "db")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    catalog.create_database(spark, name, path)
    rows = etl_rows(load_listings(spark, sf_dir))
    catalog.save_table(rows, f"{name}.refined")
    catalog.save_table(rows.drop("availability_365", "minimum_nights"), f"{name}.refined")
    return _taken_out(spark, name, spark.table(f"{name}.refined"))


@query("a6_drop_table", over("etl", "SELECT 'kept' AS table_name, count(*) AS n_rows FROM etl"))
def a6_drop_table(spark, sf_dir):
    """Two tables, one dropped; then another database dropped with its contents."""
    path = new_workspace(spark, "db")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    rows = etl_rows(load_listings(spark, sf_dir))
    for database in (name, f"{name}_old"):
        catalog.create_database(spark, database, f"{path}/{database}")
        catalog.save_table(rows, f"{database}.kept")
    catalog.save_table(rows.select("id"), f"{name}.dropped")
    catalog.drop_table(spark, f"{name}.dropped")
    catalog.drop_database(spark, f"{name}_old")
    if spark.catalog.databaseExists(f"{name}_old"):
        raise AssertionError("the dropped database is still there")
    left = catalog.tables(spark, name).select(F.col("tableName").alias("table_name"))
    return _taken_out(spark, name, left.crossJoin(spark.table(f"{name}.kept").agg(F.count("*").alias("n_rows"))))


@query("a7_csv_sink", over("listings", "SELECT id, price, host_response_time FROM listings"))
def a7_csv_sink(spark, sf_dir):
    path = new_workspace(spark, "csv")
    rows = load_listings(spark, sf_dir).select("id", "price", "host_response_time")
    write_csv(rows, path)
    return read_csv(spark, path, rows.schema)


@query("a7_importances_csv", over("tracking", SHARES_SQL))
def a7_importances_csv(spark, sf_dir):
    """The importance table, keyed by feature, through a CSV file."""
    path = new_workspace(spark, "csv")
    rows = tracking_rows(load_listings(spark, sf_dir))
    candidate = models.forest([name for name in rows.columns if name not in ("id", "price")], "price", {"n_estimators": 10, "random_state": 42})
    model = models.fit_trees({"forest": candidate}, rows, ["id"])["forest"]
    write_csv(models.importances(model).coalesce(1), path)
    return shares(read_csv(spark, path, "Feature string, Importance double"), rows)


@query(
    "a8_experiment_runs",
    over(
        "runs",
        """SELECT r.*, p.param_signup FROM runs r JOIN (
             SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS run_id,
               arg_max(props, (ts, event_id)) FILTER (WHERE event_type = 'signup' AND props IS NOT NULL) AS param_signup
             FROM events GROUP BY 1) p USING (run_id) WHERE experiment_id = (
             SELECT experiment_id FROM run_log GROUP BY experiment_id ORDER BY count(*) DESC, experiment_id LIMIT 1)""",
    ),
)
def a8_experiment_runs(spark, sf_dir):
    """All runs of the experiment with the most logged rows."""
    path = new_workspace(spark, "runs")
    runlog.store_log(run_log(table(spark, sf_dir, "events")), path)
    log = spark.read.parquet(path)
    busiest = log.groupBy("experiment_id").count().orderBy(F.desc("count"), "experiment_id").first()[0]
    return runlog.experiment_runs(log, busiest, RUN_METRICS, ["signup"])


@query(
    "a8_run_source",
    over(
        "run_log",
        f"""SELECT * FROM ({OPEN_RUNS_SQL}) WHERE experiment_id = (
             SELECT experiment_id FROM run_log GROUP BY experiment_id ORDER BY count(*) DESC, experiment_id LIMIT 1)""",
    ),
)
def a8_run_source(spark, sf_dir):
    """The runs of the experiment with the most logged rows, read as a data source of runs."""
    path = new_workspace(spark, "runs")
    log = run_log(table(spark, sf_dir, "events"))
    runsource.store_runs(log.withColumn("experiment_id", F.col("experiment_id").cast("long")), path)
    runsource.register(spark)
    busiest = log.groupBy("experiment_id").count().orderBy(F.desc("count"), "experiment_id").first()[0]
    runs = spark.read.format(runsource.FORMAT).option("log", path).load(str(busiest))
    return told(runs.withColumn("start_time", F.col("start_time").cast(log.schema["ts"].dataType)))


_INFO_SQL = " UNION ALL ".join(
    f"SELECT '{field.name}' AS column_name, {i} AS position, '{field.dataType.simpleString()}' AS type, "
    f"count({field.name}) AS non_null FROM listings"
    for i, field in enumerate(LISTINGS_SCHEMA)
)


@query("a9_column_info", over("listings", _INFO_SQL))
def a9_column_info(spark, sf_dir):
    return profile.column_info(load_listings(spark, sf_dir)).drop("n_rows")


@query("a9_preview", over("listings", f"SELECT {', '.join(ALL_COLUMNS)} FROM listings ORDER BY id LIMIT 20"))
def a9_preview(spark, sf_dir):
    """The first rows by key: a top-n, not a full sort."""
    return load_listings(spark, sf_dir).orderBy("id").limit(20)
