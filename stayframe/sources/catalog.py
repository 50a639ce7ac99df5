"""Databases and managed tables of the session catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    if location:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(name)} LOCATION :location", {"location": location})
    else:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(name)}")


def save_table(df: DataFrame, name: str) -> None:
    """Write a managed table, replacing content and schema of an earlier one.

    Spark refuses to overwrite a table that the frame itself reads; a :class:`SnapshotTable` takes such writes.
    """
    df.write.format("parquet").mode("overwrite").saveAsTable(_quoted(name))


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")


def drop_database(spark: SparkSession, name: str) -> None:
    """Drop a database with all its tables."""
    spark.sql(f"DROP DATABASE IF EXISTS {_quoted(name)} CASCADE")


def tables(spark: SparkSession, database: str) -> DataFrame:
    """Names of the database's tables, without the session's temporary views."""
    return spark.sql(f"SHOW TABLES IN {_quoted(database)}").where("NOT isTemporary").select("tableName")
