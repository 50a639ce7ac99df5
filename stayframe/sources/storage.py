"""Path operations on whatever file system the path names (HDFS, object store, local)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _resolve(spark, path)
    return fs.exists(hadoop_path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder and its contents; False when it was not there."""
    fs, hadoop_path = _resolve(spark, path)
    return fs.delete(hadoop_path, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, sorted; empty when the folder does not exist."""
    fs, hadoop_path = _resolve(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop_path))
