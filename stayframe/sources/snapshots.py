"""Versioned tables: one Parquet folder per version, and a history row that makes the version exist.

Layout below the table's path: ``version=N/`` with the rows, ``history/`` with one appended row per version. The
rows are written first and the history row last, so a write that fails half-way leaves no version behind. One
writer at a time; there is no commit protocol for concurrent writers.

A version may be stored by key: hashed into buckets and sorted in them. The history row says by which columns and into
how many buckets, so a scan by key needs no shuffle for a join or a grouping on them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayframe.sources import storage

HISTORY_SCHEMA = (
    "version bigint, ts timestamp, operation string, columns array<string>, schema string, n_rows bigint, "
    "bucket_columns array<string>, buckets int"
)


class NoSuchVersion(LookupError):
    """There is no version with this number, or none as old as the time asked for."""


def utc(moment: datetime | str | None):
    """A timestamp literal; a moment without a zone is taken as UTC, None as now."""
    if moment is None:
        moment = datetime.now(timezone.utc)
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return F.lit(moment.astimezone(timezone.utc).isoformat()).cast("timestamp")


def stored_schema(entry: Row) -> T.StructType:
    return T.StructType.fromJson(json.loads(entry.schema))


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def version_path(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def history(self) -> DataFrame:
        """One row per version: number, time, operation, live columns, stored schema, row count."""
        path = f"{self.path}/history"
        if not storage.exists(self.spark, path):
            return self.spark.createDataFrame([], HISTORY_SCHEMA)
        return self.spark.read.schema(HISTORY_SCHEMA).parquet(path)

    def write(
        self,
        df: DataFrame,
        *,
        schema_mode: str = "replace",
        operation: str = "WRITE",
        at: datetime | str | None = None,
        partition_by: Sequence[str] = (),
        bucket_by: Sequence[str] = (),
        buckets: int | None = None,
        check: Callable[[DataFrame], None] | None = None,
    ) -> int:
        """Write the next version and return its number; the first is 0.

        ``replace`` takes the frame's schema. ``grow`` keeps every earlier column: those the frame lacks are stored
        as null. With ``buckets`` the rows are stored by ``bucket_by``. ``check`` sees the stored rows (by key, if they
        are stored so) before the version exists, and may raise.
        """
        if buckets and partition_by:
            raise ValueError("a table is partitioned or stored by key, not both")
        latest = self._latest()
        live = df.columns
        if schema_mode == "grow" and latest is not None:
            df = _grown(df, stored_schema(latest))
        elif schema_mode not in ("replace", "grow"):
            raise ValueError(f"unknown schema_mode {schema_mode!r}")
        version = 0 if latest is None else latest.version + 1
        schema = df.schema
        if partition_by:
            # Rows of a partition value meet in few tasks, so there is not a file per task and value; a value that many
            # rows share is split by size.
            df = df.hint("rebalance", *partition_by)
        path = self.version_path(version)
        if buckets:
            # Each task holds the rows of one bucket, so that a bucket is one file.
            rows = df.repartition(buckets, *bucket_by).write.mode("overwrite").format("parquet")
            with _catalog_name(self.spark) as name:
                rows.bucketBy(buckets, *bucket_by).sortBy(*bucket_by).option("path", path).saveAsTable(name)
            stored = self._scan_by_key(version, schema, bucket_by, buckets)
        else:
            writer = df.write.mode("overwrite")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(path)
            stored = self._scan(version, schema)
        if check is not None:
            try:
                check(stored)
            except Exception:
                storage.delete(self.spark, self.version_path(version))
                raise
        self._record(version, at, operation, live, schema, stored.count(), bucket_by if buckets else None, buckets)
        return version

    def read(self, version: int | None = None, as_of: datetime | str | None = None) -> DataFrame:
        """The newest version, a version by number, or the newest one at a time."""
        return self.scan(self.entry(version, as_of))

    def scan(self, entry: Row) -> DataFrame:
        """The rows of a version, by its history row."""
        return self._scan(entry.version, stored_schema(entry))

    def scan_by_key(self, entry: Row) -> DataFrame:
        """The rows of a version that is stored by key, in its buckets."""
        if not entry.buckets:
            raise ValueError(f"version {entry.version} of {self.path} is not stored by key")
        return self._scan_by_key(entry.version, stored_schema(entry), entry.bucket_columns, entry.buckets)

    def entry(self, version: int | None = None, as_of: datetime | str | None = None) -> Row:
        """The history row of a version."""
        candidates = self.history()
        if version is not None:
            candidates = candidates.where(F.col("version") == version)
        if as_of is not None:
            candidates = candidates.where(F.col("ts") <= utc(as_of))
        found = candidates.orderBy(F.desc("version")).first()
        if found is None:
            raise NoSuchVersion(f"{self.path}: version {version}, as of {as_of}")
        return found

    def exists(self) -> bool:
        return storage.exists(self.spark, f"{self.path}/history")

    def delete(self) -> None:
        storage.delete(self.spark, self.path)

    def _latest(self) -> Row | None:
        return self.history().orderBy(F.desc("version")).first() if self.exists() else None

    def _scan(self, version: int, schema: T.StructType) -> DataFrame:
        # The stored schema fixes order and types, of partition columns too.
        return self.spark.read.schema(schema).parquet(self.version_path(version)).select(schema.names)

    def _scan_by_key(self, version: int, schema: T.StructType, bucket_by: Sequence[str], buckets: int) -> DataFrame:
        columns = ", ".join(_quoted(name) for name in bucket_by)
        location = self.version_path(version).replace("\\", "\\\\").replace("'", "\\'")
        fields = ", ".join(f"{_quoted(field.name)} {field.dataType.simpleString()}" for field in schema)
        # Only a catalog entry tells Spark of buckets; the frame keeps what it says when the entry is gone.
        with _catalog_name(self.spark) as name:
            self.spark.sql(
                f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({columns}) SORTED BY ({columns}) "
                f"INTO {buckets} BUCKETS LOCATION '{location}'"
            )
            return self.spark.table(name)

    def _record(self, version, at, operation, live, schema, n_rows, bucket_columns=None, buckets=None) -> None:
        row = self.spark.range(1, numPartitions=1).select(
            F.lit(version).cast("long").alias("version"),
            utc(at).alias("ts"),
            F.lit(operation).alias("operation"),
            F.array(*[F.lit(name) for name in live]).cast("array<string>").alias("columns"),
            F.lit(schema.json()).alias("schema"),
            F.lit(n_rows).cast("long").alias("n_rows"),
            (F.array(*map(F.lit, bucket_columns)) if bucket_columns else F.lit(None)).cast("array<string>").alias("bucket_columns"),
            F.lit(buckets).cast("int").alias("buckets"),
        )
        row.write.mode("append").parquet(f"{self.path}/history")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@contextmanager
def _catalog_name(spark: SparkSession) -> Iterator[str]:
    """A name for a catalog entry that lasts for the block. The entry's files, which have a path of their own, stay."""
    name = f"stayframe_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _grown(df: DataFrame, earlier: T.StructType) -> DataFrame:
    present = {field.name: field.dataType for field in df.schema}
    for field in earlier:
        if field.name in present and present[field.name] != field.dataType:
            raise ValueError(f"column {field.name} was {field.dataType}, now {present[field.name]}")
    kept = [
        F.col(field.name) if field.name in present else F.lit(None).cast(field.dataType).alias(field.name)
        for field in earlier
    ]
    return df.select(*kept, *[name for name in df.columns if name not in earlier.names])
