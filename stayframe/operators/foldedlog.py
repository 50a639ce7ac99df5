"""A version log whose older part is folded once: a stored state at a watermark, and the tail of rows after it.

What a fold keeps of a version (first seen, last stage change, latest archiving changes, latest description) can be merged
with what another part of the log gives, in any grouping. So the newest state comes from the stored one and the tail, and
only the tail's files are read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayframe.operators.joins import lookup
from stayframe.operators.runlog import moment
from stayframe.operators.versions import ACTIVE, VERSION, stage_code, stage_name
from stayframe.sources import storage
from stayframe.sources.snapshots import SnapshotTable, utc


def version_states(log: DataFrame) -> DataFrame:
    """What a part of the log says of each version; :func:`merged_states` puts parts together."""
    staged = F.when(F.col("stage").isNotNull(), moment())
    described = F.when(F.col("description").isNotNull(), moment())
    archiving = [F.max(F.when(F.col("archive_existing") & (F.col("stage") == stage), moment())).alias(f"archived_{stage}") for stage in ACTIVE]
    return log.groupBy(*VERSION).agg(
        F.min("ts").alias("first_ts"),
        F.max_by(stage_code(), staged).alias("code"),
        F.max(staged).alias("staged_at"),
        *archiving,
        F.max_by("description", described).alias("description"),
        F.max(described).alias("described_at"),
    )


def merged_states(states: DataFrame) -> DataFrame:
    """One state per version from the states of parts."""
    return states.groupBy(*VERSION).agg(
        F.min("first_ts").alias("first_ts"),
        F.max_by("code", "staged_at").alias("code"),
        F.max("staged_at").alias("staged_at"),
        *[F.max(f"archived_{stage}").alias(f"archived_{stage}") for stage in ACTIVE],
        F.max_by("description", "described_at").alias("description"),
        F.max("described_at").alias("described_at"),
    )


def stages_of(states: DataFrame) -> DataFrame:
    """The stage of every version, changes that archived older holders included, and its description."""
    of_model = states.groupBy("model").agg(*[F.max(f"archived_{stage}").alias(f"_archived_{stage}") for stage in ACTIVE])
    joined = lookup(states, of_model, ["model"])
    stage = stage_name(F.col("code"))
    overtaken: Column = F.lit(False)
    for active in ACTIVE:
        overtaken = overtaken | ((stage == active) & F.coalesce(F.col(f"_archived_{active}") > F.col("staged_at"), F.lit(False)))
    return joined.select(*VERSION, "first_ts", F.when(overtaken, "Archived").otherwise(stage).alias("stage"), "description")


class FoldedLog:
    """A version log by day, and its fold. Rows are appended in time: a row not after the watermark would not be seen."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.folds = SnapshotTable(spark, f"{self.path}/folds")

    def append(self, changes: DataFrame) -> None:
        """Add rows (model, version_key, ts, event_id, stage, archive_existing, description)."""
        by_day = changes.withColumn("day", F.to_date("ts"))
        by_day.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(f"{self.path}/log")

    def watermark(self) -> datetime | None:
        """Up to when rows are folded."""
        if not self.folds.exists():
            return None
        return datetime.fromisoformat(self.folds.entry().operation.removeprefix("FOLD "))

    def tail(self, until: datetime | None = None) -> DataFrame | None:
        """Rows after the watermark (up to a time); files of earlier days are not read. None without a log."""
        if not storage.exists(self.spark, f"{self.path}/log"):
            return None
        rows = self.spark.read.parquet(f"{self.path}/log")
        after = self.watermark()
        kind = rows.schema["ts"].dataType
        if after is not None:
            rows = rows.where((F.col("day") >= F.to_date(utc(after))) & (F.col("ts") > utc(after).cast(kind)))
        if until is not None:
            rows = rows.where((F.col("day") <= F.to_date(utc(until))) & (F.col("ts") <= utc(until).cast(kind)))
        return rows.drop("day")

    def states(self, until: datetime | None = None) -> DataFrame:
        """The state of every version: the stored fold and the tail together."""
        tail = self.tail(until)
        if tail is None:
            raise LookupError(f"no log at {self.path}")
        found = version_states(tail)
        if not self.folds.exists():
            return found
        return merged_states(self.folds.read().unionByName(found))

    def fold(self, until: datetime) -> int:
        """Store the state up to a time; later reads start from there."""
        after = self.watermark()
        if after is not None and until <= after:
            raise ValueError(f"folded up to {after} already")
        return self.folds.write(self.states(until), operation=f"FOLD {until.isoformat()}")
